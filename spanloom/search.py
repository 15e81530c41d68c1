"""Searching documents with expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .functions import markup, output
from .functions.macros import MACROS
from .model import with_offsets
from .plans.ast import Node, unparse
from .plans.compile import Compiler
from .plans.parser import QueryError, parse
from .sources.files import concatenate
from .sources.shared import delete


def search(docs: DataFrame, query: str | Node, ignore_case: bool = False, index=None, macros=None, word_chars: str = markup.WORD_CHARS) -> DataFrame:
    """Regions (doc_id, start_pos, end_pos) of an expression in documents (doc_id, name, text).

    Large sub-expressions that are used repeatedly are written to the shared folder when the query is
    compiled. release() deletes those tables once the result is no longer read.
    """
    node = parse(query, MACROS if macros is None else macros) if isinstance(query, str) else query
    if "name" not in docs.columns:
        from pyspark.sql import functions as F

        docs = docs.withColumn("name", F.col("doc_id").cast("string"))
    compiler = Compiler(docs.select("doc_id", "name", "text"), ignore_case, index, word_chars)
    out = compiler.run(node)
    out.tables = compiler.tables  # type: ignore[attr-defined]
    return out


def release(found: DataFrame) -> None:
    """Deletes the tables that search() has written for this result, which can't be read after that."""
    delete(found.sparkSession, *getattr(found, "tables", []))


def search_streams(files: DataFrame, query: str | Node, stream_col: str, order_col: str, text_col: str = "text", **options) -> DataFrame:
    """Regions in streams: files of one stream, in order, as one text; regions may cross files."""
    return search(concatenate(files, stream_col, order_col, text_col), query, **options)


def show(query: str | Node, macros=None) -> str:
    """The expression that a query stands for, macros expanded, without running it."""
    return unparse(parse(query, MACROS if macros is None else macros) if isinstance(query, str) else query)


@dataclass
class Result:
    """What a search run to the end gave: status 0 (found), 1 (nothing found) or 2 (error)."""

    status: int
    text: str = ""
    error: str = ""


def run(docs: DataFrame, query: str | Node, style: str = "%r", distinct: bool = False, count: bool = False, newline: bool = True, **options) -> Result:
    """Runs a query and renders its output on the driver: for results that it may hold."""
    try:
        found = search(docs, query, **options)
        if count:
            n = found.count()
            return Result(0 if n else 1, f"{n}\n")
        from .operators.sets import concat

        found = found if distinct else concat(found, adjacent=False)
        text = output.render(output.formatted(found, with_offsets(docs), style), newline)
        return Result(0 if text else 1, text)
    except (QueryError, ValueError) as e:
        return Result(2, "", str(e))
