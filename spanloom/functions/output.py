"""Rendering of results: merged, distinct, long and formatted output, and filtering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..model import COLS, E, S
from ..operators import sets

LONG = "------------- #%n %f: %l (%s,%e : %i, %j)\n%r\n"
_UNESCAPE = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "%": "%"}


def with_text(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Regions with the text of each (region_text)."""
    return _sliced(found, docs, "start_pos", "end_pos")


def _sliced(found: DataFrame, docs: DataFrame, start: str, end: str) -> DataFrame:
    """found with region_text; a text meets the regions of its document as one row, and is sliced in one pass."""
    others = [c for c in found.columns if c != "doc_id"]
    own = found.groupBy("doc_id").agg(F.collect_list(F.struct(*others)).alias("p"))  # bounded by what one text holds
    rows = docs.select("doc_id", "text").join(own, "doc_id").select("doc_id", "text", "p")
    fields = T.StructType([found.schema[c] for c in found.columns] + [T.StructField("region_text", T.StringType())])
    schema = to_arrow_schema(fields)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                lists = c.column(2)
                n = pc.list_value_length(lists)
                flat = lists.flatten()
                cols = {name: flat.field(name) for name in others}
                ss, es, k, texts = cols[start].to_pylist(), cols[end].to_pylist(), 0, []
                for text, m in zip(c.column(1).to_pylist(), n.to_pylist(), strict=True):
                    texts += [text[ss[i] : es[i] + 1] for i in range(k, k + m)]
                    k += m
                cols["doc_id"] = c.column(0).take(pa.array(np.repeat(np.arange(len(n)), n.to_numpy(zero_copy_only=False))))
                yield pa.RecordBatch.from_arrays([*[cols[name].cast(schema.field(name).type) for name in found_columns], pa.array(texts, pa.string())], schema=schema)

    found_columns = found.columns
    return rows.mapInArrow(run, fields)


def short(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Default output: overlapping regions are shown once, as one; touching ones stay apart."""
    return with_text(sets.concat(found, adjacent=False), docs)


def numbered(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Regions with ordinal (from 1, in order of documents and positions), file and positions.

    docs has seq and base (model.with_offsets). Regions are counted in each document, and only
    the counts of documents take part in the running sum over all of them, by ranges of seq.
    """
    own = Window.partitionBy("doc_id").orderBy("start_pos", "end_pos")
    f = found.join(docs.select("doc_id", "name", "seq", "base"), "doc_id").withColumn("i", F.row_number().over(own))
    counts = f.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.floor(F.col("seq") / 65_536))
    parts = counts.groupBy("part").agg(F.sum("n").alias("m"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for 65,536 documents
    parts = parts.select("part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("b", F.sum("n").over(inside) - F.col("n")).join(parts, "part").select("seq", (F.col("b") + F.col("m")).alias("before"))
    f = f.join(counts, "seq")
    return f.select(
        "doc_id",
        (F.col("before") + F.col("i")).cast("long").alias("ordinal"),
        F.col("name").alias("file"),
        (E() - S() + 1).alias("length"),
        (S() + F.col("base")).alias("start_pos"),
        (E() + F.col("base")).alias("end_pos"),
        S().alias("file_start_pos"),
        E().alias("file_end_pos"),
    )


def long(found: DataFrame, docs: DataFrame) -> DataFrame:
    """All columns of long output, the text included."""
    n = _sliced(numbered(found, docs), docs, "file_start_pos", "file_end_pos")
    return n.select("ordinal", "file", "length", "start_pos", "end_pos", "file_start_pos", "file_end_pos", "region_text")


_FIELDS = {"f": "file", "s": "start_pos", "e": "end_pos", "l": "length", "i": "file_start_pos", "j": "file_end_pos", "r": "region_text", "n": "ordinal"}


def _parts(style: str) -> list[tuple[bool, str]]:
    """A format as plain text (False, text) and fields (True, column of long())."""
    parts, plain, at = [], "", 0
    while at < len(style):
        c = style[at : at + 2]
        if c[0] == "%" and c[1:] in _FIELDS and c[1:]:
            parts += [(False, plain), (True, _FIELDS[c[1]])]
            plain = ""
            at += 2
        elif c[0] in "%\\" and c[1:] in (_UNESCAPE if c[0] == "\\" else "%") and c[1:]:
            plain += _UNESCAPE[c[1]]
            at += 2
        elif c[0] == "%":
            raise ValueError(f"unknown field {c!r} in the format")
        else:
            plain += c[0]
            at += 1
    return [*parts, (False, plain)]


def format_column(style: str) -> Column:
    """A format as one string column over the columns of long().

    %f %s %e %l %i %j %r %n are the fields, %% is a per cent sign, and backslash escapes are known.
    """
    return F.concat(*[F.col(x).cast("string") if field else F.lit(x) for field, x in _parts(style)])


def formatted(found: DataFrame, docs: DataFrame, style: str = "%r") -> DataFrame:
    """(ordinal, line): each region in a format."""
    return long(found, docs).select("ordinal", format_column(style).alias("line"))


def read_style(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def filtered(found: DataFrame, docs: DataFrame, style: str = "%r") -> DataFrame:
    """(doc_id, text): whole documents with each (merged) region replaced by its format.

    A format with %n needs seq in docs too (model.with_offsets): regions are numbered over all documents.
    """
    parts = _parts(style)
    merged = sets.concat(found, adjacent=False)
    if (True, "ordinal") in parts:
        merged = numbered(merged, docs).select("doc_id", F.col("file_start_pos").alias("start_pos"), F.col("file_end_pos").alias("end_pos"), "ordinal")
    else:
        merged = merged.withColumn("ordinal", F.lit(None).cast("long"))
    # A text meets the regions of its document as one row: it isn't copied for each.
    own = merged.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "ordinal"))).alias("p"))  # bounded by what one text holds
    rows = docs.select("doc_id", "text", "name", "base").join(own, "doc_id", "left").select("doc_id", "text", "name", "base", "p")
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def replaced(text: str, name: str, base: int, p: list[dict]) -> str:
        out, at = [], 0
        for r in p:
            s, e = r["start_pos"], r["end_pos"]
            fields = {"file": name, "start_pos": s + base, "end_pos": e + base, "length": e - s + 1, "file_start_pos": s, "file_end_pos": e, "region_text": text[s : e + 1], "ordinal": r["ordinal"]}
            out.append(text[at:s])
            out += [str(fields[x]) if field else x for field, x in parts]
            at = e + 1
        return "".join(out) + text[at:]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                texts = [replaced(text, *rest, p) if p and text is not None else text for text, *rest, p in zip(*(c.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(texts, pa.string())], schema=schema)

    return rows.mapInArrow(run, "doc_id long, text string")


def count(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("regions"))


def render(lines: DataFrame, newline: bool = True) -> str:
    """All output as one text, for results that a driver may hold."""
    out = "".join(r[0] for r in lines.orderBy("ordinal").select("line").toLocalIterator())
    return out + "\n" if newline and out and not out.endswith("\n") else out


__all__ = ["COLS", "LONG", "count", "filtered", "format_column", "formatted", "long", "numbered", "read_style", "render", "short", "with_text"]
