"""Leaf operators: document edges, characters, constant lists, phrases and character classes.

All phrases and classes of an expression are found in one pass over the texts. That pass gives
one row a document with an array of hits for each pattern, and every leaf reads its own array;
if a query's plan shuffles that pass's result by document, its leaves share the exchange.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import regions


def start(docs: DataFrame) -> DataFrame:
    return regions(docs.where(F.length("text") > 0), F.lit(0), F.lit(0))


def end(docs: DataFrame) -> DataFrame:
    n = F.length("text") - 1
    return regions(docs.where(F.length("text") > 0), n, n)


def chars(docs: DataFrame) -> DataFrame:
    p = docs.where(F.length("text") > 0).select("doc_id", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("p"))
    return regions(p, F.col("p"), F.col("p"))


def check_list(pairs) -> tuple[tuple[int, int], ...]:
    """A constant list is ordered, and its regions are non-negative and not empty."""
    got = tuple((int(s), int(e)) for s, e in pairs)
    for s, e in got:
        if s < 0 or e < s:
            raise ValueError(f"({s},{e}) is not a region")
    if any(a >= b for a, b in zip(got, got[1:], strict=False)):
        raise ValueError("regions of a constant list must be in increasing order")
    return got


def constant(docs: DataFrame, pairs) -> DataFrame:
    """The same regions in every document; positions beyond its text are not checked."""
    got = check_list(pairs)
    if not got:
        return regions(docs.where("false"), F.lit(0), F.lit(0))
    rows = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in got])
    p = docs.select("doc_id", F.explode(rows).alias("p"))
    return regions(p, F.col("p.s"), F.col("p.e"))


def pattern(kind: str, text: str, ignore_case: bool) -> str:
    """A regular expression with one group, whose matches may begin at every position."""
    body = re.escape(text) if kind == "phrase" else f"[{''.join(map(re.escape, text))}]"
    return f"(?{'i' if ignore_case else ''}s:(?=({body})))"


def scan(docs: DataFrame, patterns: list[tuple[str, str]], ignore_case: bool = False) -> DataFrame:
    """(doc_id, hits): for each pattern its regions, overlapping ones included, in one pass."""
    schema = pa.schema([("doc_id", pa.int64()), ("hits", pa.list_(pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))))])

    def run(batches):
        exact = [t if k == "phrase" and not ignore_case else None for k, t in patterns]
        regexes = [re.compile(pattern(k, t, ignore_case)) for k, t in patterns]

        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                ss: list[int] = []
                es: list[int] = []
                ends = [0]
                for text in c.column(1).to_pylist():
                    for p, rx in zip(exact, regexes, strict=True):
                        if p is None:
                            for m in rx.finditer(text):
                                ss.append(m.start())
                                es.append(m.end(1) - 1)
                        else:
                            n, i = len(p) - 1, text.find(p)
                            while i >= 0:
                                ss.append(i)
                                es.append(i + n)
                                i = text.find(p, i + 1)
                        ends.append(len(ss))
                spans = pa.StructArray.from_arrays([pa.array(ss, pa.int64()), pa.array(es, pa.int64())], names=["s", "e"])
                each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)
                found = pa.ListArray.from_arrays(pa.array(range(0, len(ends), len(patterns)), pa.int32()), each)
                yield pa.RecordBatch.from_arrays([c.column(0), found.cast(schema.field(1).type)], schema=schema)

    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    if not ignore_case and all(k == "phrase" for k, _ in patterns):
        any_of = F.lit(False)
        for _, t in patterns:
            any_of = any_of | F.contains("text", F.lit(t))
        rows = rows.where(any_of)  # texts without any of them never leave the JVM
    return rows.mapInArrow(run, "doc_id long, hits array<array<struct<s:long,e:long>>>")


def hits_of(scanned: DataFrame, k: int) -> DataFrame:
    p = scanned.select("doc_id", F.explode(F.col("hits")[k]).alias("p"))
    return regions(p, F.col("p.s"), F.col("p.e"))


def files(docs: DataFrame, name: str) -> DataFrame:
    """Whole documents by name; a trailing * stands for any ending."""
    named = F.col("name").startswith(name[:-1]) if name.endswith("*") else F.col("name") == name
    return regions(docs.where(named & (F.length("text") > 0)), F.lit(0), F.length("text") - 1)
