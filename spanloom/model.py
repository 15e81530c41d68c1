"""Schemas and invariants of the text-region engine.

A region is a non-empty stretch of one document: (doc_id, start_pos, end_pos), 0-based, both
ends inclusive, counted in Unicode code points. A region set has no equal rows; its order is
start_pos, then end_pos, and is only made for presentation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOCS = "doc_id long, name string, text string, seq long, length long, base long"
REGIONS = "doc_id long, start_pos long, end_pos long"
POSTINGS = "kind string, term string, doc_id long, start_pos long, end_pos long"
COLS = ["doc_id", "start_pos", "end_pos"]


def S() -> Column:
    return F.col("start_pos")


def E() -> Column:
    return F.col("end_pos")


def regions(df: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    start, end = S() if start is None else start, E() if end is None else end
    return df.select("doc_id", start.cast("long").alias("start_pos"), end.cast("long").alias("end_pos"))


def docs_from(df: DataFrame, id_col: str, text_col: str, name_col: str | None = None) -> DataFrame:
    """Any table with an integer id and a text as documents. Rows without an id or text are left out."""
    name = F.col(name_col) if name_col else F.col(id_col).cast("string")
    out = df.select(F.col(id_col).cast("long").alias("doc_id"), name.alias("name"), F.col(text_col).alias("text"))
    return out.where("doc_id is not null and text is not null")


def with_offsets(docs: DataFrame) -> DataFrame:
    """Adds seq, length and base (the running sum of earlier lengths, in order of id).

    The sum goes through ranges of ids, so that no task holds all documents: lengths are summed
    in each range, the ranges' sums (one row each) give their bases, and each range adds its own.
    """
    spark = docs.sparkSession
    sized = docs.withColumn("length", F.length("text").cast("long"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    low, high = sized.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return sized.withColumn("seq", F.lit(0).cast("long")).withColumn("base", F.lit(0).cast("long")).select("doc_id", "name", "text", "seq", "length", "base")
    # Whole division keeps the order of ids, negative ones included, and can't overflow.
    width = (high - low) // max(4, n) + 1
    sized = sized.withColumn("__range", F.expr(f"doc_id div {width}L"))
    sums = sized.groupBy("__range").agg(F.sum("length").alias("__l"), F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # at most n + 2 rows
    sums = sums.select("__range", F.coalesce(F.sum("__l").over(w), F.lit(0)).alias("__bl"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__bn"))
    own = Window.partitionBy("__range").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sized.withColumn("__run", F.sum("length").over(own) - F.col("length")).withColumn("__i", F.row_number().over(own) - 1)
    out = out.join(F.broadcast(sums), "__range")
    return out.select("doc_id", "name", "text", (F.col("__bn") + F.col("__i")).cast("long").alias("seq"), "length", (F.col("__bl") + F.col("__run")).cast("long").alias("base"))
