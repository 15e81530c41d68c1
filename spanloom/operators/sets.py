"""Union, coalescing, spans of consecutive regions, extraction and parts of regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import COLS, E, S, regions

#: Width in characters of the cells that extraction joins on.
CELL = 4096


def union(*sets: DataFrame) -> DataFrame:
    out = sets[0].select(*COLS)
    for s in sets[1:]:
        out = out.unionAll(s.select(*COLS))
    return out.distinct()


def concat(a: DataFrame, adjacent: bool = True) -> DataFrame:
    """Maximal runs of covered positions; touching regions are one run if adjacent."""
    w = Window.partitionBy("doc_id").orderBy("start_pos", "end_pos")
    df = a.withColumn("m", F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("new", F.when(F.col("m").isNull() | (S() > F.col("m") + (1 if adjacent else 0)), 1).otherwise(0))
    df = df.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return regions(df.groupBy("doc_id", "run").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")))


def join_n(a: DataFrame, n: int) -> DataFrame:
    """From each region to the end of the n-th from it on, in order; the last n - 1 give none."""
    if n < 1:
        raise ValueError("join needs at least one region")
    w = Window.partitionBy("doc_id").orderBy("start_pos", "end_pos")
    df = a.select("doc_id", "start_pos", F.lead("end_pos", n - 1).over(w).alias("end_pos"))
    return df.where("end_pos is not null").distinct()


def extracting(a: DataFrame, b: DataFrame) -> DataFrame:
    """What is left of each region of a without the positions that b covers.

    Regions and gaps between runs of b meet in the cells of text they have in common, so a
    document with many of both isn't compared all with all. The gap after the last run, which has
    no end, is in a cell of its own (-1), and so is every region: one that meets nothing there is
    in a document without b.
    """
    w = Window.partitionBy("doc_id").orderBy("start_pos")
    runs = concat(b).withColumn("next", F.lead("start_pos").over(w)).withColumn("k", F.row_number().over(w))
    after = F.struct((E() + 1).alias("gs"), (F.col("next") - 1).alias("ge"))
    before = F.struct(F.lit(0).cast("long").alias("gs"), (S() - 1).alias("ge"))
    gaps = runs.select("doc_id", F.explode(F.when(F.col("k") == 1, F.array(after, before)).otherwise(F.array(after))).alias("g"))
    gaps = gaps.select("doc_id", "g.gs", "g.ge").where("ge is null or gs <= ge")
    cells = lambda x, y: F.sequence(F.floor(x / CELL), F.floor(y / CELL))
    open_cell = F.array(F.lit(-1).cast("long"))
    parts = gaps.withColumn("cell", F.explode(F.when(F.col("ge").isNull(), open_cell).otherwise(cells(F.col("gs"), F.col("ge")))))
    own = a.withColumn("cell", F.explode(F.concat(open_cell, cells(S(), E()))))
    meet = own.join(parts, ["doc_id", "cell"], "left")
    first = F.greatest(S(), F.col("gs"))
    # Clipped to its cells, a piece would be cut at their borders; so the whole overlap is taken, in its first cell.
    inside = (F.col("cell") >= 0) & (F.col("gs") <= E()) & (F.col("ge") >= S()) & (F.col("cell") == F.floor(first / CELL))
    last = (F.col("cell") < 0) & (F.col("gs").isNull() | (F.col("gs") <= E()))
    # greatest and least leave out nulls.
    return meet.where(inside | last).select("doc_id", first.alias("start_pos"), F.least(E(), F.col("ge")).alias("end_pos")).distinct()


def first_bytes(a: DataFrame, n: int) -> DataFrame:
    return regions(a, S(), F.least(E(), S() + n - 1)).distinct()


def last_bytes(a: DataFrame, n: int) -> DataFrame:
    return regions(a, F.greatest(S(), E() - n + 1), E()).distinct()


def shorter(a: DataFrame, n: int) -> DataFrame:
    """Regions of fewer than n characters."""
    return a.where(E() - S() + 1 < n)
