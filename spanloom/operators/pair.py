"""Pairing of left and right regions, as brackets pair, and quoting."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import COLS, REGIONS, E, S, regions

_ENDS = {"..": (0, 0), "._": (0, 1), "_.": (1, 0), "__": (1, 1)}


def pair(a: DataFrame, b: DataFrame, form: str = "..") -> DataFrame:
    """Regions from a left to its right partner; form says which of the two ends are left out.

    Lefts open at their end and rights close at their start, closers first at one place. The
    running sum of openers less closers is the depth, and an opener pairs with the next event
    at its own depth if that is a closer.
    """
    skip_left, skip_right = _ENDS[form]
    opens = a.select("doc_id", E().alias("p"), F.lit(1).alias("k"), S().alias("tie"), S().alias("s"), E().alias("e"))
    closes = b.select("doc_id", S().alias("p"), F.lit(-1).alias("k"), E().alias("tie"), S().alias("s"), E().alias("e"))
    order = Window.partitionBy("doc_id").orderBy("p", "k", "tie")
    events = opens.unionAll(closes).withColumn("sum", F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    events = events.withColumn("depth", F.col("sum") + F.when(F.col("k") == -1, 1).otherwise(0))
    level = Window.partitionBy("doc_id", "depth").orderBy("p", "k", "tie")
    events = events.withColumn("n", F.lead(F.struct("k", "s", "e")).over(level)).where((F.col("k") == 1) & (F.col("n.k") == -1))
    first = F.col("e") + 1 if skip_left else F.col("s")
    last = F.col("n.s") - 1 if skip_right else F.col("n.e")
    out = regions(events, first, last)
    return (out.where(S() <= E()) if skip_left or skip_right else out).distinct()


def quote(a: DataFrame, b: DataFrame, skip_left: bool = False, skip_right: bool = False) -> DataFrame:
    """From the earliest left to the first right after it, then from the next left, and so on.

    Sequential by nature: the sorted events of each document stream through a fold that holds
    nothing but its state, however many there are.
    """
    events = a.select(*COLS, F.lit(0).alias("k")).unionAll(b.select(*COLS, F.lit(1).alias("k")))
    ordered = events.repartition("doc_id").sortWithinPartitions("doc_id", "start_pos", "end_pos", "k")

    def run(batches):
        doc, opened, left, limit = None, False, (0, 0), -1
        for batch in batches:
            ids, ss, es = [], [], []
            for d, s, e, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if d != doc:
                    doc, opened, limit = d, False, -1
                if s <= limit:
                    continue
                if k == 0 and not opened:
                    opened, left, limit = True, (s, e), e
                elif k == 1 and opened:
                    opened, limit = False, e
                    x, y = (left[1] + 1 if skip_left else left[0]), (s - 1 if skip_right else e)
                    if x <= y:
                        ids.append(d)
                        ss.append(x)
                        es.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ss, pa.int64()), pa.array(es, pa.int64())], names=COLS)

    return ordered.select(*COLS, "k").mapInArrow(run, REGIONS)
