"""Containment, equality, direct containment and nearness: filters of the left operand.

A region lies in another if it is inside it and not equal to it. All filters but the direct
ones are one pass over both operands, sorted by position in each document: running extremes say
whether a partner exists, so cost doesn't depend on how many partners there are. Direct
containment and the n-th in a container are joins on document and cell of text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import COLS, E, S

#: Width in characters of the cells that joins of regions and their containers meet in.
CELL = 512


def _left():
    return F.col("side") == 1


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*COLS, F.lit(1).alias("side")).unionAll(b.select(*COLS, F.lit(0).alias("side")))


def _kept(df: DataFrame, test, negate: bool) -> DataFrame:
    test = F.coalesce(test, F.lit(False))
    return df.where(_left() & (~test if negate else test)).select(*COLS)


def within(a: DataFrame, b: DataFrame, negate: bool = False) -> DataFrame:
    """a in b: some region of b that begins earlier ends no earlier, or one that begins no later ends later."""
    w = Window.partitionBy("doc_id").orderBy("start_pos")
    end = F.when(F.col("side") == 0, E())
    df = _both(a, b).withColumn("m1", F.max(end).over(w.rangeBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("m2", F.max(end).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return _kept(df, F.coalesce(F.col("m1") >= E(), F.lit(False)) | F.coalesce(F.col("m2") > E(), F.lit(False)), negate)


def containing(a: DataFrame, b: DataFrame, negate: bool = False) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("back")
    end = F.when(F.col("side") == 0, E())
    df = _both(a, b).withColumn("back", -S())
    df = df.withColumn("m1", F.min(end).over(w.rangeBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("m2", F.min(end).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return _kept(df, F.coalesce(F.col("m1") <= E(), F.lit(False)) | F.coalesce(F.col("m2") < E(), F.lit(False)), negate)


def inner(a: DataFrame) -> DataFrame:
    """Regions that contain no other; the set is read once."""
    w = Window.partitionBy("doc_id").orderBy("back")
    df = a.withColumn("back", -S())
    df = df.withColumn("m1", F.min("end_pos").over(w.rangeBetween(Window.unboundedPreceding, -1))).withColumn("m2", F.min("end_pos").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return df.where(~(F.coalesce(F.col("m1") <= E(), F.lit(False)) | (F.col("m2") < E()))).select(*COLS)


def outer(a: DataFrame) -> DataFrame:
    """Regions in no other; the set is read once."""
    w = Window.partitionBy("doc_id").orderBy("start_pos")
    df = a.withColumn("m1", F.max("end_pos").over(w.rangeBetween(Window.unboundedPreceding, -1))).withColumn("m2", F.max("end_pos").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return df.where(~(F.coalesce(F.col("m1") >= E(), F.lit(False)) | (F.col("m2") > E()))).select(*COLS)


def equal(a: DataFrame, b: DataFrame, negate: bool = False) -> DataFrame:
    """Intersection, or difference, as an equi-join on all three columns."""
    return a.join(b.select(*COLS), COLS, "left_anti" if negate else "left_semi")


def _at(a: DataFrame, s: str, e: str) -> DataFrame:
    """Regions named s, e, each in the cell that it begins in."""
    return a.select("doc_id", F.floor(S() / CELL).alias("cell"), S().alias(s), E().alias(e))


def _over(a: DataFrame, s: str, e: str) -> DataFrame:
    """Regions named s, e, each in all cells that it has a position in: those that a region in it may begin in."""
    return a.select("doc_id", F.explode(F.sequence(F.floor(S() / CELL), F.floor(E() / CELL))).alias("cell"), S().alias(s), E().alias(e))


def _lies_in(a: str, b: str):
    """(as, ae) lies in (bs, be) and isn't equal to it."""
    s, e, t, f = (F.col(x) for x in (f"{a}s", f"{a}e", f"{b}s", f"{b}e"))
    return (t <= s) & (e <= f) & ((t < s) | (e < f))


def _pairs(inside: DataFrame, outside: DataFrame) -> DataFrame:
    """Pairs of a region and one that it lies in; only those with a cell in common meet."""
    return _at(inside, "is", "ie").join(_over(outside, "os", "oe"), ["doc_id", "cell"]).where(_lies_in("i", "o"))


def _direct(inside: DataFrame, outside: DataFrame, between: DataFrame) -> DataFrame:
    """Pairs with no region of `between` that lies between."""
    p, m = _pairs(inside, outside).alias("p"), _over(between, "ms", "me").alias("m")
    same = (F.col("p.doc_id") == F.col("m.doc_id")) & (F.col("p.cell") == F.col("m.cell"))
    return p.join(m, same & _lies_in("i", "m") & _lies_in("m", "o"), "left_anti")


def parenting(a: DataFrame, b: DataFrame) -> DataFrame:
    """Regions of a that directly contain some region of b: with no other region of a between."""
    return _direct(b, a, a).select("doc_id", F.col("os").alias("start_pos"), F.col("oe").alias("end_pos")).distinct()


def childrening(a: DataFrame, b: DataFrame) -> DataFrame:
    """Regions of a that lie directly in some region of b: with no other region of a between."""
    return _direct(a, b, a).select("doc_id", F.col("is").alias("start_pos"), F.col("ie").alias("end_pos")).distinct()


def before(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """Regions of a that a region of b follows with at most n characters between (an extension)."""
    at = F.when(_left(), E()).otherwise(S())
    w = Window.partitionBy("doc_id").orderBy("back").rangeBetween(Window.unboundedPreceding, -1)
    df = _both(a, b).withColumn("back", -at).withColumn("next", F.min(F.when(F.col("side") == 0, S())).over(w))
    return _kept(df, F.col("next") - E() - 1 <= n, False)


def near(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """Regions of a with a region of b, before, after or overlapping, at most n characters away (an extension)."""
    at = F.when(_left(), E()).otherwise(S())
    up = Window.partitionBy("doc_id").orderBy("at").rangeBetween(Window.unboundedPreceding, n + 1)
    # Of the regions of b that begin at most n + 1 after this one's end, the one that ends last.
    df = _both(a, b).withColumn("at", at).withColumn("last", F.max(F.when(F.col("side") == 0, E())).over(up))
    return _kept(df, F.col("last") >= S() - n - 1, False)


def nth_in(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """The n-th region of a (by start, then end; -1: the last) in each region of b."""
    order = [F.col("is"), F.col("ie")] if n > 0 else [F.col("is").desc(), F.col("ie").desc()]
    p = _pairs(a, b).withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "os", "oe").orderBy(*order)))
    return p.where(F.col("k") == abs(n)).select("doc_id", F.col("is").alias("start_pos"), F.col("ie").alias("end_pos")).distinct()
