"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, plain_unions, shuffled_joins


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, comp): every id that has an edge (a, b), and the least id of its component.

    Rows of a hot node are reduced before they are shuffled (minima and distinct pairs); each
    half round is a table in the shared folder, so a lost executor costs one half round.
    """
    with plain_unions(edges.sparkSession), shuffled_joins(edges.sparkSession):
        return _components(edges, most_rounds)


def _components(edges: DataFrame, most_rounds: int) -> DataFrame:
    spark = edges.sparkSession
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "cc")
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        small = materialise(small, "cc")
        # Done when every node's only edge is to a node that has no smaller neighbour itself.
        more = small.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() or small.alias("x").join(small.alias("y"), F.col("x.v") == F.col("y.u")).limit(1).count()
        discard(spark, now, large)
        now = small
        if not more:
            break
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(now.select("v", "v").distinct())
