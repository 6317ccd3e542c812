"""Connected components of a distributed graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import stage


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for each id in ``edges(a, b)``, the component named by its least id.

    Each round hangs a node's larger neighbours on its least one, then the same for smaller ones;
    rounds are few (logarithmic) and each is written, so none is computed twice. Least neighbours
    are pre-aggregated before the shuffle, and the joins on a node are split where it is hot.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == mark or not mark[0]:
            break
        before = mark
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(small.union(lower.select("a", F.col("m").alias("b"))).distinct(), "stars")
    return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).union(now.select("b", "b").distinct())
