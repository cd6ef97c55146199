"""Connected components by alternating star contraction, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.llm.common import remove, written_at


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links between long ids -> (node, root), root the smallest id of the component.

    Nodes without a link are absent. A node may have any number of links: both steps join an aggregate of one row per
    node to the links, so the engine may split a hot node. Every round is written to the shared folder. Null ends are
    ignored, as are loops and repeated links; no links give no rows.
    """
    star, at = written_at(edges.select("a", "b").where("a <> b").distinct())
    mark = None
    for _ in range(max_rounds):
        before = at
        star, at = written_at(_small_star(_large_star(star)))
        remove(edges.sparkSession, before)
        seen = star.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            return star.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = seen
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
