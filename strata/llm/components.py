"""Connected components of a links table by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import discard, join_hot, stage


def _star(links: DataFrame, large: bool, rows: int) -> DataFrame:
    """One round over about `rows` links (a, b) with a > b; every vertex points its larger (smaller) neighbours at its
    least one. The hub of a large star is no hot key of the join."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n")).withColumn("m", F.least("a", "m"))
    joined = join_hot(both, least, ["a"], 2 * rows)
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links(a, b) long -> (node, component_id), one row for each node of a link; component_id: least node reachable.

    Self links and nulls are ignored, repeated links count once; no links give an empty table. Each round is staged in
    the shared folder, so a lost executor costs one round; the driver sees two counts a round, never the links.
    """
    first = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stage(first, "links")
    while True:
        open_, rows = _unsettled(edges)
        if not open_:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component_id")).union(edges.select("b", "b").distinct())
        old = edges
        middle = stage(_star(old, True, rows), "stars")
        edges = stage(_star(middle, False, rows), "star")
        discard(middle)
        discard(old)


def _unsettled(edges: DataFrame) -> tuple[int, int]:
    """How many vertices keep distinct links (a, b) with a > b from being separate stars, and the number of links.

    Where every a has one link and is no b, each b is the least vertex of its component, so no round is needed to see
    that nothing changes any more."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return tuple(ends.agg(F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)), F.coalesce(F.sum("up"), F.lit(0))).first())
