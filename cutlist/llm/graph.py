"""Connected components of links by alternating large and small stars, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._text import materialised


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hooks neighbours to the smallest one: larger neighbours (large) or the others (small)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(a, b) links -> (node, component): the smallest node that can be reached, for every node with a link.

    Each round ends in a table of the shared folder; two numbers a round reach the driver.
    A round at least halves the height of the trees, so that rounds grow with the logarithm
    of the longest chain; not to end within `most_rounds` is an error.
    """
    mark = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    now = materialised(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = mark(now)
    for _ in range(most_rounds):
        now = materialised(_star(_star(now, True), False), "stars")
        new = mark(now)
        if new == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = new
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
