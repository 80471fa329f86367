"""Lookups by time as sorts and equi-joins: the latest row at or before a time, and intervals that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def latest(rows: DataFrame, requests: DataFrame, keys: list[str], at: str, order: str, value: Column) -> DataFrame:
    """Requests (keys, `at`, ...) with `found`: the value of the last row of their key whose `at` is not later, null without one.

    Rows and requests are laid into one sequence of times, in which a request takes the last value before
    it; rows of equal times count in order of `order`, and before requests. Nothing is paired.
    """
    own = [c for c in requests.columns if c not in keys]
    a = rows.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_asks"), F.col(order).cast("bigint").alias("_order"), value.alias("_value"), *[F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in own])
    b = requests.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_asks"), F.lit(None).cast("bigint").alias("_order"), F.lit(None).cast(a.schema["_value"].dataType).alias("_value"), *own)
    by = W.partitionBy(*keys).orderBy("_at", "_asks", "_order").rowsBetween(W.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("found", F.last("_value", ignorenulls=True).over(by)).where("_asks = 1").select(*keys, *own, "found")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], bucket: int) -> DataFrame:
    """Pairs of intervals of a key that overlap, [start, end) of the columns a and b; other columns have names of their own.

    Both sides stand in every bucket of time that they touch, and a pair counts in the first bucket that both are in.
    """
    spread = lambda df, c, name: df.withColumn(name, F.floor(F.col(c[0]) / bucket)).withColumn("_b", F.explode(F.sequence(F.col(name), F.greatest(F.floor((F.col(c[1]) - 1) / bucket), F.col(name)))))
    pairs = spread(left, a, "_l").join(spread(right, b, "_r"), [*keys, "_b"])
    return pairs.where((F.col("_b") == F.greatest("_l", "_r")) & (F.col(a[0]) < F.col(b[1])) & (F.col(a[1]) > F.col(b[0]))).drop("_b", "_l", "_r")
