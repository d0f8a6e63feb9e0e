"""Combining tables by key."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of first, and of second what first lacks."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def merge_disjoint(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The union, each row marked with whether its key stands in both."""
    twice = first.select(key).intersect(second.select(key)).withColumn("clash", F.lit(True))
    return first.unionByName(second).join(twice, key, "left").withColumn("clash", F.coalesce("clash", F.lit(False)))


def unique_key_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Join on keys that stand once in either table."""
    once = lambda x: x.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select(key)
    return a.join(once(a), key, "left_semi").join(b.join(once(b), key, "left_semi"), key)


def overlapping(a: DataFrame, b: DataFrame, by: str, low: str, high: str, width: int) -> DataFrame:
    """(by, id, other): intervals of a and b that meet within a group; they are dealt out over cells of `width`, and a pair counts in the first cell of both."""
    cells = lambda x: x.withColumn("cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    x, y = cells(a), cells(b).select(by, "cell", F.col("id").alias("other"), F.col(low).alias("low2"), F.col(high).alias("high2"))
    meet = (F.col(low) <= F.col("high2")) & (F.col("low2") <= F.col(high)) & (F.col("cell") == F.floor(F.greatest(low, "low2") / width))
    return x.join(y, [by, "cell"]).filter(meet & (F.col("id") != F.col("other"))).select(by, "id", "other")
