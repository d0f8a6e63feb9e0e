"""Ordered analytics: islands, brackets, keyframes."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], order: list, breaks: Column, name: str = "island") -> DataFrame:
    """Number the runs of rows; a row for which `breaks` (over the window's lags) holds begins a new one."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_b", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn(name, F.sum("_b").over(w)).drop("_b")


def lag(column: str, by: list[str], order: list) -> Column:
    return F.lag(column).over(Window.partitionBy(*by).orderBy(*order))


def fixed_brackets(df: DataFrame, by: list[str], order: list, size: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("bracket", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def mode_size(groups: DataFrame, size: str) -> DataFrame:
    """The most frequent group size; ties: the larger."""
    return groups.groupBy(size).agg(F.count(F.lit(1)).alias("votes")).orderBy(F.desc("votes"), F.desc(size)).limit(1)


def keyframes(df: DataFrame, by: list[str], order: list, step: int) -> DataFrame:
    """Every step-th row, the first included."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter((F.col("_k") - 1) % step == 0).drop("_k")


def sessions(df: DataFrame, by: list[str], time: str, seconds: int) -> DataFrame:
    """Runs of rows not more than `seconds` apart."""
    at = lambda c: F.unix_seconds(c.cast("timestamp"))
    gap = at(F.col(time)) - at(lag(time, by, [time])) > seconds
    return islands(df, by, [time], gap, "session")
