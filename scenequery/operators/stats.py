"""Robust statistics, histograms, order statistics, support filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenequery.operators.graph import _cut as cut

#: Of percentile_approx: its error is a share of one in so many.
ACCURACY = 10_000


def order_statistics(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group, the value at place floor(n * share) (n - 1 at most) of its values in order, not interpolated; nulls take no part.

    Approximate quantiles bracket each place; values outside are only counted, and the few inside are
    ordered, so that no task orders a whole group.
    """
    names = list(shares)
    x = df.select(*by, F.col(value).alias("v_")).filter("v_ is not null").withColumn("g_", F.lit(0))
    keys = ["g_", *by]
    edges = [max(0.0, min(1.0, shares[n] + s)) for n in names for s in (-3 / ACCURACY, 3 / ACCURACY)]
    whole = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"), F.percentile_approx("v_", edges, ACCURACY).alias("q_"), F.min("v_").alias("a_"), F.max("v_").alias("b_"))
    # near the ends the approximation may miss the extremes
    low = lambda i: F.when(F.floor(F.col("n_") * shares[names[i]]) <= 6 * F.col("n_") / ACCURACY, F.col("a_")).otherwise(F.col("q_")[2 * i])
    high = lambda i: F.when(F.floor(F.col("n_") * shares[names[i]]) >= F.col("n_") - 1 - 6 * F.col("n_") / ACCURACY, F.col("b_")).otherwise(F.col("q_")[2 * i + 1])
    place = lambda i: F.least(F.floor(F.col("n_") * shares[names[i]]), F.col("n_") - 1)
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), place(i).alias("place"), low(i).alias("low"), high(i).alias("high")) for i in range(len(names))])
    y = x.join(whole.select(*keys, F.explode(wanted).alias("w_")), keys).filter(F.col("v_") <= F.col("w_.high"))
    inside = F.col("v_") >= F.col("w_.low")
    counted = y.groupBy(*keys, F.col("w_.i").alias("i_"), F.col("w_.place").alias("place_"), F.when(inside, F.col("v_")).alias("v_")).agg(F.count(F.lit(1)).alias("k_"))
    upto = F.sum("k_").over(Window.partitionBy(*keys, "i_").orderBy(F.asc_nulls_first("v_")))
    at = counted.withColumn("upto_", upto).filter(F.col("v_").isNotNull() & (F.col("upto_") > F.col("place_")))
    found = at.groupBy(*keys).agg(*[F.min(F.when(F.col("i_") == i, F.col("v_"))).alias(n) for i, n in enumerate(names)])
    return found.select(*by, *names)


def box(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, least, most, mean, first_quartile, median, third_quartile); quartiles are values at places n/4, n/2 and 3n/4."""
    x = df.filter(F.col(value).isNotNull())
    sums = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean")).withColumn("g_", F.lit(0))
    q = order_statistics(x, by, value, {"first_quartile": 0.25, "median": 0.5, "third_quartile": 0.75}).withColumn("g_", F.lit(0))
    return sums.join(q, ["g_", *by]).drop("g_")


def box_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """`box` of each group, with a rounded mean and without n."""
    return box(df, [by], value).withColumn("mean", F.round("mean", 4)).drop("n")


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, mean, deviation, median, last_decile, most)."""
    x = df.filter(F.col(value).isNotNull())
    sums = x.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.max(value).alias("most")).withColumn("g_", F.lit(0))
    q = order_statistics(x, by, value, {"median": 0.5, "last_decile": 0.9}).withColumn("g_", F.lit(0))
    return sums.join(q, ["g_", *by]).drop("g_")


def median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median): the middle value, or the mean of the two in the middle."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n_"))
    upper = order_statistics(df, by, value, {"u_": 0.5})
    # the lower one of the two: the greatest value below the upper one, or the upper one itself if it stands at that place too
    x = df.select(*by, F.col(value).alias("v_")).filter("v_ is not null")
    one = lambda d: d.withColumn("g_", F.lit(0))
    y = one(x).join(one(upper), ["g_", *by]).groupBy("g_", *by).agg(F.first("u_").alias("u_"), F.count(F.when(F.col("v_") < F.col("u_"), 1)).alias("below_"), F.max(F.when(F.col("v_") < F.col("u_"), F.col("v_"))).alias("l_"))
    y = y.join(one(n), ["g_", *by])
    lower = F.when(F.col("below_") > F.col("n_") / 2 - 1, F.col("l_")).otherwise(F.col("u_"))
    return y.select(*by, F.when(F.col("n_") % 2 == 1, F.col("u_")).otherwise((F.col("u_") + lower) / 2).alias("median"))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): half-open bins, the last one closed; -1 below, `bins` above."""
    b = F.when(value < low, -1).when(value > high, bins).when(value == high, bins - 1).otherwise(F.floor((value - low) / (high - low) * bins))
    return df.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def bin_values(low: float, high: float, bins: int) -> list[float]:
    """Abscissae of the bins, from low to high, both included."""
    return [low + (high - low) / (bins - 1) * i for i in range(bins)] if bins > 1 else [low] * bins


def counts_with_zeros(keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The number of rows for each key, 0 included."""
    return keys.select(key).join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def rmse(df: DataFrame, residual: Column, per: int = 1) -> DataFrame:
    """Root of the mean square, -1 without any; per: numbers that a residual stands for (2 for image points)."""
    return df.agg(F.coalesce(F.round(F.sqrt(F.sum(residual * residual) / (per * F.count(residual))), 6), F.lit(-1.0)).alias("rmse"))


def moments(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """(by, mean, variance): the variance is E[x x] - E[x] E[x]."""
    m = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.avg(value * value).alias("s_"))
    return m.select(*by, "mean", (F.col("s_") - F.col("mean") * F.col("mean")).alias("variance"))


def ranked(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def supported(rows: DataFrame, key: str, least: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(key)


def stable_rows(rows: DataFrame, a: str, least_a: int, b: str, least_b: int) -> DataFrame:
    """Drop keys with too few rows, of either kind in turn, until no row goes; lineage is cut by checkpoint()."""
    rows = cut(rows)
    n = rows.count()
    while True:
        rows = rows.join(supported(rows, a, least_a), a, "left_semi")
        rows = cut(rows.join(supported(rows, b, least_b), b, "left_semi"))
        left = rows.count()
        if left == n:
            return rows
        n = left
