"""Sensor widths by names that are written in several ways."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain_name(c: Column) -> Column:
    """Lower case, without punctuation and blanks."""
    return F.regexp_replace(F.lower(c), r"[\p{Punct}\s]", "")


def lookup(views: DataFrame, sensors: DataFrame) -> DataFrame:
    """(brand, model, row, width): for each pair of names in views(brand, model), the first of sensors(row, brand, model, width) that fits.

    Of two plain brands one begins with the other, of two plain models one ends
    with the other.  So first letters of brands and last letters of models are
    equal, and these two are the join's keys.  A name without letters or digits fits nothing.
    """

    def keyed(df: DataFrame, p: str) -> DataFrame:
        x = df.withColumn(f"{p}b", plain_name(F.col("brand"))).withColumn(f"{p}m", plain_name(F.col("model")))
        return x.filter(f"{p}b != '' and {p}m != ''").withColumn("_first", F.substring(f"{p}b", 1, 1)).withColumn("_last", F.substring(f"{p}m", -1, 1))

    left = keyed(views.select("brand", "model").distinct(), "a")
    right = keyed(sensors.select("row", "width", "brand", "model"), "b").drop("brand", "model")
    fits = (F.startswith("ab", "bb") | F.startswith("bb", "ab")) & (F.endswith("am", "bm") | F.endswith("bm", "am"))
    best = left.join(right, ["_first", "_last"]).filter(fits).groupBy("brand", "model").agg(F.min(F.struct("row", "width")).alias("s"))
    return best.select("brand", "model", "s.row", "s.width")
