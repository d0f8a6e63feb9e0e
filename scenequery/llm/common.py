"""What the operators of this subpackage share: tables, the shared folder, words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: what one Python worker holds at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


#: Whether Spark removes the shuffle files of a query at its end.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches, so that long texts don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that all machines share, under spark.checkpoint.dir.

    Only where that is unset and Spark runs on one machine, as in tests, a temporary folder serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="scenequery-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base:
        base = f"file://{base}" if base.startswith("/") else base
    return f"{base}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, *by: str, plain: tuple[str, ...] = (), codec: str | None = None, clean: bool = False) -> DataFrame:
    """Write df to the shared folder, partitioned by `by`, and read it back: its lineage ends there.

    `plain` names columns of hashes, for which the writer need not try a dictionary; `codec` compresses in place of the session's.
    With `clean`, what was shuffled for it is removed at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true" if clean else before)
    try:
        df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in plain}, **({"compression": codec} if codec else {})).partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


#: Most keys that spread_join sends to all tasks, and rows of a key that always stay together.
HOT_KEYS, COLD_ROWS = 100_000, 1024


def spread_join(rows: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """rows, a written table, joined with one, which has at most a row per key.

    Keys with more than max(COLD_ROWS, rows / HOT_KEYS) rows would each fall to one task; they
    are HOT_KEYS at most, whatever the data, and their rows of `one` are broadcast instead.
    """
    cut = max(COLD_ROWS, rows.count() // HOT_KEYS)
    hot = materialise(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_")).filter(F.col("n_") > cut).select(key), "hot")
    if hot.isEmpty():
        return rows.join(one, key)
    few = F.broadcast(hot)
    return rows.join(few, key, "left_anti").join(one, key).unionByName(rows.join(F.broadcast(one.join(few, key, "left_semi")), key))


def spread_join_sized(rows: DataFrame, counted: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined with counted, a written table of each key's row and number of rows, in one pass over rows; as spread_join, for whole-number keys.

    Rows of hot keys find theirs by broadcast and are dealt out evenly in the exchange that follows.
    """
    total = counted.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) > max(COLD_ROWS, total // HOT_KEYS)
    more = [c for c in counted.columns if c != key]
    named = lambda x, p: x.select(F.col(key).alias(f"{p}k"), *[F.col(c).alias(f"{p}{c}") for c in more])
    x = rows.join(F.broadcast(named(counted.filter(hot), "h_")), F.col(key) == F.col("h_k"), "left")
    x = x.withColumn("k_", F.when(F.col("h_k").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns)))
    x = x.join(named(counted.filter(~hot), "c_"), (F.col("k_") == F.col("c_k")) & F.col("h_k").isNull(), "left")
    x = x.filter(F.col("h_k").isNotNull() | F.col("c_k").isNotNull())
    return x.select(*rows.columns, *[F.coalesce(f"h_{c}", f"c_{c}").alias(c) for c in more])


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(col, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def spare_name(columns: list[str], base: str) -> str:
    """A column name near base that clashes with none of columns."""
    taken = {c.lower() for c in columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name
