from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scenequery.streaming import frames as S

T0 = datetime(2024, 1, 1)
SCHEMA = "cam long, ts timestamp, value double"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Frames of two cameras in files of an hour each, the last file far ahead so that all before it is closed."""
    path = str(tmp_path_factory.mktemp("frames"))
    rows = [(c, T0 + timedelta(seconds=s), float(s % 7)) for c in (1, 2) for s in (0, 2, 4, 30, 31, 100 * c)]
    for part in (rows, rows[:1], [(9, T0 + timedelta(days=1), 0.0)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def drain(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    return spark.table(name)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 10).parquet(path)


def secs(t):
    return int((t - T0).total_seconds())


def test_bursts(spark, source):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    got = drain(spark, S.bursts(stream(spark, source), ["cam"], "ts", "10 seconds", "1 minute"), "bursts").filter("cam = 1").collect()
    assert sorted((secs(r.begin), secs(r.end), r.n) for r in got) == [(0, 14, 4), (30, 41, 2), (100, 110, 1)]
    batch = S.bursts(spark.read.schema(SCHEMA).parquet(source), ["cam"], "ts", "10 seconds", "1 minute")
    assert sorted((secs(r.begin), r.n) for r in batch.filter("cam = 2").collect()) == [(0, 3), (30, 2), (200, 1)]


def test_rates(spark, source):
    got = drain(spark, S.rates(stream(spark, source), ["cam"], "ts", "1 minute", "1 minute"), "rates").filter("cam = 2").collect()
    assert sorted((secs(r.begin), r.n, r.total) for r in got) == [(0, 5, 0.0 + 2 + 4 + 2 + 3), (180, 1, 4.0)]


def test_distinct_frames(spark, source):
    got = drain(spark, S.distinct_frames(stream(spark, source), ["cam", "ts"], "ts", "1 minute"), "distinct_frames")
    assert got.count() == 13


def test_motion_keyframes(spark, source):
    x = S.motion_keyframes(stream(spark, source).dropDuplicates(["cam", "ts"]), "cam", "ts", "value", 6.0)
    got = drain(spark, x, "motion").filter(F.col("cam") == 1).orderBy("ts").collect()
    assert [(secs(r.ts), r.total) for r in got] == [(4, 6.0), (100, 7.0)]
