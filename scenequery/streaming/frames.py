"""Frames as a stream: bursts, rates, trailing windows and motion key frames.

Tables have an event time.  `bursts` and `rates` take streams and batches, the others
streams only; state is bounded by the watermark, and that of key frames is one number a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bursts(frames: DataFrame, by: list[str], time: str, gap: str, late: str) -> DataFrame:
    """(by..., begin, end, n): runs of frames less than `gap` apart; rows later than `late` are dropped."""
    x = frames.withWatermark(time, late).groupBy(*by, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return x.select(*by, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def rates(frames: DataFrame, by: list[str], time: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """(by..., begin, n, total): frames and sum of `value` of each window, tumbling or, with slide, sliding."""
    x = frames.withWatermark(time, late).groupBy(*by, F.window(time, width, slide or width).alias("w"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(*by, F.col("w.start").alias("begin"), "n", "total")


def distinct_frames(frames: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key, as far as the watermark remembers."""
    return frames.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def motion_keyframes(frames: DataFrame, by: str, time: str, motion: str, enough: float) -> DataFrame:
    """(by, time, total): frames at which the motion summed since the last key frame reaches `enough`; the sum then begins anew.

    Frames are taken in order of time within a micro-batch, and micro-batches as
    they come: the source has to deliver each key's frames in order.  A null motion is none.
    """
    kind = frames.schema[by].dataType.simpleString()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0.0
        x = pd.concat(list(parts), ignore_index=True).sort_values(["_t", "_m"], kind="stable")
        out = []
        for t, m in zip(x["_t"], x["_m"].fillna(0.0)):
            total += m
            if total >= enough:
                out.append((key[0], t, total))
                total = 0.0
        state.update((total,))
        yield pd.DataFrame(out, columns=["k", "t", "total"]).astype({"total": float})

    x = frames.select(F.col(by).alias("_k"), F.col(time).cast("timestamp").alias("_t"), F.col(motion).cast("double").alias("_m"))
    out = x.groupBy("_k").applyInPandasWithState(step, f"k {kind}, t timestamp, total double", "total double", "append", GroupStateTimeout.NoTimeout)
    return out.toDF(by, time, "total")
