"""The login rule on a stream: the state of a key is its recent failure times, ``limit`` at most."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.throttle import LIMIT, WINDOW_S

#: The first watermark is the epoch, and what is not after it would be late: for the watermark, attempts are put a hundred years later, and those of other centuries to the ends of what pandas can tell.
LATER_US, FIRST_US, LAST_US = 3_155_760_000_000_000, 1, 9_223_372_036_000_000


def login_decisions(attempts: DataFrame, window_s: float = WINDOW_S, limit: int = LIMIT, late: str = "1 hour") -> DataFrame:
    """``key, id, blocked`` of a stream ``attempts(key, ts, id, failed)``; attempts of a key are taken in order of time within a batch, those without a time left out.

    A key has a state only while it has failures that may still count: a success
    ends it, and so does the watermark, ``late`` behind the last attempt that
    was seen, once it is a window past the key's last failure. Attempts from
    before the watermark come too late and are left out.
    """
    us = int(window_s * 1_000_000)

    def decide(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["us", "id"])
        said = []
        for t, i, failed in zip(rows["us"], rows["id"], rows["failed"]):
            recent = [x for x in recent if t - x <= us]
            blocked = len(recent) >= limit
            if not blocked:
                recent = [*recent, int(t)] if failed else []
            said.append((key[0], i, blocked))
        # An attempt counts failures a whole window back, so one that comes behind this time counts none of them.
        ends = (recent[-1] + us + LATER_US) // 1000 + 1 if recent else 0
        if ends > state.getCurrentWatermarkMs():
            state.update((recent,))
            state.setTimeoutTimestamp(ends)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(said, columns=["key", "id", "blocked"])

    timed = attempts.select("key", "id", "failed", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).where("us is not null")
    timed = timed.withColumn("at", F.timestamp_micros(F.least(F.greatest(F.col("us") + LATER_US, F.lit(FIRST_US)), F.lit(LAST_US)))).withWatermark("at", late)
    return timed.groupBy("key").applyInPandasWithState(decide, "key long, id long, blocked boolean", "recent array<long>", "append", "EventTimeTimeout")


def failures_per_window(attempts: DataFrame, window: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Failures of each key in tumbling windows, with a watermark for late attempts."""
    timed = attempts.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("key", F.window("at", window).alias("w")).agg(F.count_if("failed").alias("n")).select("key", F.col("w.start").alias("start"), "n")
