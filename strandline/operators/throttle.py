"""Failed attempts in a trailing window, request spacing, and the login rule as a fold."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW_S, LIMIT = 900, 10


def with_micros(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def failure_counts(attempts: DataFrame, window_s: float = WINDOW_S) -> DataFrame:
    """``attempts(key, ts, failed)`` with ``n``: the key's failures in the trailing window, this one included; its far end counts."""
    trailing = Window.partitionBy("key").orderBy("us").rangeBetween(-int(window_s * 1_000_000), 0)
    return with_micros(attempts).withColumn("n", F.count_if("failed").over(trailing))


def spacing(requests: DataFrame, interval_s: float) -> DataFrame:
    """``requests(key, ts, id)`` with the seconds since the key's last one, and how long it should have waited; the first is free."""
    before = Window.partitionBy("key").orderBy("us", "id")
    gap = (F.col("us") - F.lag("us").over(before)) / 1_000_000
    return with_micros(requests).withColumn("gap_s", gap).withColumn("wait_s", F.greatest(F.lit(0.0), interval_s - F.col("gap_s")))


def login_decisions(attempts: DataFrame, window_s: float = WINDOW_S, limit: int = LIMIT) -> DataFrame:
    """``key, id, blocked`` of ``attempts(key, ts, id, failed)``.

    An attempt is blocked if ``limit`` failures lie in its window; a blocked one
    is not recorded, a success clears the record, so each decision depends on
    those before. A key's attempts pass through one task in order of time and
    id, whose state is the last ``limit`` failure times at most. Attempts
    without a time are left out; those without a key are one key's.
    """
    us = int(window_s * 1_000_000)

    def decide(batches):
        begun, last, recent = False, None, deque()
        for b in batches:
            keys, ids, times, failures = (c.to_pylist() for c in b.columns)
            blocked = []
            for key, t, failed in zip(keys, times, failures):
                if not begun or key != last:
                    begun, last, recent = True, key, deque()
                while recent and t - recent[0] > us:
                    recent.popleft()
                blocked.append(len(recent) >= limit)
                if not blocked[-1]:
                    recent.append(t) if failed else recent.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(blocked, pa.bool_())], names=["key", "id", "blocked"])

    kind = dict(attempts.dtypes)
    rows = with_micros(attempts).where("us is not null").select("key", "id", "us", "failed").repartition("key").sortWithinPartitions("key", "us", "id")
    return rows.mapInArrow(decide, f"key {kind['key']}, id {kind['id']}, blocked boolean")
