"""Tables in the folder that driver and executors share, to end a lineage that an iteration would grow."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Used where the session names no shared folder and all runs on one machine, as in tests.
LOCAL_SHARED = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a cluster has to name one."""
    if told := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return told
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return LOCAL_SHARED


#: What this process has put into the shared folder.
_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/strandline/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor costs no rework."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def stored_counting(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
    """``stored``, and aggregates of the rows, taken as they are written.

    They are observed in the tasks that write, of which Spark counts each
    partition once, however often it is tried.
    """
    seen = Observation()
    out = stored(df.observe(seen, *(c.alias(k) for k, c in counts.items())), name)
    return out, seen.get


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``stored`` once nothing will read it again."""
    if path := getattr(df, "stored_at", None):
        _delete(df.sparkSession, path)
        _made.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete at the end what was put into the shared folder meanwhile, but for tables handed to the function that it gives.

    A result that still has to be computed from such tables must be written inside.
    """
    before, kept = set(_made), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.stored_at)
        return df

    try:
        yield keep
    finally:
        for path in [p for p in _made if p not in before and p not in kept]:
            _delete(spark, path)
            _made.remove(path)


def release(spark: SparkSession) -> None:
    """Delete all that this process has put into the shared folder; results that were not written elsewhere can't be read after."""
    while _made:
        _delete(spark, _made.pop())
