"""Fetched works by seed, in segments: each save adds one, the newest record of an id counts.

A segment holds its works, their least and greatest id, and a Bloom filter of
their ids, so that a lookup reads only segments that can hold what it asks for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .manifest import Manifest

#: Bits of a segment's filter for each id, hashes of an id, and bits of a row of the filter.
BITS, HASHES, ROW = 10, 3, 32_768


def _places(bits: int) -> Column:
    """Where an id's bits are in a filter of so many."""
    return F.array(*(F.pmod(F.xxhash64(F.lit(k), F.col("id").cast("string")), F.lit(bits)) for k in range(HASHES)))


def _write(works: DataFrame, path: str) -> dict | None:
    """Write a segment; what the manifest says of it, or nothing where there are no works."""
    spark = works.sparkSession
    works.write.parquet(f"{path}/works")
    held = spark.read.schema(works.schema).parquet(f"{path}/works")
    n, low, high = held.agg(F.count("id"), F.min("id"), F.max("id")).first()
    if not n:
        return None
    bits = -(-max(n * BITS, ROW) // ROW) * ROW
    at = held.where("id is not null").select(F.explode(_places(bits)).alias("at"))
    at.groupBy(F.expr(f"at div {ROW}").alias("row")).agg(F.bitmap_construct_agg(F.expr(f"cast(at % {ROW} as int)")).alias("bits")).write.parquet(f"{path}/filter")
    return {"path": path, "n": n, "low": low, "high": high, "bits": bits}


def _newest(spark: SparkSession, segments: list[tuple[int, dict]], schema) -> DataFrame:
    """Works of the segments, of each id the one that was saved last."""
    if not segments:
        return spark.createDataFrame([], schema)
    parts = [spark.read.schema(schema).parquet(f"{s['path']}/works").withColumn("__saved", F.lit(k)) for k, s in segments]
    all_of = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        last = Window.partitionBy("id").orderBy(F.desc("__saved"))
        all_of = all_of.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    return all_of.drop("__saved")


def segments_for(spark: SparkSession, folder: str, seed: str, keys: DataFrame) -> list[tuple[int, dict]]:
    """The segments that may hold one of ``keys(id)``, by range and then by filter; keys stay where they are, a row for each segment comes back."""
    known = list(enumerate(Manifest(spark, f"{folder}/{seed}").read()[1]))
    if not known:
        return []
    keys = keys.select("id").where("id is not null").distinct()
    in_range = keys.agg(*(F.bool_or(F.col("id").between(F.lit(s["low"]), F.lit(s["high"]))).alias(str(k)) for k, s in known)).first()
    known = [(k, s) for k, s in known if in_range[str(k)]]
    if not known:
        return []
    found = []
    for k, s in known:
        asked = keys.where(F.col("id").between(F.lit(s["low"]), F.lit(s["high"]))).select("id", F.explode(_places(s["bits"])).alias("at"))
        filters = spark.read.schema("row long, bits binary").parquet(f"{s['path']}/filter")
        held = asked.select("id", F.expr(f"at div {ROW}").alias("row"), F.expr(f"cast(at % {ROW} as int)").alias("bit")).join(filters, "row")
        byte = F.expr("cast(conv(hex(substring(bits, bit div 8 + 1, 1)), 16, 10) as int)")
        held = held.where(F.call_function("shiftright", byte, F.expr("cast(bit % 8 as int)")).bitwiseAND(1) == 1)
        # Two hashes of an id may fall on one bit, which the explosion then has twice.
        found.append(held.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == HASHES).select(F.lit(k).alias("k")))
    hit = {r.k for r in reduce(DataFrame.unionAll, found).distinct().collect()}
    return [(k, s) for k, s in known if k in hit]


def lookup(spark: SparkSession, folder: str, seed: str, schema, keys: DataFrame, enabled: bool = True) -> DataFrame:
    """Cached works of ``keys(id)``; only segments that can hold one are read."""
    segments = segments_for(spark, folder, seed, keys) if enabled else []
    return _newest(spark, segments, schema).join(keys.select("id").distinct(), "id", "left_semi")


def read(spark: SparkSession, folder: str, seed: str, schema, enabled: bool = True) -> DataFrame:
    """The cached works of ``seed``; empty where there are none or the cache is off."""
    known = Manifest(spark, f"{folder}/{seed}").read()[1] if enabled else []
    return _newest(spark, list(enumerate(known)), schema)


def save(works: DataFrame, folder: str, seed: str, enabled: bool = True) -> None:
    """Add works (by id, each once) to the cache of ``seed`` as a segment; nothing that is there is touched."""
    if not enabled:
        return
    m = Manifest(works.sparkSession, f"{folder}/{seed}")
    if segment := _write(works, m.new_segment()):
        m.add(segment)


def compact(spark: SparkSession, folder: str, seed: str, schema) -> bool:
    """Make one segment of all there are; False where there was nothing to do or another has done it meanwhile. What is saved meanwhile stays, and counts as newer."""
    m = Manifest(spark, f"{folder}/{seed}")
    old = m.read()[1]
    if len(old) < 2:
        return False
    segment = _write(_newest(spark, list(enumerate(old)), schema), m.new_segment())
    return bool(segment) and m.replace(old, segment)


def vacuum(spark: SparkSession, folder: str, seed: str, older_than_s: float = 24 * 3600) -> list[str]:
    """Delete segments that no reader can need any more."""
    return Manifest(spark, f"{folder}/{seed}").vacuum(older_than_s)
