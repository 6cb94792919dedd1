"""A stored BM25 index: postings by term in buckets, grown by segments.

A segment's documents are dealt over stripes by hash. A posting row is a term
in a stripe: the documents that hold it, their counts and sizes, and the two
numbers that bound a score, the greatest count and the least size. A query
opens the buckets of its terms alone; it reads the bounds, scores the stripes
that promise most, and then only those that can still reach the result.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import FLOOR, K1, B, query_tokens
from ..sources.manifest import Manifest

#: Buckets of a segment; documents of a stripe, about; stripes that are scored first.
BUCKETS, STRIPE, FIRST = 64, 4096, 32

POSTINGS = "term string, stripe long, n long, most long, least long, held array<struct<id:{id},f:long,size:long>>"


def add(corpus: DataFrame, folder: str, stripe: int = STRIPE, buckets: int = BUCKETS) -> bool:
    """Add ``corpus(id, tokens)`` as a segment; False where it holds nothing new.

    Documents whose id is indexed already, and repeated ones, are left out: a
    document's words don't change. No row without id is indexed.
    """
    spark, m = corpus.sparkSession, Manifest(corpus.sparkSession, folder)
    # Which documents are new is found without their words; of rows with one id the words with the least hash count.
    corpus = corpus.where("id is not null").select("id", "tokens", F.xxhash64("tokens").alias("hash"))
    docs = corpus.select("id", F.struct("hash", F.size("tokens").cast("long").alias("size")).alias("d")).groupBy("id").agg(F.min("d").alias("d")).select("id", "d.size", "d.hash")
    known = m.read()[1]
    if known:
        docs = docs.join(_documents(spark, known), "id", "left_anti")
    path = m.new_segment()
    docs.write.parquet(f"{path}/documents")
    sizes = spark.read.parquet(f"{path}/documents")
    n, words = sizes.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not n:
        return False
    stripes = -(-n // stripe)
    # The segment's documents are those written down, whatever the corpus gives when it is read again.
    rows = corpus.join(sizes.select("id", "hash"), ["id", "hash"], "left_semi")  # the only time that words move by document
    rows = rows.dropDuplicates(["id", "hash"]).select("id", "hash", F.size("tokens").cast("long").alias("size"), F.pmod(F.xxhash64("id"), F.lit(stripes)).alias("stripe"), F.explode("tokens").alias("term"))
    counts = rows.groupBy("id", "hash", "term", "stripe", "size").agg(F.count(F.lit(1)).alias("f"))
    # Postings move once: dealt as they are written, they are grouped where they come to lie.
    dealt = counts.select("term", "stripe", "id", "f", "size", _bucket(F.col("term"), buckets).alias("bucket"), F.expr(f"stripe div {FIRST}").alias("part")).repartition("bucket", "part")
    held = dealt.groupBy("bucket", "part", "term", "stripe").agg(F.count(F.lit(1)).alias("n"), F.max("f").alias("most"), F.min("size").alias("least"), F.array_sort(F.collect_list(F.struct("id", "f", "size"))).alias("held"))
    held = held.select("term", "stripe", "n", "most", "least", "held", "bucket").sortWithinPartitions("bucket", "term", "stripe")
    held.write.partitionBy("bucket").parquet(f"{path}/postings")
    full = sorted(r.bucket for r in spark.read.parquet(f"{path}/postings").select("bucket").distinct().collect()) if words else []  # a row a bucket
    m.add({"path": path, "n": n, "words": words, "buckets": buckets, "full": full, "id": sizes.schema["id"].dataType.simpleString()})
    return True


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets))


def _documents(spark: SparkSession, segments: list[dict]) -> DataFrame:
    return reduce(DataFrame.unionAll, [spark.read.schema(f"id {s['id']}, size long").parquet(f"{s['path']}/documents") for s in segments])


def _postings(spark: SparkSession, segments: list[dict], terms: list[str] | None = None) -> DataFrame:
    """Posting rows of the terms, from their buckets alone, or all; ``segment`` and ``stripe`` tell documents' groups."""
    parts = []
    for k, s in enumerate(segments):
        full = s["full"]
        if terms is not None:
            asked = spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"), s["buckets"]).alias("b")).distinct()
            full = [r.b for r in asked.collect() if r.b in full]  # a row a term of the query
        if full:
            rows = spark.read.schema(POSTINGS.format(id=s["id"])).parquet(*[f"{s['path']}/postings/bucket={b}" for b in full])
            parts.append((rows if terms is None else rows.where(F.col("term").isin(terms))).withColumn("segment", F.lit(k)))
    if not parts:
        return spark.createDataFrame([], POSTINGS.format(id=segments[0]["id"] if segments else "string") + ", segment int")
    return reduce(DataFrame.unionAll, parts)


def weights(spark: SparkSession, segments: list[dict], query: str) -> tuple[dict[str, float], float]:
    """What each term of the query weighs, with its repeats, and the mean size; the whole vocabulary is only counted where a term stands in more than half of all documents."""
    times = Counter(query_tokens(query))
    n = sum(s["n"] for s in segments)
    mean = sum(s["words"] for s in segments) / n if n else 1.0
    held = {r.term: r.n for r in _postings(spark, segments, list(times)).groupBy("term").agg(F.sum("n").alias("n")).collect()} if times else {}
    idf = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in held.items()}
    if any(x < 0 for x in idf.values()):
        counts = _postings(spark, segments).groupBy("term").agg(F.sum("n").alias("n"))
        average = counts.agg(F.avg(F.log(n - F.col("n") + 0.5) - F.log(F.col("n") + 0.5))).first()[0]
        idf = {t: x if x >= 0 else FLOOR * average for t, x in idf.items()}
    return {t: x * times[t] for t, x in idf.items()}, mean or 1.0


def _part(weight: Column, f: Column, size: Column, mean: float) -> Column:
    return weight * f * (K1 + 1) / (f + K1 * (1 - B + B * size / F.lit(mean)))


def search(spark: SparkSession, folder: str, query: str, limit: int = 5) -> DataFrame:
    """``id, score``: the first ``limit`` documents by BM25 (six decimals), then id, as a search of the texts finds them; documents without a term of the query score 0."""
    segments = Manifest(spark, folder).read()[1]
    if not segments:
        return spark.createDataFrame([], "id string, score double")
    weight, mean = weights(spark, segments, query)
    documents = _documents(spark, segments)
    if not weight:
        return documents.select("id", F.lit(0.0).alias("score")).orderBy("id").limit(limit)
    rows = _postings(spark, segments, list(weight))
    of = F.create_map(*(F.lit(x) for t in weight.items() for x in t))[F.col("term")]
    bounds = rows.groupBy("segment", "stripe").agg(F.sum(F.greatest(_part(of, F.col("most"), F.col("least"), mean), F.lit(0.0))).alias("bound"))

    def scored(some: DataFrame) -> DataFrame:
        each = some.select(of.alias("w"), F.explode("held").alias("d")).select("d.id", _part(F.col("w"), F.col("d.f"), F.col("d.size"), mean).alias("part"))
        return each.groupBy("id").agg(F.round(F.sum("part"), 6).alias("score"))

    first = bounds.orderBy(F.desc("bound"), "segment", "stripe").limit(FIRST).select("segment", "stripe")
    best = scored(rows.join(F.broadcast(first), ["segment", "stripe"], "left_semi")).orderBy(F.desc("score"), "id").limit(limit).agg(F.count(F.lit(1)), F.min("score")).first()
    if best[0] == limit and best[1] > 0:
        able = bounds.where(F.col("bound") >= best[1] - 1e-6).select("segment", "stripe")
        return scored(rows.join(able, ["segment", "stripe"], "left_semi")).orderBy(F.desc("score"), "id").limit(limit)
    hits = scored(rows)
    rest = documents.join(hits, "id", "left_anti").select("id", F.lit(0.0).alias("score"))
    return hits.unionByName(rest).orderBy(F.desc("score"), "id").limit(limit)


def compact(spark: SparkSession, folder: str) -> bool:
    """Make one segment of all, stripe by stripe as they are; False where there was nothing to do."""
    m = Manifest(spark, folder)
    old = m.read()[1]
    if len(old) < 2 or len({(s["buckets"], s["id"]) for s in old}) > 1:
        return False
    path, buckets = m.new_segment(), old[0]["buckets"]
    _documents(spark, old).write.parquet(f"{path}/documents")
    # Stripes of different segments hold different documents and keep apart.
    rows = _postings(spark, old).withColumn("stripe", F.col("stripe") * len(old) + F.col("segment")).drop("segment").withColumn("bucket", _bucket(F.col("term"), buckets))
    rows.repartition("bucket", F.expr(f"stripe div {FIRST * len(old)}")).sortWithinPartitions("bucket", "term", "stripe").write.partitionBy("bucket").parquet(f"{path}/postings")
    return m.replace(old, {"path": path, "n": sum(s["n"] for s in old), "words": sum(s["words"] for s in old), "buckets": buckets, "full": sorted({b for s in old for b in s["full"]}), "id": old[0]["id"]})
