"""Point, key and neighbour lookups, and seed search."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import doi
from ..functions.text import bm25, document_text, tokens
from .titles import ALIKE, grams, plain, similarity


def by_ids(works: DataFrame, keys: DataFrame) -> DataFrame:
    """Works whose id is in ``keys(id)``; ids without a work are absent."""
    return works.join(keys.select("id").distinct(), "id", "left_semi")


def missing(works: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys without a work."""
    return keys.select("id").distinct().join(works.select("id"), "id", "left_anti")


def cached_or_fetched(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """Both, by id; a fetched record replaces a cached one."""
    both = fetched.withColumn("__first", F.lit(0)).unionByName(cache.withColumn("__first", F.lit(1)))
    return both.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy("__first"))).where("__n = 1").drop("__n", "__first")


def by_doi(works: DataFrame, keys: DataFrame, order: str = "id") -> DataFrame:
    """One work for each DOI of ``keys(doi)``, however it is written; of several works the last by ``order``, the column that says how they arrived."""
    asked = keys.select(doi(F.col("doi")).alias("key")).where("key is not null").distinct()
    found = works.withColumn("key", doi(F.col("doi"))).join(asked, "key")
    return found.groupBy("key").agg(F.max_by(F.struct(*works.columns), F.struct(order, "id")).alias("w")).select(F.col("key").alias("asked_doi"), "w.*")


def citing(works: DataFrame, cites: DataFrame, keys: DataFrame, limit: int, strategy: str = "top_cited", seed: int = 0) -> DataFrame:
    """For each of ``keys(id)``: the works that cite it, ``limit`` at most, the most cited or a sample that ``seed`` fixes. Adds ``rank``."""
    found = cites.join(keys.select(F.col("id").alias("tgt")).distinct(), "tgt").select(F.col("tgt").alias("cited_id"), F.col("src").alias("id"))
    return _first(found.join(works.select("id", "cited_by_count"), "id"), "cited_id", limit, strategy, seed)


def references(works: DataFrame, cites: DataFrame, keys: DataFrame, limit: int, strategy: str = "top_cited", seed: int = 0) -> DataFrame:
    """For each of ``keys(id)``: the works that it cites, ``limit`` at most. Adds ``rank``."""
    found = cites.join(keys.select(F.col("id").alias("src")).distinct(), "src").select(F.col("src").alias("citing_id"), F.col("tgt").alias("id"))
    return _first(found.join(works.select("id", "cited_by_count"), "id"), "citing_id", limit, strategy, seed)


def _first(found: DataFrame, key: str, limit: int, strategy: str, seed: int) -> DataFrame:
    order = [F.md5(F.concat_ws(":", "id", F.lit(seed))), F.col("id")] if strategy == "random" else [F.desc("cited_by_count"), F.col("id")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= limit)


def search(works: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Works by BM25 of title and abstract; adds ``score`` (six decimals) and orders by it, then id."""
    corpus = works.withColumn("tokens", tokens(document_text(F.col("title"), F.col("abstract"))))
    stats = bm25(corpus, "tokens", query)
    return corpus.withColumn("score", F.round(stats.score(F.col("tokens")), 6)).drop("tokens").orderBy(F.desc("score"), "id").limit(limit)


def title_match(works: DataFrame, query: str, least: float = ALIKE) -> DataFrame:
    """The work whose tokens of the title are the query's; if there is none, the one whose title is most alike, from ``least`` on. Of several the most cited, then the smallest id."""
    text = plain(F.lit(query))
    told = works.sparkSession.range(1).select(text.alias("text"), grams(text).alias("g")).first()
    asked, own, its = F.lit(told.text), plain(F.col("title")), F.lit(told.g) if told.g else F.array().cast("array<string>")
    # A title that is alike has so many of the query's grams as pieces of its text; lists of grams are made of such titles alone.
    many = max(1, math.ceil(least * len(told.g) - 1e-9))
    able = F.exists(F.array(own), lambda t: (t == asked) | (F.size(F.filter(its, lambda g: F.contains(t, g))) >= many))
    near = works.where(able).withColumns({"__same": own == asked, "__like": similarity(grams(own), its)}).where(F.col("__same") | (F.col("__like") >= least))
    return near.orderBy(F.desc("__same"), F.desc("__like"), F.desc("cited_by_count"), "id").limit(1).drop("__same", "__like")


def seed_candidates(works: DataFrame, other: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """The other source's title match, joined back by DOI, then search results not seen before. Adds ``matched_by`` and ``place``."""
    found = by_doi(works, title_match(other, query).select("doi")).drop("asked_doi")
    columns = ["id", "title", "publication_year", "cited_by_count"]
    first = found.select(*columns, F.lit("title").alias("matched_by"), F.lit(0).alias("source"), F.lit(0.0).alias("score"))
    second = search(works, query, limit).select(*columns, F.lit("search").alias("matched_by"), F.lit(1).alias("source"), "score")
    both = first.unionByName(second)
    once = both.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("source"))).where("n = 1")
    place = F.row_number().over(Window.orderBy("source", F.desc("score"), "id"))  # limit + 1 rows at most
    return once.select(*columns, "matched_by", place.alias("place"))
