"""Which works of an expansion are kept: by BM25, or by a curator's reply."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bm25, document_text, tokens
from ..functions.wording import clean_text, importance, valid_role, whole_number

#: Fixed values of the curated graph.
OTHER, OTHER_NAME, SEED_WHY = "other", "Other related work", "The seed paper this map is built around."
REPLY = "struct<clusters:array<struct<id:string,name:string,role:string,summary:string>>,keep:array<map<string,string>>,dropped_summary:string>"


@dataclass(frozen=True)
class Graph:
    """``nodes`` with score, rank and annotations, ``edges`` between them, ``clusters`` in order; how they were chosen, and the story told of them."""

    nodes: DataFrame
    edges: DataFrame
    clusters: DataFrame | None = None
    curation: str = "bm25"
    notes: str = ""
    story: dict | None = None


def scored(nodes: DataFrame, idea: str) -> DataFrame:
    """``nodes(title, abstract, ...)`` with ``score``: BM25 within these nodes, the seed among them, to six decimals."""
    corpus = nodes.withColumn("__tokens", tokens(document_text(F.col("title"), F.col("abstract"))))
    stats = bm25(corpus, "__tokens", idea)
    return corpus.withColumn("score", F.round(stats.score(F.col("__tokens")), 6)).drop("__tokens")


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends in ``kept(id)``."""
    ids = kept.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def filter_by_idea(nodes: DataFrame, edges: DataFrame, seed, idea: str, top_k: int = 40) -> Graph:
    """The seed and the ``top_k`` best others, best first (``rank`` from 1), ties in order of arrival; zero scores rank too.

    Edges keep their ends only: intents are not carried over here.
    """
    known = scored(nodes, idea)
    best = known.where(F.col("id") != F.lit(seed)).orderBy(F.desc("score"), "ord").limit(top_k)
    kept = best.unionByName(known.where(F.col("id") == F.lit(seed)))
    kept = kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ord")))  # top_k + 1 rows at most
    return Graph(kept, induced(edges.select("source", "target", "ord"), kept))


def prefilter(nodes: DataFrame, directions: DataFrame, intents: DataFrame, seed, idea: str, limit: int) -> DataFrame:
    """Candidates for a curator: the ``limit`` best by score and citations, numbered from 1, with direction and seed intent."""
    best = scored(nodes, idea).where(F.col("id") != F.lit(seed)).orderBy(F.desc("score"), F.desc("cited_by_count"), "ord").limit(limit)
    best = best.withColumn("index", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("cited_by_count"), "ord")))  # limit rows
    # There are limit rows of these, so they are sent to what is known of any number of works, not the other way round.
    asked = F.broadcast(best.select("id"))
    out = best.join(directions.join(asked, "id", "left_semi"), "id", "left").join(intents.join(asked, "id", "left_semi"), "id", "left")
    return out.withColumn("direction", F.coalesce("direction", F.lit("unrelated"))).withColumn("intent", F.coalesce("intent", F.lit("")))


def clusters_of(reply: DataFrame, column: str = "reply") -> DataFrame:
    """``id, name, role, summary, ord`` of a curator's JSON reply; a repeated id keeps its first place and its last words."""
    rows = reply.select(F.posexplode(F.from_json(column, REPLY)["clusters"]).alias("at", "c")).select("at", clean_text(F.col("c.id")).alias("id"), clean_text(F.col("c.name")).alias("name"), valid_role(F.coalesce(F.col("c.role"), F.lit(""))).alias("role"), F.coalesce(clean_text(F.col("c.summary")), F.lit("")).alias("summary"))
    rows = rows.where("id is not null and name is not null")
    return rows.groupBy("id").agg(F.max_by(F.struct("name", "role", "summary"), "at").alias("c"), F.min("at").alias("ord")).select("id", "c.*", "ord")


def kept_of(reply: DataFrame, candidates: DataFrame, clusters: DataFrame, column: str = "reply") -> DataFrame:
    """The candidates that a reply keeps, by ``i``, or ``index`` where that isn't there at all: unknown numbers are dropped, of repeated ones the first counts, undefined clusters become ``other``."""
    rows = reply.select(F.posexplode(F.from_json(column, REPLY)["keep"]).alias("at", "k"))
    rows = rows.select("at", whole_number(F.when(F.map_contains_key("k", F.lit("i")), F.col("k.i")).otherwise(F.col("k.index"))).alias("index"), F.coalesce(clean_text(F.col("k.cluster")), F.lit(OTHER)).alias("cluster"), importance(F.col("k.importance")).alias("importance"), F.coalesce(clean_text(F.col("k.why")), F.lit("")).alias("why"))
    first = rows.where("index is not null").groupBy("index").agg(F.min_by(F.struct("at", "cluster", "importance", "why"), "at").alias("k")).select("index", "k.*")
    named = clusters.select(F.col("id").alias("cluster_id"))
    return candidates.join(first, "index").join(named, F.col("cluster") == F.col("cluster_id"), "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(OTHER))).drop("cluster")


def curated(nodes: DataFrame, edges: DataFrame, candidates: DataFrame, reply: DataFrame, seed, max_nodes: int = 35) -> Graph:
    """The seed first, then the kept by importance and score, ``max_nodes`` at most; edges keep their intents.

    Clusters are those with a kept work, in the reply's order, and ``other`` last.
    """
    clusters = clusters_of(reply)
    kept = kept_of(reply, candidates, clusters).orderBy(F.desc("importance"), F.desc("score"), "at").limit(max_nodes)
    kept = kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), F.desc("score"), "at")) + 1)  # max_nodes rows
    columns = [*nodes.columns, "score", "cluster_id", "importance", "why", "rank"]
    first = nodes.where(F.col("id") == F.lit(seed)).withColumns({"score": F.lit(0.0), "cluster_id": F.lit(None).cast("string"), "importance": F.lit(5), "why": F.lit(SEED_WHY), "rank": F.lit(1)})
    all_nodes = first.select(columns).unionByName(kept.select(columns))
    used = all_nodes.select(F.col("cluster_id").alias("id")).where("id is not null").distinct()
    spare = used.where(F.col("id") == OTHER).join(clusters.select("id"), "id", "left_anti").select("id", F.lit(OTHER_NAME).alias("name"), F.lit("contemporary").alias("role"), F.lit("").alias("summary"), F.lit(1 << 30).alias("ord"))
    return Graph(all_nodes, induced(edges, all_nodes), clusters.join(used, "id", "left_semi").unionByName(spare), "llm")
