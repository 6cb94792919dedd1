"""Citation intents and missing abstracts from a second source, joined by DOI."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import doi
from ..sources.shared import stored_counting


@dataclass(frozen=True)
class Enriched:
    nodes: DataFrame
    edges: DataFrame
    report: DataFrame


def matches(nodes: DataFrame, works: DataFrame, refs: DataFrame, seed) -> DataFrame:
    """A row for each DOI of ``refs``: its first record, the node it is (or null) and the pair of the seed's edge.

    ``refs(doi, direction, intents, is_influential, abstract, ord)``, where
    direction is cited or citing and ord puts references before citations. A
    node is found by its own DOI, compared as its source wrote it but for the
    usual prefix, the last node of several; else by the works table. ``turn``
    is the order in which they count: what a node's own DOI found, then what
    the works table found, each by ord. Records without a DOI are one row,
    whose key is null. ``cited`` and ``citing`` say how many records a row stands for.
    """
    keyed = refs.withColumn("key", doi(F.col("doi")))
    many = [F.count_if(F.col("direction") == d).alias(d) for d in ("cited", "citing")]
    first = keyed.groupBy("key").agg(F.min_by(F.struct("direction", "intents", "is_influential", "abstract", "ord"), "ord").alias("r"), *many).select("key", "r.*", "cited", "citing")
    own = nodes.withColumn("key", F.lower(F.replace("doi", F.lit("https://doi.org/"), F.lit("")))).where("key <> ''")
    own = own.groupBy("key").agg(F.max_by("id", "ord").alias("own_id"))
    found = first.join(own, "key", "left")
    # The rest is asked of the works table, and counts only where it leads to a node.
    other = works.select(doi(F.col("doi")).alias("key"), "id").join(found.where("own_id is null").select("key"), "key", "left_semi")
    other = other.groupBy("key").agg(F.max("id").alias("id")).join(nodes.select("id"), "id", "left_semi").withColumnRenamed("id", "other_id")
    out = found.join(other, "key", "left").withColumn("node_id", F.coalesce("own_id", "other_id")).withColumn("turn", F.struct(F.col("own_id").isNull().alias("asked"), "ord")).drop("own_id", "other_id")
    cited = F.col("direction") == "cited"
    return out.withColumn("source", F.when(cited, F.lit(seed)).otherwise(F.col("node_id"))).withColumn("target", F.when(cited, F.col("node_id")).otherwise(F.lit(seed)))


def enrich(nodes: DataFrame, edges: DataFrame, works: DataFrame, refs: DataFrame, seed) -> Enriched:
    """Edges with intents and nodes with abstracts filled, as far as ``refs`` knows; the graph is never widened.

    ``nodes(id, doi, abstract, ord, ...)`` and ``edges(source, target, ord,
    ...)``. An edge is labelled only by a record with intents or the
    influential flag; others have an empty array, which says nothing was
    looked up. Where several records lead to one node, the last in turn labels
    its edge and the first with an abstract fills it. The report counts records, matched and unmatched DOIs, edges
    labelled and abstracts filled; it is a row that is there already, as each
    step is written to the shared folder and counted on the way.
    """
    keyed, found = F.col("key").isNotNull(), F.col("node_id").isNotNull()
    counts = {"references_seen": F.sum("cited"), "citations_seen": F.sum("citing"), "dois": F.count_if(keyed), "matched": F.count_if(found), "without_node": F.count_if(keyed & ~found)}
    met, n = stored_counting(matches(nodes, works, refs, seed), "matches", **counts)
    hit = met.where("node_id is not null")
    labels = hit.groupBy("source", "target").agg(F.max_by(F.struct("intents", "is_influential"), "turn").alias("l")).select("source", "target", "l.*")
    labels = labels.where("size(intents) > 0 or is_influential")
    plain = edges.drop("intents", "is_influential")
    told = (F.size("intents") > 0) | F.col("is_influential")
    out_edges = plain.join(labels, ["source", "target"], "left").select(*plain.columns, F.coalesce("intents", F.array().cast("array<string>")).alias("intents"), F.coalesce("is_influential", F.lit(False)).alias("is_influential"))
    texts = hit.where("abstract <> ''").groupBy(F.col("node_id").alias("id")).agg(F.min_by("abstract", "turn").alias("other_abstract"))
    filled = (F.coalesce(F.col("abstract"), F.lit("")) == "") & F.col("other_abstract").isNotNull()
    out_edges, labelled = stored_counting(out_edges, "labelled", n=F.count_if(told))
    both = nodes.join(texts, "id", "left").withColumn("__filled", filled)
    both = both.withColumn("abstract", F.when(F.col("__filled"), F.col("other_abstract")).otherwise(F.coalesce("abstract", F.lit(""))))
    both, written = stored_counting(both.drop("other_abstract"), "filled", n=F.count_if("__filled"))
    seen = [n[k] or 0 for k in ("references_seen", "citations_seen")]
    row = (*seen, n["matched"], n["without_node"] if n["dois"] else sum(seen), labelled["n"], written["n"])
    report = nodes.sparkSession.createDataFrame([row], "references_seen long, citations_seen long, matched long, unmatched long, edges_annotated long, abstracts_filled long")
    return Enriched(both.select(*nodes.columns), out_edges, report)
