"""The drawn graph: collapsed clusters become one node, parallel citations one edge; and display payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wording as W

#: Fixed values of the drawing.
WIDTH, WIDER, WIDEST = 1.5, 0.9, 7.0


def visible(nodes: DataFrame, expanded: list[str] = ()) -> DataFrame:
    """``id, shown``: the node itself, or its cluster unless that is in ``expanded``."""
    hidden = (F.col("cluster_id") != "") & ~F.col("cluster_id").isin(list(expanded)) if expanded else F.col("cluster_id") != ""
    return nodes.select("id", F.when(hidden, F.concat(F.lit("cluster:"), "cluster_id")).otherwise(F.col("id").cast("string")).alias("shown"))


def contracted(edges: DataFrame, nodes: DataFrame, expanded: list[str] = ()) -> DataFrame:
    """``from, to, weight, width, label`` between what is visible; drawn from the cited to the citing; loops are dropped."""
    shown = visible(nodes, expanded)
    ends = edges.join(shown.select(F.col("id").alias("target"), F.col("shown").alias("from")), "target").join(shown.select(F.col("id").alias("source"), F.col("shown").alias("to")), "source")
    out = ends.where(F.col("from") != F.col("to")).groupBy("from", "to").agg(F.count(F.lit(1)).alias("weight"))
    return out.select("from", "to", "weight", F.least(WIDTH + (F.col("weight") - 1) * F.lit(WIDER), F.lit(WIDEST)).alias("width"), F.when(F.col("weight") > 1, F.col("weight").cast("string")).alias("label"))


def edge_payload(edges: DataFrame) -> DataFrame:
    """``from`` the cited ``to`` the citing: the way an idea went."""
    return edges.select(F.col("target").alias("from"), F.col("source").alias("to"))


def node_payload(nodes: DataFrame, seed, position: DataFrame, relationship: DataFrame, intents: DataFrame) -> DataFrame:
    """All that a node is drawn with: nodes with score, why, cluster and importance, joined to their texts and place."""
    is_seed: Column = F.col("id") == F.lit(seed)
    all_ = nodes.join(position, "id").join(relationship.select("id", "relationship"), "id", "left").join(intents, "id", "left")
    none = F.lit("(no abstract available)")
    return all_.select(
        "id",
        W.short_label(F.col("title"), F.col("authors"), F.col("publication_year")).alias("label"),
        "title",
        F.when(F.col("abstract") != "", F.col("abstract")).otherwise(none).alias("abstract"),
        "authors", "venue", "publication_year", "cited_by_count", "doi", "hop", "score",
        is_seed.alias("is_seed"),
        "relationship", "why", "cluster_id", "importance",
        F.coalesce("intent", F.lit("")).alias("intents"),
        "x", "y",
        F.when(is_seed, W.SEED_COLOUR).otherwise(W.hop_colour(F.col("hop"))).alias("background"),
        F.when(is_seed, W.SEED_BORDER).otherwise(W.BORDER).alias("border"),
        W.node_size(F.col("cited_by_count")).alias("size"),
        F.when(is_seed, 3.0).otherwise(1.5).alias("border_width"),
        F.when(is_seed, 13).otherwise(11).alias("font_size"),
    )
