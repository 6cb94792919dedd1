"""How a kept work connects to the seed, in a sentence or two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import wording as W


def relationships(nodes: DataFrame, edges: DataFrame, seed) -> DataFrame:
    """``id, relationship, kind`` of ``nodes(id, title, hop)`` over ``edges(source, target, ord, intents, is_influential)``.

    kind is seed, direct (the first edge with the seed), bridge (the first edge
    to a node with one) or none. Self-citations don't connect.
    """
    is_seed = lambda c: F.col(c) == F.lit(seed)
    both = edges.where("source <> target")
    touching = both.where(is_seed("source") | is_seed("target")).withColumn("id", F.when(is_seed("source"), F.col("target")).otherwise(F.col("source")))
    direct = touching.groupBy("id").agg(F.min_by(F.struct(is_seed("source").alias("from_seed"), "intents", "is_influential"), "ord").alias("d")).select("id", "d.*")
    titles = nodes.select("id", "title")
    bridges = direct.join(titles, "id").select(F.col("id").alias("bridge"), F.col("title").alias("bridge_title"), "from_seed")
    legs = both.where(~is_seed("source") & ~is_seed("target"))
    ways = legs.select(F.col("source").alias("id"), F.col("target").alias("bridge"), F.lit(True).alias("cites"), "ord").unionByName(legs.select(F.col("target").alias("id"), F.col("source").alias("bridge"), F.lit(False).alias("cites"), "ord"))
    ways = ways.join(direct.select("id"), "id", "left_anti").join(bridges, "bridge")
    first = ways.groupBy("id").agg(F.min_by(F.struct("bridge_title", "from_seed", "cites"), "ord").alias("b"))
    all_ = nodes.select("id", "title", "hop").join(direct, "id", "left").join(first, "id", "left")
    leg1 = W.edge_phrase(F.col("b.cites"), F.col("title"), F.col("b.bridge_title"))
    leg2 = W.edge_phrase(~F.col("b.from_seed"), F.col("b.bridge_title"), F.lit("the seed paper"))
    text = F.when(is_seed("id"), W.SEED_TEXT).when(F.col("from_seed").isNotNull(), W.direct_text(F.col("from_seed"), F.col("intents"), F.col("is_influential")))
    text = text.when(F.col("b").isNotNull(), W.bridge_text(F.col("b.bridge_title"), leg1, leg2)).otherwise(W.fallback_text(F.col("hop")))
    kind = F.when(is_seed("id"), "seed").when(F.col("from_seed").isNotNull(), "direct").when(F.col("b").isNotNull(), "bridge").otherwise("none")
    return all_.select("id", text.alias("relationship"), kind.alias("kind"))
