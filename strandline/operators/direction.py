"""Where a work stands to the seed: by citations upstream, downstream, both or neither."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, stored, stored_counting

#: Works of a level up to which it is sent to the citations, which then stay where they are.
FEW = 200_000
#: Edges that one task walks, at most.
CAPPED = 1_000_000
#: Seeds that are numbered together.
BLOCKS = 64 * 1024


def _walked(edges: DataFrame, seed) -> DataFrame:
    """``reached`` in one task."""
    text = dict(edges.dtypes)["source"] == "string"

    def walk(batches):
        ways = (defaultdict(list), defaultdict(list))
        for b in batches:
            for a, c in zip(*(x.to_pylist() for x in b.columns)):
                if a is not None and c is not None:
                    ways[0][a].append(c)
                    ways[1][c].append(a)
        for up, way in ((True, ways[0]), (False, ways[1])):
            met, front = {seed}, [seed]
            while front:
                front = [x for x in dict.fromkeys(y for at in front for y in way[at]) if x not in met]
                met.update(front)
            ids = pa.array([x for x in met if x != seed], pa.string() if text else pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array([up] * len(ids), pa.bool_())], names=["id", "up"])

    return edges.select("source", "target").coalesce(1).mapInArrow(walk, f"id {'string' if text else 'long'}, up boolean")


def _walk(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each seed reaches, as bits: ``id, up, block, seen``, and the seeds' own bits: ``seed, block, bit``.

    All seeds walk together, breadth first; a work has a row for each direction
    and block of 64 seeds, however many of them reach it. A level is one scan of
    the citations, which are written down once with the step each can be taken
    for, and one grouping of what it brings with what is known, after which only
    bits that are new walk on. A level's new rows are counted as it is written;
    up to FEW they are sent to the citations, beyond that both are dealt by key.
    """
    kind = dict(edges.dtypes)["source"]
    known = edges.where("source is not null and target is not null")
    ways = F.array(F.struct(F.col("source").alias("at"), F.col("target").alias("to"), F.lit(True).alias("way")), F.struct(F.col("target").alias("at"), F.col("source").alias("to"), F.lit(False).alias("way")))
    steps = stored(known.select(F.explode(ways).alias("s")).select("s.*"), "steps")
    asked, counted = stored_counting(seeds.where("id is not null").select(F.col("id").cast(kind).alias("seed")).distinct(), "seeds", n=F.count(F.lit(1)))
    # Few partitions, as a block's seeds come from one; written down, as numbers of rows are not the same each time.
    numbered = asked.repartition(counted["n"] // BLOCKS + 1).select("seed", F.monotonically_increasing_id().alias("k"))
    bits = stored(numbered.select("seed", F.expr("k div 64").alias("block"), (F.col("k") % 64).cast("int").alias("bit")), "seed-bits")
    own = F.expr("shiftleft(1L, bit)")
    rows = bits.select(F.col("seed").alias("id"), F.explode(F.array(F.lit(True), F.lit(False))).alias("up"), "block", own.alias("seen"), own.alias("new"))
    state, counts = stored_counting(rows, "reached", n=F.count(F.lit(1)))
    nothing = F.lit(0).cast("long")
    while counts["n"]:
        front = state.where("new <> 0").select("id", F.col("up").alias("way"), "block", "new")
        come = steps.join(F.broadcast(front) if counts["n"] <= FEW else front, (F.col("at") == F.col("id")) & (steps["way"] == front["way"])).select(F.col("to").alias("id"), steps["way"].alias("up"), "block", nothing.alias("seen"), F.col("new").alias("came"))
        both = state.select("id", "up", "block", "seen", nothing.alias("came")).unionAll(come).groupBy("id", "up", "block").agg(F.bit_or("seen").alias("seen"), F.bit_or("came").alias("came"))
        before = state
        new = F.col("came").bitwiseAND(F.bitwise_not("seen"))
        state, counts = stored_counting(both.select("id", "up", "block", F.col("seen").bitwiseOR(F.col("came")).alias("seen"), new.alias("new")), "reached", n=F.count_if(F.col("new") != 0))
        discard(before)
    return state.select("id", "up", "block", "seen"), bits


def _each(rows: DataFrame, bits: DataFrame, mask: str) -> DataFrame:
    """``rows`` for each seed whose bit their ``mask`` has, but for the seed itself."""
    return rows.join(bits, "block").where((F.col(mask).bitwiseAND(F.expr("shiftleft(1L, bit)")) != 0) & (F.col("id") != F.col("seed")))


def reached_from(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``seed, id, up`` for each of ``seeds(id)``: what it cites (up) and what cites it, over any number of steps; cycles end by themselves."""
    state, bits = _walk(edges, seeds)
    return _each(state, bits, "seen").select("seed", "id", "up")


def reached(edges: DataFrame, seed, capped: bool = False) -> DataFrame:
    """``id, up``: what one seed cites (up) and what cites it, as ``reached_from`` finds it.

    The edges of an expansion, which its caps bound, are ``capped``: one task
    walks them, without a job for each level, if there are no more than CAPPED.
    """
    if capped and edges.limit(CAPPED + 1).count() <= CAPPED:
        return _walked(edges, seed)
    return reached_from(edges, edges.sparkSession.range(1).select(F.lit(seed).alias("id"))).select("id", "up")


def _direction() -> Column:
    return F.when(F.col("up") & F.col("down"), "mixed").when(F.col("up"), "ancestor").when(F.col("down"), "descendant").otherwise("unrelated")


def classify(nodes: DataFrame, edges: DataFrame, seed, capped: bool = False) -> DataFrame:
    """``id, direction`` of every node but the seed: ancestor, descendant, mixed or unrelated; ``capped`` as in ``reached``."""
    sides = reached(edges, seed, capped).groupBy("id").agg(F.bool_or("up").alias("up"), F.bool_or(~F.col("up")).alias("down"))
    return nodes.where(F.col("id") != F.lit(seed)).select("id").join(sides, "id", "left").select("id", _direction().alias("direction"))


def classify_from(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``seed, id, direction`` for each of ``seeds(id)`` and every work that it is related to."""
    state, bits = _walk(edges, seeds)
    nothing = F.lit(0).cast("long")
    way = lambda up: F.bit_or(F.when(F.col("up") == F.lit(up), F.col("seen")).otherwise(nothing))
    sides = state.groupBy("id", "block").agg(way(True).alias("ups"), way(False).alias("downs")).withColumn("met", F.col("ups").bitwiseOR(F.col("downs")))
    has = lambda mask: F.col(mask).bitwiseAND(F.expr("shiftleft(1L, bit)")) != 0
    return _each(sides, bits, "met").withColumns({"up": has("ups"), "down": has("downs")}).select("seed", "id", _direction().alias("direction"))


def seed_edge_intents(edges: DataFrame, seed) -> DataFrame:
    """``id, intent``: what the citation between the seed and a neighbour was for; the last labelled edge counts."""
    touching = edges.where((F.col("source") == F.lit(seed)) | (F.col("target") == F.lit(seed)))
    words = F.concat("intents", F.when(F.col("is_influential"), F.array(F.lit("influential"))).otherwise(F.array().cast("array<string>")))
    other = F.when(F.col("source") == F.lit(seed), F.col("target")).otherwise(F.col("source"))
    told = touching.select(other.alias("id"), words.alias("words"), "ord").where(F.size("words") > 0)
    return told.groupBy("id").agg(F.array_join(F.max_by("words", "ord"), ", ").alias("intent"))
