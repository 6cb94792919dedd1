"""Two-hop expansion of a seed, capped for each work and in all.

Rows that have an order in the traversal carry it in ``ord``; ties always
resolve by it, never by where a row happens to be.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


@dataclass(frozen=True)
class Caps:
    """Works in all (the seed among them), neighbours of a work in each direction, and how too many neighbours are cut."""

    total: int = 500
    fanout: int = 100
    strategy: str = "top_cited"
    sample_seed: int = 0


@dataclass(frozen=True)
class Expansion:
    """``nodes(id, hop, cited_by_count, ord)``, ``edges(source, target, ord)`` and, once counted, whether the total cap refused a work."""

    nodes: DataFrame
    edges: DataFrame
    refused: DataFrame


def _numbered(few: DataFrame, *order) -> DataFrame:
    """``few`` rows (a limit stands before) with their place in ``order`` as ``ord``, from 0."""
    return few.withColumn("ord", F.row_number().over(Window.orderBy(*order)) - 1)


def neighbours(parents: DataFrame, works: DataFrame, cites: DataFrame, caps: Caps) -> DataFrame:
    """Candidates ``parent, id, backward, cited_by_count, ord`` of ``parents(id, ord)``, fan-out cut.

    A parent's references come first, then what cites it. Works that have no
    record are dropped. References are in the order of ``cites.pos`` unless
    they are over the cap, where the most cited stay, most cited first; what
    cites a work always comes most cited first.
    """
    few = F.broadcast(parents.select(F.col("id").alias("parent"), F.col("ord").alias("parent_ord")))  # a total cap stands before
    back = cites.join(few, cites.src == F.col("parent")).select("parent", "parent_ord", F.col("tgt").alias("id"), F.lit(0).alias("side"), "pos")
    ahead = cites.join(few, cites.tgt == F.col("parent")).select("parent", "parent_ord", F.col("src").alias("id"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("pos"))
    both = back.unionByName(ahead).join(works.select("id", "cited_by_count"), "id")
    group = Window.partitionBy("parent", "side")
    if caps.strategy == "random":
        by = [F.md5(F.concat_ws(":", "id", F.lit(caps.sample_seed))), F.col("id")]
    else:
        by = [F.desc("cited_by_count"), F.col("pos"), F.col("id")]
    # One row more than the cap tells whether there are too many; the planner cuts groups before it sorts them.
    cut = both.withColumn("rank", F.row_number().over(group.orderBy(*by))).where(F.col("rank") <= caps.fanout + 1)
    cut = cut.withColumn("over", F.count(F.lit(1)).over(group) > caps.fanout).where(F.col("rank") <= caps.fanout)
    cut = cut.withColumn("rank", F.when((F.col("side") == 0) & ~F.col("over"), F.col("pos")).otherwise(F.col("rank").cast("long")))
    order = F.struct("parent_ord", "side", "rank", "id")
    return cut.select("parent", "id", (F.col("side") == 0).alias("backward"), "cited_by_count", order.alias("ord"))


def _admit(nodes: DataFrame, candidates: DataFrame, hop: int, caps: Caps, already: int) -> tuple[DataFrame, DataFrame]:
    """The new works that the total cap lets in, the most cited first, and how many were refused."""
    new = candidates.join(F.broadcast(nodes.select("id")), "id", "left_anti")
    first = new.groupBy("id").agg(F.min("ord").alias("at"), F.first("cited_by_count").alias("cited_by_count"))
    room = max(0, caps.total - already)
    let_in = first.orderBy(F.desc("cited_by_count"), "at").limit(room)
    let_in = _numbered(let_in, F.desc("cited_by_count"), F.col("at")).select("id", F.lit(hop).alias("hop"), "cited_by_count", (F.col("ord") + already).cast("long").alias("ord"))
    return let_in, first.agg(F.greatest(F.count(F.lit(1)) - room, F.lit(0)).alias("refused"))


def expand(works: DataFrame, cites: DataFrame, seed, caps: Caps = Caps()) -> Expansion:
    """The seed, its neighbours and theirs.

    ``works(id, cited_by_count)``; ``cites(src, tgt, pos)`` where src cites tgt
    as its reference number pos. A work keeps its earliest hop. Edges are those
    met on the way between admitted works, so a self-citation or a citation
    of the seed counts too. The frontier is capped, so it is the broadcast side;
    the citation table is read, never shuffled, before its rows are cut to it.
    """
    nodes = stored(works.where(F.col("id") == F.lit(seed)).limit(1).select("id", F.lit(0).alias("hop"), "cited_by_count", F.lit(0).cast("long").alias("ord")), "nodes")
    parents, edges, refused, already = nodes, None, None, nodes.count()
    for hop in (1, 2):
        # Both are capped by now; written down, they keep the plans of the next hop and of whoever reads the result small.
        met = stored(neighbours(parents, works, cites, caps), "met")
        let_in, no = _admit(nodes, met, hop, caps, already)
        let_in = stored(let_in, "let-in")
        already += let_in.count()
        nodes = nodes.unionByName(let_in)
        inside = met.join(F.broadcast(nodes.select("id")), "id", "left_semi")
        pair = inside.select(F.when(F.col("backward"), F.col("parent")).otherwise(F.col("id")).alias("source"), F.when(F.col("backward"), F.col("id")).otherwise(F.col("parent")).alias("target"), F.struct(F.lit(hop).alias("hop"), "ord").alias("at"))
        edges = pair if edges is None else edges.unionByName(pair)
        refused = no if refused is None else refused.unionByName(no)
        parents = let_in
    edges = edges.groupBy("source", "target").agg(F.min("at").alias("at"))
    edges = _numbered(edges.orderBy("at").limit(4 * caps.total * caps.fanout + caps.total), F.col("at")).select("source", "target", F.col("ord").cast("long").alias("ord"))
    return Expansion(nodes, stored(edges, "edges"), refused.agg((F.sum("refused") > 0).alias("truncated")))
