"""Pieces that several operators share: tables in the shared folder, connected components, small Arrow helpers."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, new_path, scratch, stored

__all__ = ["Forest", "components", "discard", "new_path", "quoted", "scratch", "sliced", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as Spark's texts take it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def sliced(batches, most: int = 4 << 20):
    """Batches whose first column (text or binary) is cut so that each part holds about ``most`` bytes of it, or one row, and a part's Python objects stay few."""
    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours all move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` with long ids.

    Alternates large-star and small-star until the edge set is a fixed point,
    which takes a logarithmic number of rounds. Each round is a pre-aggregated
    minimum and a join whose hot side can be split; no component is ever
    gathered in one place. Returns ``node, component`` (smallest id reachable)
    for every node that has an edge to another; null ends are ignored.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:
        new = stored(_small_star(_large_star(now)), name)
        seen = new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        discard(now)
        now = new
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


class Forest:
    """Union-find over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if np.array_equal(nxt, up):
                return up
            up = self.up = nxt
