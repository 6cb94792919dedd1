"""Near-duplicate embeddings: a small-world graph per shard, every shard searched, cosine verified, components united.

Vectors are compared within a label (and a dimension) only. Equal vectors
collapse to one representative with a weight, and each label's representatives
fall by hash into shards of about SHARD vectors. A shard's graph is built once
and stored, with a beam that an audit widened until it found every link that
brute force finds for a sample of its vectors. Each shard is then searched by
all vectors of its label, one task for each pair of shards, which audits the
beam again with a sample of those that ask and widens it for the pair. A vector
whose beam is full of links may have more, so it is compared with the whole
shard. What reaches the threshold in double precision is united within the
task, so a task emits one edge for each vector at most, however dense a group
is. Components of the edges give the groups; within a group the exact links are
counted in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored
from .hnsw import Graph

MIN_COSINE, SHARD, PROBES, TILE, ROWS = 0.93, 32768, 256, 2048, 256
#: The graph searches in single precision; what it finds this far below the threshold is still verified in double.
SLACK = 1e-4


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows, in the precision that it has."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _packed(x: np.ndarray) -> bytes:
    """Vectors as they travel: as given, single or double; ``_unpacked`` makes unit vectors of them in double precision."""
    return x.tobytes()


def _unpacked(data: bytes, n: int, dim: int) -> np.ndarray:
    kind = np.float32 if len(data) == 4 * n * dim else np.float64
    return _unit(np.frombuffer(data, kind).reshape(n, dim).astype(np.float64))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each of n rows over links i-j."""
    up = np.arange(n)
    while len(i):
        low = np.minimum(up[i], up[j])
        old = up.copy()
        np.minimum.at(up, i, low)
        np.minimum.at(up, j, low)
        np.minimum.at(up, old[i], low)
        np.minimum.at(up, old[j], low)
        up = up[up]
        if np.array_equal(up, old):
            break
    return up


def _united(up: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels as ``_labels`` gives them, with the links i-j added."""
    i, j = up[i], up[j]
    apart = i != j
    return _labels(len(up), i[apart], j[apart])[up] if apart.any() else up


def _build(table: pa.Table) -> pa.Table:
    """One shard: its ids, unit vectors, graph and audited beam."""
    ids = table["rep"].to_numpy()
    raw = _matrix(table["embedding"])
    order = np.random.default_rng(len(ids)).permutation(np.argsort(ids))
    ids, raw = ids[order], raw[order]
    x = _unit(raw.astype(np.float64))
    g = Graph.build(x.astype(np.float32))
    beam, recall = g.audited_beam(MIN_COSINE - SLACK, g.x[:: max(1, len(x) // PROBES)])
    layers = [n.tobytes() for n in g.near]
    row = {"label": table["label"][0].as_py(), "dim": x.shape[1], "shard": table["shard"][0].as_py(), "n": len(x), "beam": beam, "recall": recall, "ids": ids.tobytes(), "x": _packed(raw), "sizes": g.sizes.tolist(), "layers": layers}
    return pa.Table.from_pylist([row], schema=INDEX)


INDEX = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("shard", pa.int32()), ("n", pa.int32()), ("beam", pa.int32()), ("recall", pa.float64()), ("ids", pa.binary()), ("x", pa.binary()), ("sizes", pa.list_(pa.int64())), ("layers", pa.list_(pa.binary()))])
INDEX_SQL = "label long, dim int, shard int, n int, beam int, recall double, ids binary, x binary, sizes array<long>, layers array<binary>"


def _search(batches):
    """Pairs of shards (query ids, query vectors, index...) -> edges that span what is linked between them."""
    for b in batches:
        for r in b.to_pylist():
            q_ids, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
            q, x = _unpacked(r["q_x"], len(q_ids), r["dim"]), _unpacked(r["x"], len(ids), r["dim"])
            sizes = np.array(r["sizes"])
            near = [np.frombuffer(y, np.int32).reshape(n, -1) for y, n in zip(r["layers"], sizes)]
            g = Graph(x.astype(np.float32), sizes, near)
            beam = r["beam"]
            if r["q_shard"] != r["shard"]:  # the shard's own sample was audited when it was built
                beam, _ = g.audited_beam(MIN_COSINE - SLACK, q[:: max(1, len(q) // PROBES)].astype(np.float32), beam)
            both, full = np.concatenate([q_ids, ids]), []
            up = np.arange(len(both))
            if r["q_shard"] == r["shard"]:  # the same vectors stand on both sides
                up[len(q) :] = np.arange(len(q))
            for k in range(0, len(q), 4096):
                found, sims = g.search(q[k : k + 4096].astype(np.float32), beam)
                i, c = np.nonzero((found >= 0) & (sims >= MIN_COSINE - SLACK))
                j = found[i, c]
                i = i + k
                ok = np.einsum("ij,ij->i", q[i], x[j]) >= MIN_COSINE
                up = _united(up, i[ok], j[ok] + len(q))
                if sims.shape[1] < len(x):
                    full.append(k + np.flatnonzero(sims[:, -1] >= MIN_COSINE - SLACK))
            full = np.concatenate(full or [np.arange(0)])
            for k in range(0, len(full), ROWS):  # more links than a beam holds: against every vector of the shard
                i = full[k : k + ROWS]
                i, j = np.nonzero((q[i] @ x.T >= MIN_COSINE) & (up[i][:, None] != up[len(q) :]))
                up = _united(up, full[k + i], j + len(q))
            moved = np.flatnonzero(both != both[up])
            yield pa.RecordBatch.from_arrays([pa.array(both[moved]), pa.array(both[up[moved]])], names=["a", "b"])


def _tile(table: pa.Table) -> pa.Table:
    order = np.argsort(table["rep"].to_numpy())
    x = _matrix(table["embedding"].take(pa.array(order)))
    row = {"component": table["component"][0].as_py(), "tile": table["tile"][0].as_py(), "ids": table["rep"].to_numpy()[order].tobytes(), "weight": table["weight"].to_numpy()[order].tobytes(), "x": _packed(x), "dim": x.shape[1]}
    return pa.Table.from_pylist([row], schema=pa.schema([("component", pa.int64()), ("tile", pa.int32()), ("ids", pa.binary()), ("weight", pa.binary()), ("x", pa.binary()), ("dim", pa.int32())]))


def _count(batches):
    """Pairs of tiles -> for each vector of the first, how many of the second are linked to it."""
    for b in batches:
        for r in b.to_pylist():
            ids, weight = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["o_weight"], np.int64)
            x, y = _unpacked(r["x"], len(ids), r["dim"]), _unpacked(r["o_x"], len(weight), r["dim"])
            n = ((x @ y.T) >= MIN_COSINE) @ weight
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["rep", "n"])


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """Links and groups among ``vectors(vec_id, embedding, label)``.

    Returns ``vec_id, n_links`` (other vectors at MIN_COSINE or more),
    ``component_id`` (smallest vec_id reachable) and ``kept`` (vec_id =
    component_id), a row per vector. Only vectors of one label and dimension
    compare. A vector that is null, empty, zero or has a null or non-finite
    component, and one with a null label, links with nothing. A vec_id names
    one vector: of rows that repeat it one stays (the least by label and value).
    A row without vec_id links with nothing and gives (null, 0, null, null).
    Other columns are ignored. Vectors travel in the precision that they have.
    """
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    one = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v"))
    one = stored(one.select("vec_id", "v.label", "v.embedding"), "vectors")
    finite = F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))) & F.exists("embedding", lambda v: v != 0)
    usable = one.where("label is not null and size(embedding) > 0").where(finite)
    dim = F.size("embedding").alias("dim")
    reps = stored(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")).select("*", dim), "reps")
    many = reps.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    sharded = reps.join(many, ["label", "dim"]).select("label", "dim", F.pmod(F.xxhash64("rep"), "shards").cast("int").alias("shard"), "rep", "embedding")
    index = stored(sharded.groupBy("label", "dim", "shard").applyInArrow(_build, INDEX_SQL), "hnsw")
    asks = index.select("label", "dim", F.col("shard").alias("q_shard"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"))
    pairs = asks.join(index, ["label", "dim"])
    pairs = pairs.repartition("label", "dim", "shard", "q_shard").select("dim", "q_shard", "shard", "q_ids", "q_x", "beam", "ids", "x", "sizes", "layers")
    edges = stored(pairs.mapInArrow(_search, "a long, b long"), "vec-links")
    parts = stored(components(edges, "vec-cc"), "vec-parts")
    size = parts.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    placed = parts.join(size, "component").select(F.col("node").alias("rep"), "component", F.pmod(F.xxhash64("node"), "tiles").cast("int").alias("tile"))
    tiles = stored(reps.join(placed, "rep").select("component", "tile", "rep", "weight", "embedding").groupBy("component", "tile").applyInArrow(_tile, "component long, tile int, ids binary, weight binary, x binary, dim int"), "tiles")
    others = tiles.select("component", F.col("tile").alias("o_tile"), F.col("weight").alias("o_weight"), F.col("x").alias("o_x"))
    met = tiles.join(others, "component").repartition("component", "tile", "o_tile").select("ids", "x", "dim", "o_weight", "o_x")
    counts = met.mapInArrow(_count, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    found = reps.join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("label", "embedding", (F.coalesce("n", "weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = one.join(found, ["label", "embedding"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    unnamed = rows.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(unnamed).withColumn("kept", F.col("vec_id") == F.col("component_id"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
       least(e.vec_id, coalesce((SELECT min(r.b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce((SELECT min(r.b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) AS kept
FROM embeddings e
"""
