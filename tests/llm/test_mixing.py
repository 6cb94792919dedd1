"""Mixing against plain Python: targets, blocks, passes, shards."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.llm import mixing

SCHEMA = "doc_id long, text string, source string, no int, size int, target string, shard double, `a.b` map<string,int>"


@pytest.fixture(scope="session")
def sourced(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, s, 1, 2, "x", 3.0, {"k": 1}) for i, t, s in rows], SCHEMA)

    return make


def rows_of(seed, n=200, sources=("b", "a", None, "é", "c", "d")):
    r = random.Random(seed)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(r.choice([0, 1, 3, 20, 90, 400]))), r.choice(sources)) for i in range(n)]
    rows += [(7, None, "a"), (None, "no id\tat all", "b"), (None, "no id\tat all", "b"), (3, "", None), (3, "", None), (5, "x " * 3000, "c"), (n, " \x0b\f ", "empty")]
    return rows


def targets(sizes, weights, share, repeats):
    """Shared out again and again until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, at_cap = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in at_cap]
        budget = left - sum(repeats * sizes[s] for s in at_cap)
        got = {s: budget * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if got[s] > repeats * sizes[s]}
        if not above:
            return got | {s: repeats * sizes[s] for s in at_cap}
        at_cap |= above


@pytest.mark.parametrize("seed", [1])
def test_mix_is_whole_blocks_in_shares(sourced, seed):
    rows = rows_of(seed)
    m = mixing.mix(sourced(rows), block=16, shard=64, seed=seed)
    got = m.taken().collect()
    size = lambda t: len((t or "").split())
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((i, size(t), s) for i, t, s in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = targets(sizes, (5, 2, 1), 1.5, 2)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 32 for s in want)
    # Every slot is one whole block: its pieces lie side by side, and equal blocks hold equal pieces.
    pieces, blocks, slots = m.pieces().collect(), {}, defaultdict(list)
    for p in pieces:
        slots[p.shard, p.turn, p.no, p.block].append((p.offset, p.n_words, p.bucket, p.nth, p.copy, p.first_word))
    for (_, _, no, block), parts in slots.items():
        parts.sort()
        ends = [at + n for at, n, *_ in parts]
        assert [x[0] for x in parts] == [0, *ends[:-1]] and blocks.setdefault((no, block), parts) == parts
        assert ends[-1] == 16 or block == max(b for n, b in blocks if n == no)
    times = Counter((no, block) for _, _, no, block in slots)
    assert max(times.values()) <= 2
    per_shard = Counter(k[0] for k in slots)
    assert all(n == 64 for k, n in per_shard.items() if k != max(per_shard))
    # The words themselves: no document's word comes more often than its taken passes allow.
    by_doc = Counter(w for r in m.texts().collect() for w in r.text.split())
    whole = Counter(w for _, t, _ in rows for w in (t or "").split())
    assert sum(by_doc.values()) == sum(taken.values()) and all(by_doc[w] <= 2 * whole[w] for w in by_doc)
    again = mixing.mix(sourced(rows[::-1]).repartition(7), block=16, shard=64, seed=seed).taken()
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_permutation_is_one_and_scatters(spark):
    def sent(n, salt):
        rows = spark.range(n).select("id", F.col("id").alias("x"), F.lit(n).cast("long").alias("n"))
        return [r.x for r in mixing.permuted(rows, "x", "n", [F.lit(salt)]).collect()]

    for n in (1, 2, 3, 17, 1000):
        got = sent(n, 5)
        assert sorted(got) == list(range(n))
    assert sum(a == b for a, b in zip(got, sent(1000, 6))) < 10 and sum(a == i for i, a in enumerate(got)) < 10
    assert 0.3 < sum(a < b for a, b in zip(got, got[1:])) / 999 < 0.7


def test_running_sums_and_intervals(spark, monkeypatch):
    monkeypatch.setattr(mixing, "A_RUN", 4)
    rows = [(g, i, (i * 7) % 5) for g in range(3) for i in range(0, 30, g + 1)]
    got = mixing.running(spark.createDataFrame(rows, "g int, i long, v long"), ["g"], "i", "v", "s").collect()
    assert all(r.s == sum(v for g, i, v in rows if g == r.g and i < r.i) for r in got) and len(got) == len(rows)
    cuts = [0, 1, 1, 50, 51, 400, 1000]
    intervals = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))], "k int, lo long, hi long")
    found = mixing.located(spark.range(1000), "id", intervals, 1000, 6).collect()
    assert len(found) == 1000 and all(cuts[r.k] <= r.id < cuts[r.k + 1] for r in found)


def test_shards_are_drawn_by_weight(sourced):
    m = mixing.mix(sourced([(i, "a b c d " * 30, "ab"[i % 2]) for i in range(400)]), weights=(3, 1), share=1.0, block=4, shard=200)
    by = Counter((r.shard, r.no) for r in m.pieces().select("shard", "turn", "no", "block").distinct().collect())
    shares = [by[k, 0] / 200 for k in {s for s, _ in by}][:-1]
    assert all(0.55 < x < 0.92 for x in shares) and len(set(shares)) > 5  # drawn, not dealt


def test_a_given_table_of_weights_and_odd_tables(spark, sourced):
    rows = [(i, "a b c d " * 10, s) for i, s in enumerate(["x", "y", None, "z"] * 20)]
    weights = spark.createDataFrame([("x", 1.0), (None, 3.0), ("z", 0.0)], "source string, weight double")
    got = {r.source: (r.target, r.t) for r in mixing.mix(sourced(rows), weights, share=0.4, block=8).taken().groupBy("source", "target").agg(F.sum("taken").alias("t")).collect()}
    assert got == {"x": (320.0, 320), "y": (0.0, 0), None: (960.0, 960), "z": (0.0, 0)}
    for none in (sourced(rows).where("false"), sourced([(1, None, "a"), (2, "", None)])):
        assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(none).taken().collect()) and mixing.mix(none).texts().count() == 0
    same = mixing.mix(sourced([(None, "same words here", "a")] * 500 + [(1, "other", "b")]), block=8).taken()
    assert same.count() == 501 and same.agg(F.max("taken")).first()[0] <= 6
