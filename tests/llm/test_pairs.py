"""Near-duplicates by fingerprint, repeated spans and vectors, against brute force."""

import random

import duckdb
import numpy as np
import pytest
import xxhash

from strandline.llm import embedding, simhash, substring
from strandline.llm.common import Forest, components
from strandline.llm.hnsw import Graph


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", "  \n", "one", "One TWO three", "a b c d", "É\u00a0x É y z ÉA", "w " * 3000, "a b c d e f g h i j" * 40])
def test_fingerprint_is_the_plain_one(text):
    got = simhash.fingerprints([text if text is None else text.encode()])[0]
    assert int(got) % (1 << 64) == plain_fingerprint(text)


def test_spark_hashes_words_alike(spark):
    assert spark.sql("select xxhash64('a b c d') v").first().v % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def grouped(fps, ids):
    f = Forest(len(fps))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                f.join(i, j)
    low = {}
    for k, r in enumerate(f.roots()):
        low[r] = min(low.get(r, 1 << 62), ids[k])
    return {ids[k]: low[r] for k, r in enumerate(f.roots())}


def test_links_find_every_group(spark):
    r = random.Random(1)
    fps = {r.getrandbits(64) for _ in range(400)}
    for base in list(fps)[:60]:  # chains and dense balls
        for _ in range(r.choice([1, 3, 30])):
            for b in r.sample(range(64), r.choice([1, 2, 4, 5, 8])):
                base ^= 1 << b
            fps.add(base)
    fps = sorted(fps)
    ids = r.sample(range(10_000), len(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(zip(signed, ids)), "fp long, rep long")
    want, tallies = grouped(fps, ids), [spark.sparkContext.accumulator(0) for _ in range(3)]
    for hot in (simhash.HOT, 5):  # with every list of more than five dealt again
        got = {i: i for i in ids} | {x.node: x.component for x in components(simhash.links(df, tallies, hot)).collect()}
        assert got == want
    met, dropped, verified = (t.value for t in tallies)
    assert met == dropped + verified and dropped and verified


def test_a_list_with_one_triple_for_all_is_tallied(spark):
    r = random.Random(9)
    fps = [0xABCDEF]  # three bytes alike in all, five that differ
    for _ in range(900):
        base = r.choice(fps) if r.random() < 0.7 else r.getrandbits(40) << 24 | 0xABCDEF
        for b in r.sample(range(24, 64), r.randrange(1, 6)):
            base ^= 1 << b
        fps.append(base)
    fps = sorted(set(fps))
    ids, signed = list(range(len(fps))), [f - (1 << 64) if f >> 63 else f for f in fps]
    df, want = spark.createDataFrame(list(zip(signed, ids)), "fp long, rep long"), grouped(fps, ids)
    for hot in (simhash.HOT, 100):
        tallies = [spark.sparkContext.accumulator(0) for _ in range(3)]
        assert {i: i for i in ids} | {x.node: x.component for x in components(simhash.links(df, tallies, hot)).collect()} == want
        assert hot < 1000 or tallies[1].value > tallies[2].value  # most pairs share too few bytes and are never verified


def test_near_duplicates_of_odd_rows(docs_of, prose):
    a = prose(1, 60)
    rows = [(5, a), (3, a.upper()), (9, a.replace("42", "43", 1)), (4, prose(2)), (4, prose(2)), (None, a), (7, None), (8, ""), (6, " \n")]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    assert len(got) == len(rows)
    of = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert of[(5, f"{plain_fingerprint(a):016x}")] == 3 and of[(3, f"{plain_fingerprint(a):016x}")] == 3 and of[(None, f"{plain_fingerprint(a):016x}")] == 3
    assert {r.component_id for r in got if r.doc_id in (6, 7, 8)} == {6} and of[(7, "0" * 16)] == 6
    kept = simhash.keep_first(docs_of(rows))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.count() == 4 and kept.columns == docs_of(rows).columns and ids.count(3) == ids.count(4) == ids.count(6) == ids.count(None) == 1 and not {5, 7, 8} & set(ids)


def test_the_row_that_stays_is_always_the_same(spark, prose):
    a, b = prose(1, 40), prose(2, 40)
    rows = [(7, a, "x", 2), (7, a, "x", 1), (7, a, None, 3), (7, b, "y", 0), (3, b, "z", 0), (9, a, "q", 0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, source string, n_chars int").repartition(3)
        assert sorted(tuple(r) for r in simhash.keep_first(df).collect()) == [(3, b, "z", 0), (7, a, None, 3)]


def test_empty_tables(spark, docs_of):
    none = docs_of([(1, "x")]).where("false")
    assert simhash.near_duplicates(none).count() == 0 and substring.without_repeats(none).count() == 0
    assert embedding.near_duplicates(vectors(spark, []).where("false")).count() == 0


def test_components_on_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 400), (400, 450), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 400, 400: 400, 450: 400}


def cleaned(df):
    return {r.doc_id: (r.text, r.n_removed) for r in substring.without_repeats(df).collect()}


def test_a_passage_stays_once(docs_of, prose):
    p = prose(0, 10)
    got = cleaned(docs_of([(1, prose(1) + " " + p), (2, prose(2) + "\n" + p + " " + prose(3)), (3, prose(4)), (4, p.upper())]))
    assert got[1] == (prose(1) + " " + p, 0) and got[2] == (prose(2) + "\n" + prose(3), 10) and got[3] == (prose(4), 0) and got[4] == ("", 10)


def test_a_passage_without_stops_and_a_long_sentence(docs_of):
    p = " ".join(f"w{i}" for i in range(60))
    got = cleaned(docs_of([(1, "Start here. " + p), (2, "Other one.\n" + p + ".")]))
    assert got[1][1] == 0 and "w30" not in got[2][0] and got[2][0].startswith("Other one.")


@pytest.mark.parametrize("n", [51, 70])
def test_the_pipeline_cuts_a_passage_at_any_offset(spark, docs_of, n):
    import corpus_pipeline

    r = random.Random(n)
    passages = [" ".join(f"p{k}x{r.randrange(10**6)}" for _ in range(n)) for k in range(25)]
    host = lambda k, words: " ".join(f"h{k}x{r.randrange(10**6)}" for _ in range(words))
    rows = [(k, f"Start. {host(k, 3)} {p}  {host(k, 40)}.") for k, p in enumerate(passages)]
    rows += [(100 + k, f"{host(k, 40)}. {host(k, 4 + k)} {p.upper()}\t{host(k, 9)}") for k, p in enumerate(passages)]
    got = {x.doc_id: x.text for x in corpus_pipeline.without_repeats(spark, docs_of(rows), None).collect()}
    for i, text in rows:
        if i < 100:
            assert got[i] == text
        else:
            p = passages[i - 100].upper().split()
            left = [w in got[i] for w in p]
            assert left.count(False) >= 20 and not any(left[22 : n - 22]) and [w for w in got[i].split() if w not in p] == [w for w in text.split() if w not in p]


def test_aligned_pieces_give_the_text(prose):
    for text in (b"", b"w " * 100, b" a\n" + b"x\t y  " * 40 + b". Z", prose(5, 9).replace(".", "").encode()):
        assert b"".join(substring.sentences(text)) == text and len(substring.sentences(text)) >= len(text) // 200


def test_odd_rows_stay(docs_of, prose):
    rows = [(1, None), (2, ""), (3, "Yes. No."), (4, "Yes. No."), (None, prose(9)), (5, prose(9)), (5, prose(9))]
    out = substring.without_repeats(docs_of(rows))
    assert out.columns == [*docs_of(rows).columns, "n_sentences", "n_removed"]
    got = out.collect()
    assert len(got) == 7 and sum(r.n_removed for r in got) == 0  # short texts have no run; repeated rows are one document
    assert {r.n_chars for r in got if r.doc_id == 1} == {None}


def test_a_repeat_within_one_text_goes(docs_of, prose):
    p = prose(3, 4)
    assert cleaned(docs_of([(1, p + " " + p)]))[1] == (p + " ", 4)


def test_two_texts_of_one_id_keep_their_own_sentences(docs_of, prose):
    shared, own = prose(1, 6), prose(2, 6)
    rows = [(1, shared), (2, shared + "\n" + prose(3)), (2, own), (2, own), (3, prose(4) + "\n" + prose(5)), (3, prose(5))]
    got = sorted((r.doc_id, r.text, r.n_removed) for r in substring.without_repeats(docs_of(rows)).collect())
    texts = {t for i, t, _ in got if i == 3}
    assert got[:4] == sorted([(1, shared, 0), (2, prose(3), 6), (2, own, 0), (2, own, 0)])
    assert texts in ({prose(4) + "\n" + prose(5), ""}, {prose(4) + "\n", prose(5)})  # one of the two texts comes first


def test_many_repeats_of_one_row_and_very_long_texts(docs_of, prose):
    long = " ".join(prose(k, 50) for k in range(300))
    got = substring.without_repeats(docs_of([(1, long), (2, long), *[(3, prose(5, 20))] * 400])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got if r.doc_id < 3) == [(1, 0), (2, 15_000)]
    assert {r.n_removed for r in got if r.doc_id == 3} == {20} and len(got) == 402


def test_columns_with_clashing_names_stay(spark, prose):
    df = spark.createDataFrame([(1, prose(1), "a", 7, 8, "k"), (2, prose(1), "b", 7, 8, "k")], "doc_id long, text string, said string, first int, n int, k0 string")
    got = sorted(tuple(r) for r in substring.without_repeats(df).collect())
    assert got == [(1, prose(1), "a", 7, 8, "k", 8, 0), (2, "", "b", 7, 8, "k", 8, 8)]


def test_substring_matches_sql(spark, docs_of, prose):
    r = random.Random(4)
    blocks = [prose(n, r.randrange(1, 6)) for n in range(12)] + [" ".join(f"x{i}" for i in range(70)), "..! ?", "\n\n \n"]
    rows = [(i, r.choice([" ", "\n"]).join(r.choice(blocks) for _ in range(r.randrange(0, 6)))) for i in range(60)]
    got = sorted((x.doc_id, x.text, x.n_sentences, x.n_removed) for x in substring.without_repeats(docs_of(rows)).collect())
    documents = docs_of(rows).toPandas()  # noqa: F841  read by name
    assert got == sorted(duckdb.sql(substring.SQL).fetchall())


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, 1) for i, v, k in rows], "vec_id long, embedding array<float>, label int, rep int")


def brute(rows):
    out = {}
    for i, v, k in rows:
        a = np.array(v, float)
        near = [j for j, w, m in rows if j != i and m == k and np.array(w, float) @ a / np.linalg.norm(a) / np.linalg.norm(np.array(w, float)) >= 0.93]
        out[i] = near
    comp = {}
    for i in sorted(out):
        if i not in comp:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in comp:
                    comp[j] = i
                    todo += out[j]
    return {i: (len(out[i]), comp[i]) for i in out}


@pytest.mark.parametrize("shard", [embedding.SHARD, 40])
def test_vectors_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(embedding, "SHARD", shard)
    monkeypatch.setattr(embedding, "TILE", 16)
    rng = np.random.default_rng(0)
    rows, base = [], rng.normal(size=(30, 16))
    for i in range(400):
        c = base[rng.integers(30)] if i % 3 else rng.normal(size=16)
        rows.append((i, np.float32(c + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.3, 0.45])).tolist(), int(i % 2)))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_duplicates(vectors(spark, rows)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize(("m", "shard"), [(100, 90), (300, embedding.SHARD), (300, 250), (1000, 700)])
def test_two_dense_balls_are_one_group_with_all_links(spark, monkeypatch, m, shard):
    """Each ball alone fills a beam; every vector of one ball links with many of the other."""
    monkeypatch.setattr(embedding, "SHARD", shard)
    rng = np.random.default_rng(m)
    a, b = np.zeros(64), np.zeros(64)
    a[0], b[:2] = 1, (0.945, (1 - 0.945**2) ** 0.5)
    x = np.float32(np.concatenate([np.repeat([a, b], m, 0) + 0.012 * rng.normal(size=(2 * m, 64)), rng.normal(size=(600, 64))]))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_duplicates(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.93
    assert link[:m, m : 2 * m].any() and not link[2 * m :, : 2 * m].any()
    assert all(got[i] == (link[i].sum() - 1, 0) for i in range(2 * m)) and all(got[i] == (0, i) for i in range(2 * m, len(x)))


def test_an_audit_widens_a_beam_that_misses_links():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 24))
    q = x[::10] + 0.25 * rng.normal(size=(300, 24))
    x, q = ((v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32) for v in (x[rng.permutation(3000)], q))
    g = Graph.build(x)
    g.near[0][:, 3:] = -1  # a poor graph
    assert g.audited_beam(0.8, q, 4, 0.0)[1] < 0.95
    beam, recall = g.audited_beam(0.8, q, 4, 0.99)
    assert beam > 4 and recall >= 0.99 or beam == 3000


def test_dense_groups_that_fill_a_beam_are_linked(spark):
    rng = np.random.default_rng(3)
    a, b = np.zeros(16), np.zeros(16)
    a[0], b[:2] = 1, (0.947, (1 - 0.947**2) ** 0.5)
    rows = [(i, np.float32((b if i % 2 else a) + 0.004 * rng.normal(size=16)).tolist(), 0) for i in range(200)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_duplicates(vectors(spark, rows)).collect()}
    assert got == brute(rows) == {i: (199, 0) for i in range(200)}


def test_odd_vectors_link_with_nothing(spark):
    v = [1.0, 2.0]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, [2.0, 4.0], 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [], 0), (8, [0.0, 0.0], 0), (9, [1.0, None], 0), (10, [float("nan"), 1.0], 0), (11, [float("inf"), 1.0], 0), (12, [1.0, 2.0, 0.0], 0), (None, v, 0), (None, v, 0)]
    rows_out = embedding.near_duplicates(vectors(spark, rows)).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows_out}
    assert len(rows_out) == 14
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False) and got[None] == (0, None, None)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)) and len(got) == 13


def test_graph_recall():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 32))
    x[2000:] = x[:2000] + 0.05 * rng.normal(size=(2000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)[rng.permutation(4000)]
    g = Graph.build(x)
    beam, recall = g.audited_beam(0.93, x[::16])
    exact = x @ x.T >= 0.93
    ids, sims = g.search(x, beam)
    found = sum(int((sims[i] >= 0.93).sum()) for i in range(4000))
    assert recall >= 0.9 and found / exact.sum() >= 0.9


def test_a_list_that_shares_four_bytes_is_dealt_again(spark):
    """Long lists of every depth against all pairs."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 24, 500).astype(np.uint64)
    far = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 32, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 32, 500).astype(np.uint64)) for _ in range(2))])
    fps = np.unique(np.concatenate([(far << np.uint64(8)) | np.uint64(0xAB00000000000011), far << np.uint64(32), rng.integers(0, 1 << 63, 200).astype(np.uint64)]))
    forest = Forest(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4):
            forest.join(i, i + 1 + int(j))
    want = forest.roots().tolist()
    rows = spark.createDataFrame([(int(f), k) for k, f in enumerate(fps.view(np.int64))], "fp long, rep long")
    got = list(range(len(fps)))
    for r in components(simhash.links(rows, hot=20)).collect():
        got[r.node] = r.component
    assert got == want and len(set(want)) < len(fps)
