"""What is stored and grows: the works cache, the BM25 index; and titles that are alike."""

import json
import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators import index, lookup, titles
from strandline.sources import cache
from strandline.sources.manifest import Conflict, Manifest

WORK = "id string, title string"


def rows(spark, *pairs):
    return spark.createDataFrame(pairs, WORK)


def held(spark, folder):
    return sorted(map(tuple, cache.read(spark, folder, "S", WORK).collect()))


@pytest.mark.parametrize("step", ["works", "filter", "manifest", "rename"])
def test_a_writer_that_is_stopped_leaves_the_cache_as_it_was(spark, tmp_path, monkeypatch, step):
    folder = str(tmp_path)
    cache.save(rows(spark, ("a", "1"), ("b", "1")), folder, "S")

    def stop(*a, **k):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        if step == "works":
            m.setattr(cache, "_write", stop)
        elif step == "filter":
            m.setattr(cache, "_places", stop)
        elif step == "manifest":
            m.setattr(Manifest, "add", stop)
        else:  # the list is written, and not yet in place
            m.setattr(Manifest, "commit", lambda self, after, segments: (Path(self.folder, "_manifests", f".{after + 1}.tmp").write_text("[]"), stop()))
        with pytest.raises(KeyboardInterrupt):
            cache.save(rows(spark, ("b", "2"), ("c", "2")), folder, "S")
    assert held(spark, folder) == [("a", "1"), ("b", "1")]
    cache.save(rows(spark, ("b", "3")), folder, "S")
    assert held(spark, folder) == [("a", "1"), ("b", "3")]
    cache.vacuum(spark, folder, "S", older_than_s=0)
    assert held(spark, folder) == [("a", "1"), ("b", "3")] and len(list((tmp_path / "S").glob("segment-*"))) == 2


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    folder, meanwhile = str(tmp_path), [lambda: cache.save(rows(spark, ("b", "other"), ("x", "other")), folder, "S")]
    commit = Manifest.commit

    def late(self, after, segments):
        if meanwhile:  # another writer is done between this one's reading and renaming
            meanwhile.pop()()
        return commit(self, after, segments)

    cache.save(rows(spark, ("a", "1")), folder, "S")
    monkeypatch.setattr(Manifest, "commit", late)
    cache.save(rows(spark, ("b", "mine"), ("c", "mine")), folder, "S")
    assert held(spark, folder) == [("a", "1"), ("b", "mine"), ("c", "mine"), ("x", "other")]
    with pytest.raises(Conflict):
        Manifest(spark, f"{folder}/S").commit(1, [])
    # A compaction keeps what is saved while it runs, as newer; of two only one counts.
    meanwhile.append(lambda: cache.save(rows(spark, ("a", "2")), folder, "S"))
    assert cache.compact(spark, folder, "S", WORK)
    assert held(spark, folder) == [("a", "2"), ("b", "mine"), ("c", "mine"), ("x", "other")] and len(Manifest(spark, f"{folder}/S").read()[1]) == 2
    meanwhile.append(lambda: cache.compact(spark, folder, "S", WORK))
    assert not cache.compact(spark, folder, "S", WORK) and len(Manifest(spark, f"{folder}/S").read()[1]) == 1
    assert cache.vacuum(spark, folder, "S", older_than_s=3600) == [] and cache.vacuum(spark, folder, "S", older_than_s=0) != []
    assert held(spark, folder) == [("a", "2"), ("b", "mine"), ("c", "mine"), ("x", "other")]


def test_a_lookup_reads_only_segments_that_can_hold_its_ids(spark, tmp_path):
    folder, ids = str(tmp_path), "id long, title string"
    for k in range(4):  # one after another, and one between all of them
        cache.save(spark.range(k * 1000, k * 1000 + 500).select("id", F.lit(str(k)).alias("title")), folder, "S")
    cache.save(spark.range(0, 4000, 40).select((F.col("id") + 7).alias("id"), F.lit("sparse").alias("title")), folder, "S")
    cache.save(spark.createDataFrame([(None, "no id")], ids), folder, "S")
    keys = spark.createDataFrame([(1003,), (1004,), (1004,), (None,), (777_777,), (2600,)], "id long")
    found = cache.segments_for(spark, f"{folder}", "S", keys)
    assert 1 in [k for k, _ in found] and not {0, 2, 3} & {k for k, _ in found}
    for path in (tmp_path / "S").glob("segment-*"):  # the others could as well be gone
        if str(path) not in {s["path"] for _, s in found}:
            shutil.rmtree(path / "works")
    assert sorted(map(tuple, cache.lookup(spark, folder, "S", ids, keys).collect())) == [(1003, "1"), (1004, "1")]
    assert cache.lookup(spark, folder, "S", ids, keys.where("id = 2600")).count() == 0 or len(found) == 2
    assert cache.lookup(spark, folder, "none", ids, keys).count() == 0


# The index


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    texts = [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(200)], k=r.choice([0, 3, 20, 60])))) for i in range(600)]
    return spark.createDataFrame(texts, "id long, text string").select("id", text.tokens(F.col("text")).alias("tokens")).persist()


def plain_search(corpus, query, limit):
    stats = text.bm25(corpus, "tokens", query)
    return [tuple(x) for x in corpus.select("id", F.round(stats.score(F.col("tokens")), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit).collect()]


QUERIES = ["w150 w3 w3", "w0", "w0 w1 w199", "nothing known", "", "w190 w191"]


def test_an_index_that_grows_gives_what_a_search_of_texts_gives(spark, tmp_path, corpus, monkeypatch):
    monkeypatch.setattr(index, "FIRST", 3)
    folder = str(tmp_path / "i")
    search = lambda q, n: [(r.id, abs(r.score)) for r in index.search(spark, folder, q, n).collect()]
    plain = lambda c, q, n: [(i, abs(x)) for i, x in plain_search(c, q, n)]
    assert index.search(spark, folder, "w1").count() == 0
    assert index.add(corpus.where("id < 250"), folder, stripe=16, buckets=8)
    for q in QUERIES:
        assert search(q, 12) == plain(corpus.where("id < 250"), q, 12), q
    assert index.add(corpus.where("id >= 200"), folder, stripe=16, buckets=8) and not index.add(corpus, folder)
    assert [s["n"] for s in Manifest(spark, folder).read()[1]] == [250, 350]
    for q in QUERIES:
        assert search(q, 12) == plain(corpus, q, 12), q
    assert index.compact(spark, folder) and len(Manifest(spark, folder).read()[1]) == 1
    for q in QUERIES[:3]:
        assert search(q, 700) == plain(corpus, q, 700), q


def test_words_and_postings_move_once(spark, tmp_path):
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def moved():
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    word = F.concat(F.lit("w"), F.pmod(F.xxhash64("id", "k"), F.lit(5000)).cast("string"))
    corpus = spark.range(4000).select("id", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("k")).select("id", word.alias("w")).groupBy("id").agg(F.sort_array(F.collect_list("w")).alias("tokens"))
    corpus.write.parquet(str(tmp_path / "corpus"))
    corpus = spark.read.parquet(str(tmp_path / "corpus"))
    twice = corpus.unionAll(corpus.where("id < 100")).unionAll(corpus.where("id < 50").select("id", F.array(F.lit("other")).alias("tokens")))
    before = moved()
    assert index.add(twice, str(tmp_path / "i"))
    assert moved() - before < 4_000_000, moved() - before  # twice, it is 4.6 MB
    (segment,) = Manifest(spark, str(tmp_path / "i")).read()[1]
    posted = index._postings(spark, [segment]).select(F.explode("held").alias("d")).select("d.*")
    sizes = {r.id: r.size for r in spark.read.parquet(f"{segment['path']}/documents").collect()}
    assert segment["n"] == len(sizes) == 4000 and segment["words"] == sum(sizes.values())
    assert {r.id: r.n for r in posted.groupBy("id").agg(F.sum("f").alias("n")).collect()} == sizes


def test_a_query_opens_the_buckets_of_its_terms_alone(spark, tmp_path, corpus):
    folder = str(tmp_path / "i")
    index.add(corpus, folder, stripe=64, buckets=16)
    want = plain_search(corpus, "w150 w30", 5)
    asked = {spark.createDataFrame([(t,)], "t string").select(index._bucket(F.col("t"), 16)).first()[0] for t in ("w150", "w30")}
    for path in Path(folder).glob("segment-*/postings/bucket=*"):
        if int(path.name.split("=")[1]) not in asked:
            shutil.rmtree(path)
    assert [tuple(r) for r in index.search(spark, folder, "w150 w30", 5).collect()] == want


def test_stripes_that_cannot_reach_the_result_are_not_scored(spark, tmp_path, corpus, monkeypatch):
    monkeypatch.setattr(index, "FIRST", 2)
    folder = str(tmp_path / "i")
    index.add(corpus, folder, stripe=8, buckets=4)
    plan = index.search(spark, folder, "w199 w120", 1)._jdf.queryExecution().executedPlan().toString()
    assert "bound" in plan  # the second read is cut by the bound of the first
    assert [tuple(r) for r in index.search(spark, folder, "w199 w120", 1).collect()] == plain_search(corpus, "w199 w120", 1)


# Titles


def test_titles_alike_are_all_pairs(spark):
    r = random.Random(8)
    base = [" ".join(r.choice(["deep", "learning", "ring", "of", "graphs", "attention", "is", "a"]) for _ in range(r.choice([1, 3, 6, 9]))) for _ in range(60)]

    def wrong(t):
        k = r.randrange(len(t) + 1)
        return r.choice([t, t[:k] + t[k + 1 :], t[:k] + "z" + t[k:], t.upper(), t + " now", t + "!"])

    works = [(i, t) for i, t in enumerate(base + [wrong(t) for t in base] + ["a", "ab", "", "!!", "a", None])]
    asked = [(i, wrong(t)) for i, t in enumerate(base)] + [(100, ""), (101, None), (102, "A"), (103, "ab."), (103, "ab.")]

    def grams(t):
        import re

        s = " ".join(re.findall("[a-z0-9]+", (t or "").lower()))
        return {s[i : i + 3] for i in range(len(s) - 2)} if len(s) >= 3 else ({s} if s else set())

    for least in (0.5, 0.8, 1.0):
        want = sorted((a, b, round(len(x & y) / len(x | y), 9)) for a, s in asked for b, t in works if (x := grams(s)) and (y := grams(t)) and len(x & y) / len(x | y) >= least)
        got = titles.alike(spark.createDataFrame(asked, WORK.replace("id string", "id long")), spark.createDataFrame(works, "id long, title string"), least)
        assert sorted((x.asked_id, x.id, round(x.similarity, 9)) for x in got.collect()) == want
    assert titles.alike(spark.createDataFrame(asked, "id long, title string").where("false"), spark.createDataFrame(works, "id long, title string")).count() == 0


def test_titles_meet_as_maps_and_not_as_lists_of_grams(spark):
    words = [f"{a}{b} " for a in ("red", "blue", "tiny", "green") for b in ("ring", "bolt", "gear", "plate")]
    works = spark.range(400).select("id", F.concat(*(F.element_at(F.array(*map(F.lit, words)), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(words))).cast("int") + 1) for k in range(5))).alias("title"))
    texts = works.select(titles.plain(F.col("title")).alias("text")).distinct().withColumn("g", titles.grams(F.col("text")))
    rows = titles._prefixes(texts, texts.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("c")), 0.8)
    assert not [k for _, k in rows.dtypes if k.startswith("array")]
    assert rows.select(sum(F.bit_count(f"map{k}") for k in range(titles.MAPS)).alias("bits"), "n").where("bits > n or bits = 0").count() == 0
    plain = {r.id: set(r.g) for r in works.select("id", titles.grams(titles.plain(F.col("title"))).alias("g")).collect()}
    want = sorted((i, j) for i in plain for j in plain if i % 10 == 0 and len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j]))
    assert sorted((r.asked_id, r.id) for r in titles.alike(works.where("id % 10 = 0"), works).collect()) == want and len(want) > 40


def test_a_misspelt_title_is_found_and_another_is_not(spark):
    works = spark.createDataFrame([("a", "Attention Is All You Need", 9), ("b", "Attention is all you need!", 5), ("c", "Attention is all you heed", 99), ("d", "Rings", 1)], "id string, title string, cited_by_count long")
    one = lambda q: [r.id for r in lookup.title_match(works, q).collect()]
    assert one("attention is all you need") == ["a"] and one("Atention is all you need") == ["a"] and one("attention is all you heed") == ["c"]
    assert one("something else") == [] and one("") == [] and one("ring") == []


def test_lists_of_grams_are_made_of_titles_that_can_match_alone(spark):
    texts = ["tiny red ring", "tiny red rings", "Tiny, red ring", "red ring tiny", "ring", "ab", "a", "", None, "tiny red ring of the ancient widget", "tny red ring"]
    works = spark.createDataFrame([(i, t, i % 4) for i, t in enumerate(texts)], "id long, title string, cited_by_count long")
    sets = {r.id: (r.t, set(r.g)) for r in works.select("id", titles.plain(F.col("title")).alias("t"), titles.grams(titles.plain(F.col("title"))).alias("g")).collect()}
    for query in [*filter(None, texts), "tiny red rink", "AB!", "b", "nothing"]:
        own, g = works.sparkSession.range(1).select(titles.plain(F.lit(query)), titles.grams(titles.plain(F.lit(query)))).first()
        for least in (0.3, 0.8):
            like = {i: (t == own, len(x & set(g)) / len(x | set(g)), i % 4, -i) for i, (t, x) in sets.items()}
            want = max((v for v in like.values() if v[0] or v[1] >= least), default=None)
            assert [r.id for r in lookup.title_match(works, query, least).collect()] == ([-want[3]] if want else []), (query, least)
    plan = lookup.title_match(works, "tiny red ring")._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" in plan and "[tin,iny,ny ," in plan, plan  # the query's grams are a constant


def test_documents_are_seen_all_at_once(spark, tmp_path):
    from strandline.sources import documents

    folder, rows = str(tmp_path / "d"), lambda *r: spark.createDataFrame(list(r), "name string, text string, value int")
    read = lambda: {r.name: r.text for r in documents.load(spark, folder).collect()}
    assert read() == {}
    documents.save(rows(("a/b 1", "x\ny\n", 1), ("c", "", 2), ("c", "", 3), (None, "z", 4), ("d", None, 5), ("\u00e9=", "\n", 6)), folder)
    assert read() == {"a/b 1": "x\ny\n", "c": "", "\u00e9=": "\n"}
    bad = rows(("c", "new", 1), ("e", "e", 2)).withColumn("text", F.when(F.col("name") == "e", F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no"):
        documents.save(bad, folder)
    assert read()["c"] == "" and "e" not in read()
    documents.save(rows(("c", "new", 1)), folder)
    assert read()["c"] == "new" and len(read()) == 3
    documents.save(rows(("only", "1", 1)), folder, replace=True)
    assert read() == {"only": "1"}


def test_neighbourhoods_of_odd_seeds(spark):
    from strandline.plans.lineage import neighbourhoods

    works = spark.createDataFrame([("S", 1, "s"), ("A", 5, None), ("B", 7, "b"), ("L", 0, "l")], "id string, cited_by_count long, title string")
    cites = spark.createDataFrame([("S", "A"), ("S", "B"), ("A", "S"), ("S", "S"), ("S", "unknown"), (None, "S")], "src string, tgt string")
    seeds = spark.createDataFrame([("S",), ("S",), ("L",), ("none",), (None,)], "id string")
    got = {r.name: json.loads(r.text) for r in neighbourhoods(works, cites, seeds, 5).collect()}
    assert set(got) == {"S", "L"} and [n["id"] for n in got["S"]["nodes"]] == ["S", "B", "A"] and [n["hop"] for n in got["S"]["nodes"]] == [0, 1, 1]
    assert got["S"]["edges"] == [{"source": "S", "target": "B"}, {"source": "S", "target": "A"}, {"source": "A", "target": "S"}]
    assert got["L"]["edges"] == [] and [n["id"] for n in got["L"]["nodes"]] == ["L"]
    assert neighbourhoods(works, cites, seeds.where("false")).count() == 0
