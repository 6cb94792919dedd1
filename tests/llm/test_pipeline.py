"""The pipeline, stage by stage, on a small corpus with planted cases."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from strandline.llm import registry


@pytest.fixture(scope="module")
def corpus(spark, prose, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    passage, item = prose(777, 12), prose(888, 5)
    rows = [(i, prose(i, 20), "en", "s") for i in range(40)]
    rows += [(50, prose(1, 20).upper(), "en", "s"), (51, "12345 !!", None, "s"), (52, None, "en", "s")]
    rows += [(60, prose(300, 20) + " " + passage, "en", "s"), (61, prose(301, 20) + " " + passage, "en", "s"), (62, prose(302, 20) + "\n" + item, "en", "s")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), passage


def test_stages(spark, corpus):
    sf_dir, passage = corpus
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, sf_dir), "test")
        seen[name] = docs
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    ids = {name: {r.doc_id for r in d.select("doc_id").collect()} for name, d in seen.items()}
    clean = set(range(40))
    assert ids["language ID"] == clean | {50, 60, 61, 62}
    assert ids["SimHash near-dedup"] == clean | {60, 61, 62}
    texts = {r.doc_id: r.text for r in seen["substring dedup"].collect()}
    assert passage in texts[60] and passage[:100] not in texts[61] and texts[61].strip()
    assert {r.lang for r in seen["language ID"].collect()} == {"en"}
    assert ids["benchmark decontamination"] == clean | {60, 61} == ids["best-fit packing"]
    assert pipeline.run(spark, sf_dir).count() == seen["best-fit packing"].count()


def test_one_query_for_each_operator():
    assert [k.split("_")[0] for k in registry.QUERIES] == [f"op{n}" for n in range(1, 14)] and set(registry.ORACLE_SQL) < set(registry.QUERIES)


ODD = [(None, "a null id and a text of its own"), (None, None), (70, None), (71, ""), (72, "12 !!")]


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES], ids=[n for n, _ in pipeline.STAGES])
def test_every_stage_takes_odd_tables(spark, docs_of, corpus, prose, stage):
    """Empty, unlabelled, with null ids and texts, repeated rows and clashing columns; every row has its stated end."""
    sf_dir, _ = corpus
    none = docs_of([(1, "x")]).where("false")
    assert stage(spark, none, sf_dir).count() == 0
    rows = [(i, prose(5000 + i, 20)) for i in range(12)] + [(3, prose(5003, 20))] * 3 + ODD
    # Names that stages use themselves, a dot and a backtick in a name, and types without an order.
    docs = docs_of(rows).withColumns({"__id": F.lit(1), "__said": F.lit("x"), "__row": F.lit(2), "said": F.lit(2.5), "k0": F.lit("k"), "a.b": F.col("doc_id"), "c`d": F.lit(3), "tags": F.create_map(F.lit("k"), F.lit(1)), "list": F.array(F.create_map(F.lit("k"), F.lit(1)))})
    assert docs.where("lang is not null").isEmpty()
    out = stage(spark, docs, sf_dir)
    got = out.collect()
    if stage is pipeline.packed:
        assert len(got) == len(rows) and all(r.bin_offset + r.length <= r.bin_size for r in got)
        return
    assert out.columns == docs.columns
    kept = sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in got)
    all_ = sorted(((-1 if i is None else i), t or "") for i, t in rows)
    if stage is pipeline.first_copies:  # 70, 71 and the text without ... words are told apart by their words
        assert kept == sorted({x for x in all_ if x[0] not in (71,)})
    else:  # nothing learnt, nothing repeated, nothing leaked
        assert kept == all_


def test_language_stage_rejects_noise_in_a_labelled_corpus(spark, docs_of, prose):
    import random

    r = random.Random(1)
    noise = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(1500))
    rows = [(i, prose(i, 15), "en") for i in range(80)] + [(100, noise), (101, None), (102, "!!"), (None, prose(200, 15)), (5, prose(5, 15))]
    got = pipeline.known_language(spark, docs_of(rows), None).collect()
    assert sorted(-1 if x.doc_id is None else x.doc_id for x in got) == sorted([-1, *range(80), 5]) and {x.lang for x in got} == {"en"}
