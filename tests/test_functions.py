import hashlib

from pyspark.sql import functions as F

from strandline.functions import ids, text, wording


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def values(spark, f, items, kind="string"):
    return [r.v for r in spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}").select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_work_id(spark):
    assert values(spark, ids.work_id, ["https://openalex.org/W12", " w12 ", "S2:ab", "", None]) == ["W12", "W12", "S2:ab", "", None]


def test_doi_prefixes_go_once_in_order(spark):
    got = values(spark, ids.doi, ["https://doi.org/10.1/A", " DOI:10.1/a", "http://doi.org/10.1/a", "https://doi.org/doi:10.1/a", "doi:https://doi.org/10.1/a", "", None, "doi:"])
    assert got == ["10.1/a", "10.1/a", "10.1/a", "10.1/a", "https://doi.org/10.1/a", None, None, None]


def test_dedupe_key_falls_through(spark):
    empty = F.create_map(F.lit("arxiv"), F.lit("X.1"))
    assert one(spark, ids.dedupe_key(F.lit("10.1/A"), empty, F.lit("W1"))) == "doi:10.1/a"
    assert one(spark, ids.dedupe_key(F.lit(""), empty, F.lit("W1"))) == "arxiv:x.1"
    assert one(spark, ids.dedupe_key(F.lit(None).cast("string"), F.create_map(F.lit("q"), F.lit("z")), F.lit("W1"))) == "id:W1"


def test_neighbour_reference(spark):
    got = values(spark, ids.neighbour_reference, ["10.1/a", "https://doi.org/10.1/a", "arXiv:2406.1", "ARXIV:2", "doi:10.1/a", "deadbeef", "doi:"])
    assert got == ["DOI:10.1/a", "DOI:10.1/a", "ARXIV:2406.1", "ARXIV:2", "DOI:10.1/a", "deadbeef", "doi:"]


def test_tokens_split_at_other_letters(spark):
    assert one(spark, text.tokens(F.lit("Naïve CAFÉ-42 x"))) == ["na", "ve", "caf", "42", "x"]
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []


def test_abstract_from_index(spark):
    rows = [({"b": [1, 3], "a": [0, 2]},), (None,), ({},), ({"start": [0], "end": [4]},)]
    got = [r.v for r in spark.createDataFrame(rows, "m map<string, array<int>>").select(text.abstract_from_index(F.col("m")).alias("v")).collect()]
    assert got == ["a b a b", "", "", "start    end"]


def test_abstract_of_two_words_at_one_place_keeps_the_later(spark):
    m = F.expr("map('x', array(0), 'y', array(0), 'z', array(1))")
    assert one(spark, text.abstract_from_index(m)) == "y z"


def test_words_to_an_index_and_back(spark, tmp_path):
    from strandline.plans.catalogue import QUERIES

    m = one(spark, text.inverted_index(F.split(F.lit("b a b c a b"), " ")))
    assert m == {"a": [1, 4], "b": [0, 2, 5], "c": [3]} and one(spark, text.inverted_index(F.array().cast("array<string>"))) == {} and one(spark, text.inverted_index(F.lit(None).cast("array<string>"))) is None
    rows = [(1, "x y\tx"), (1, "z z"), (2, None), (3, ""), (4, " \n "), (5, " lead and  gap\n")]  # a repeated doc_id, a null text
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id, r.abstract_md5) for r in QUERIES["reconstruct_abstract"](spark, str(tmp_path)).collect()), key=str)
    want = [(i, t and hashlib.md5(" ".join(t.split()).encode()).hexdigest()) if t is not None else (i, None) for i, t in rows]
    want = [(i, hashlib.md5(b"").hexdigest() if h == "" else h) for i, h in want]
    assert got == sorted(want, key=str)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", text.tokens(F.col("t")).alias("t"))


def scores(spark, corpus, query):
    return [r.s for r in corpus.select("id", text.bm25(corpus, "t", query).score(F.col("t")).alias("s")).orderBy("id").collect()]


def test_a_term_in_half_the_documents_scores_nothing(spark):
    assert scores(spark, docs(spark, "cat", "cat dog", "dog", "eel"), "cat") == [0, 0, 0, 0]


def test_negative_idf_takes_the_floor(spark):
    import math

    got = scores(spark, docs(spark, "cat", "cat", "cat", "dog"), "cat")
    mean = ((math.log(1.5) - math.log(3.5)) + (math.log(3.5) - math.log(1.5))) / 2
    assert got[3] == 0 and all(abs(g - 0.25 * mean) < 1e-9 for g in got[:3])


def test_repeated_query_terms_count_each_time(spark):
    c = docs(spark, "cat", "dog", "eel")
    assert abs(scores(spark, c, "cat cat")[0] - 2 * scores(spark, c, "cat")[0]) < 1e-12


def test_empty_corpus_and_empty_query(spark):
    assert scores(spark, docs(spark, "a").where("false"), "a") == []
    assert scores(spark, docs(spark, "a", "b"), "") == [0, 0]


def test_whole_number(spark):
    assert values(spark, wording.whole_number, ["3", " 3 ", "3.0", "+4", "-2", "x", "", None]) == [3, 3, None, 4, -2, None, None, None]
    assert values(spark, wording.importance, ["9", "0", "-1", "high", None]) == [5, 3, 1, 3, 3]
    assert values(spark, wording.valid_year, ["1999", "1499", "2101", "x"]) == [1999, None, None, None]


def test_intent_clause(spark):
    clause = lambda items, flag: one(spark, wording.intent_clause(F.array(*map(F.lit, items)).cast("array<string>"), F.lit(flag)))
    assert clause(["methodology", "result", "extends"], False) == "cited for its method, its result and extends"
    assert clause(["background"], True) == "cited for background; flagged as an influential citation"
    assert clause([], False) == ""


def test_direct_text_capitalises_like_a_sentence(spark):
    got = one(spark, wording.direct_text(F.lit(True), F.array(F.lit("USES")), F.lit(False)))
    assert got.endswith("(Cited for uses.)")


def test_labels(spark):
    label = lambda title, authors, year: one(spark, wording.short_label(F.lit(title), F.array(*map(F.lit, authors)).cast("array<string>"), F.lit(year).cast("int")))
    assert label("t", ["Ada Lovelace", "B"], 1843) == "Lovelace et al. 1843"
    assert label("t", ["Ada"], None) == "t"
    assert label("x" * 43, [], 2000) == "x" * 41 + "…"


def test_cut_abstract_drops_the_broken_word(spark):
    got = one(spark, wording.cut_abstract(F.lit("word " * 100)))
    assert len(got) <= 321 and got.endswith("word…")


def test_script_safe_and_paragraphs(spark):
    assert one(spark, wording.script_safe(F.lit("a</script>"))) == "a<\\/script>"
    assert one(spark, wording.paragraphs(F.lit("a\n \n b \n\n\n"))) == ["a", "b"]


def test_session_tokens(spark):
    import hashlib
    import hmac

    from strandline.functions import accounts

    for secret in ("s", "k" * 100):
        good = "7.1000." + hmac.new(secret.encode(), b"7.1000", hashlib.sha256).hexdigest()
        odd = {good: 7, good + "0": None, "8" + good[1:]: None, "7.1000": None, "": None, "x.1000." + good[7:]: None, good + ".x": None}
        df = spark.createDataFrame([(t,) for t in odd], "t string")
        said = df.select("t", accounts.session_user(F.col("t"), F.lit(1500), secret).alias("u"), accounts.session_user(F.col("t"), F.lit(1000 + 31 * 24 * 3600), secret).alias("late"), accounts.session_token(F.lit(7), F.lit(1000), secret).alias("own")).collect()
        assert {r.t: r.u for r in said} == odd and {r.late for r in said} == {None} and {r.own for r in said} == {good}
