import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strandline.operators import prompts, throttle
from strandline.plans import lineage
from strandline.sources import records
from strandline.streaming import login


def raw(spark, *payloads):
    return spark.createDataFrame([(p if isinstance(p, str) else json.dumps(p),) for p in payloads], "raw string")


def test_bare_record_takes_defaults(spark):
    r = records.works_from_json(raw(spark, {"id": "https://openalex.org/w1"}, "not json"), "raw").collect()
    assert len(r) == 1 and (r[0].id, r[0].title, r[0].cited_by_count, r[0].authors, r[0].abstract, r[0].external_ids) == ("W1", "(untitled)", 0, [], "", {})


def test_full_record(spark):
    p = {"id": "W1", "title": "t", "publication_year": 2020, "cited_by_count": None, "authorships": [{"author": {"display_name": "A"}}, {"author": {}}], "primary_location": {"source": {"display_name": "V"}, "landing_page_url": "https://arxiv.org/abs/2406.1"}, "doi": "https://doi.org/10.1/Q", "ids": {"mag": "7"}, "referenced_works": ["https://openalex.org/W2"], "abstract_inverted_index": {"b": [1], "a": [0]}}
    r = records.works_from_json(raw(spark, p), "raw").first()
    assert (r.title, r.authors, r.venue, r.referenced_works, r.abstract) == ("t", ["A"], "V", ["W2"], "a b")
    assert r.external_ids == {"doi": "10.1/q", "mag": "7", "arxiv": "2406.1"}


def test_neighbours_skip_what_has_no_id(spark):
    p = {"data": [{"intents": ["background", " "], "isInfluential": True, "citedPaper": {"paperId": "x", "externalIds": {"DOI": "10.1/A", "ArXiv": ""}, "title": None}}, {"citedPaper": {"paperId": ""}}, {"citedPaper": None}]}
    r = records.neighbours_from_json(raw(spark, p), "raw", "citedPaper").collect()
    assert [(x.id, x.title, x.doi, x.intents, x.is_influential, x.external_ids) for x in r] == [("S2:x", "(untitled)", "https://doi.org/10.1/A", ["background"], True, {"doi": "10.1/A"})]


def test_old_graph_files_take_defaults(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"seed_id": "S", "nodes": [{"id": "S"}], "edges": [{"source": "S", "target": "S"}]}))
    g = records.read_graph(spark, str(tmp_path / "g.json"))
    assert g["meta"].first().curation == "bm25" and g["nodes"].first().hop == 0 and g["edges"].first().intents == []


def attempts(spark, rows):
    return spark.createDataFrame(rows, "key long, s long, id long, failed boolean").select("key", F.timestamp_seconds("s").alias("ts"), "id", "failed")


RUN = [(1, 0, 0, True), (1, 10, 1, True), (1, 20, 2, True), (1, 30, 3, False), (1, 61, 4, False), (1, 62, 5, True), (2, 0, 6, True)]


def decided(df):
    return {r.id: r.blocked for r in df.collect()}


def test_a_blocked_attempt_is_not_recorded_and_the_far_end_counts(spark):
    got = decided(throttle.login_decisions(attempts(spark, RUN), 60, 2))
    assert got == {0: False, 1: False, 2: True, 3: True, 4: False, 5: False, 6: False}
    assert decided(throttle.login_decisions(attempts(spark, [(1, 0, 0, True), (1, 60, 1, True)]), 60, 1)) == {0: False, 1: True}


def test_the_stream_decides_alike(spark, tmp_path):
    attempts(spark, RUN).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(attempts(spark, RUN).schema).parquet(str(tmp_path / "in"))
    q = login.login_decisions(stream, 60, 2).writeStream.format("memory").queryName("said").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert decided(spark.table("said")) == decided(throttle.login_decisions(attempts(spark, RUN), 60, 2))


def test_a_keys_state_ends(spark, tmp_path):
    rows = lambda *r: attempts(spark, [(*x,) for x in r])
    schema = rows((1, 0, 0, True)).schema

    def run(batch):
        batch.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        said = login.login_decisions(stream, 60, 2, late="10 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        said.trigger(availableNow=True).start().awaitTermination()
        states = spark.read.format("statestore").load(str(tmp_path / "c")).select("key.key").collect()
        return {r.key for r in states}, {r.id: r.blocked for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    # A success leaves no state; what is kept goes on after a restart, up to a whole window later.
    assert run(rows((1, 0, 0, True), (2, 0, 1, True), (2, 1, 2, False), (3, 1, 3, True), (1, 2, 4, True)))[0] == {1, 3}
    kept, said = run(rows((1, 60, 5, True), (4, 60, 6, True)))
    assert kept == {1, 3, 4} and said[5]
    # The watermark, ten seconds behind 200, is a window past all but the new key's failure.
    kept, said = run(rows((5, 200, 7, True)))
    assert kept == {5} and not said[7]
    kept, said = run(rows((1, 200, 8, True), (1, 5, 9, True)))
    assert not said[8] and 9 not in said


def test_windowed_failures_stream(spark, tmp_path):
    attempts(spark, RUN).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(attempts(spark, RUN).schema).parquet(str(tmp_path / "in"))
    q = login.failures_per_window(stream).writeStream.format("memory").queryName("fails").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert {r.key: r.n for r in spark.table("fails").collect()} == {1: 4, 2: 1}


def test_spacing(spark):
    got = {r.id: (r.gap_s, r.wait_s) for r in throttle.spacing(attempts(spark, RUN), 15).collect()}
    assert got[0] == (None, 0) and got[1] == (10, 5) and got[4] == (31, 0)


@pytest.mark.parametrize("reply", ['{"a": 1}', '```json\n{"a": 1}\n```', 'Sure: {"a": 1} done', '```\n{"a": 1}\n```'])
def test_json_is_found_in_a_reply(reply):
    assert prompts.json_object(reply) == {"a": 1}


@pytest.mark.parametrize("reply", ["no", "[1]", "{broken", ""])
def test_a_reply_without_an_object_is_an_error(reply):
    with pytest.raises(prompts.ReplyError):
        prompts.json_object(reply)


def tiny(spark):
    rows = [("S", "seed small ring", "", 2010, 1, ["A B"], "V", "10.1/s"), ("R", "small ring", "", 2000, 5, ["C"], "V", "10.1/r"), ("F", "other", "", 2020, 2, [], None, None)]
    w = spark.createDataFrame(rows, "id string, title string, abstract string, publication_year int, cited_by_count long, authors array<string>, venue string, doi string")
    c = spark.createDataFrame([("S", "R", 0), ("F", "S", 0)], "src string, tgt string, pos long")
    refs = spark.createDataFrame([("10.1/r", "cited", ["methodology"], True, "text", 0)], "doi string, direction string, intents array<string>, is_influential boolean, abstract string, ord long")
    return w, c, refs


def test_fallback_ladder(spark):
    w, c, refs = tiny(spark)
    said = []
    g = lineage.curated_lineage(w, c, refs, "S", "small ring", None, warn=said.append)
    assert g.clusters is None and len(said) == 1
    g = lineage.curated_lineage(w, c, refs, "S", "small ring", lambda m: "no idea", warn=said.append)
    assert g.clusters is None and len(said) == 2
    with pytest.raises(prompts.ReplyError):
        lineage.curated_lineage(w, c, refs, "S", "small ring", lambda m: "no idea", mode="llm")
    with pytest.raises(prompts.ReplyError):
        lineage.curated_lineage(w, c, refs, "S", "small ring", lambda m: '{"keep": []}', mode="llm")


def test_curated_run_narrative_and_page(spark, tmp_path):
    w, c, refs = tiny(spark)
    seen = []

    def chat(messages):
        seen.append(messages[1]["content"])
        if "candidates:" in messages[1]["content"]:
            return '{"clusters": [{"id": "a", "name": "Roots", "role": "ancestor"}], "keep": [{"i": 1, "cluster": "a", "importance": 4, "why": "</script>"}], "dropped_summary": "rest"}'
        return '{"headline": "h", "overview": "o", "beats": [{"title": "t", "text": "x", "papers": [1, 9, 1]}]}'

    g = lineage.curated_lineage(w, c, refs, "S", "small ring", chat)
    assert "[1] (ancestor, citation intent: methodology, influential) small ring (C, 2000, 5 citations)" in seen[0]
    assert g.story == {"headline": "h", "overview": "o", "beats": [{"title": "t", "text": "x", "node_ids": ["R"]}]} and g.notes == "rest"
    doc = lineage.graph_json(g, "S", "small ring", 1).first().json
    assert "</script>" not in doc
    back = json.loads(doc.replace("<\\/", "</"))
    assert [n["id"] for n in back["nodes"]] == ["S", "R"] and back["edges"][0]["intents"] == ["methodology"] and back["clusters"][0]["name"] == "Roots"
    assert back["narrative"]["beats"][0]["node_ids"] == ["R"] and back["curation"] == "llm" and back["curation_notes"] == "rest"
    page = lineage.page(g, "S", "small ring", 1, "A <title>")
    assert page.count("<circle") == 3 and "A &lt;title&gt;" in page and "across 1 concept clusters" in page  # two works and their cluster
    lineage.write_text(spark, str(tmp_path / "g.json"), doc)
    back, seed, idea, top_k = lineage.load_graph(spark, str(tmp_path / "g.json"))
    assert (seed, idea, top_k) == ("S", "small ring", 1) and back.story["beats"][0]["node_ids"] == ["R"] and lineage.page(back, seed, idea, top_k, "A <title>").count("<circle") == 3
    assert "<h2>h</h2>" in page and "Seed paper" in page and "Where the idea came from" in page and "Roots\n(1 papers)" in page
    lineage.write_text(spark, str(tmp_path / "p.html"), page)
    assert (tmp_path / "p.html").read_text() == page


def test_seed_identification(spark):
    reply = '```json\n{"title": " T ", "search_query": "q", "year": "1400", "alternatives": [{"title": "a"}, {"note": "n"}, {"title": "b"}, {"title": "c"}, {"title": "d"}]}\n```'
    r = lineage.identify_seed(spark, "the one about rings", lambda m: reply).first()
    assert (r.title, r.search_query, r.year, [a.title for a in r.alternatives]) == ("T", "q", None, ["a", "b", "c"])
    assert (r.confidence, r.reasoning, r.authors, r.sources, r.model) == ("low", "", [], [], "")
    with pytest.raises(prompts.ReplyError):
        lineage.identify_seed(spark, "x", lambda m: '{"title": "T", "search_query": " "}')


def test_guesses_of_odd_replies(spark):
    full = '{"search_query": " q ", "arxiv_id": "2406.1", "doi": "10.1/X", "authors": ["A", " ", null, 7], "year": 1999, "confidence": "high", "reasoning": "r", "alternatives": [{"title": "a", "note": null}, "b", null, 3, {"title": 5, "note": "n"}]}'
    replies = [full, '{"search_query": "q", "authors": "A", "alternatives": 3, "year": [1], "title": {"x": 1}}', "[" + full + "]", "none", "", None, '{"search_query": 7}', '```\n{"search_query": "in"}\n``` not {"search_query": "out"}']
    table = spark.createDataFrame([(i, x, "kept") for i, x in enumerate(replies)], "n int, reply string, `doi.x` string")
    got = {r.n: r for r in prompts.guess_of(table).collect()}
    assert set(got) == {0, 1, 6, 7} and got[7].search_query == "in" and got[0]["doi.x"] == "kept"
    r = got[0]
    assert (r.search_query, r.arxiv_id, r.doi, r.authors, r.year, r.confidence, r.reasoning) == ("q", "2406.1", "10.1/X", ["A", "7"], 1999, "high", "r")
    assert [tuple(a) for a in r.alternatives] == [("a", ""), ("5", "n")]
    assert (got[1].search_query, got[1].authors, got[1].alternatives, got[1].year) == ("q", [], [], None)


def test_a_guess_names_a_work(spark):
    w = spark.createDataFrame([(1, "Small ring", 5, "10.1/A"), (2, "small: RING", 9, None), (3, "x", 0, "https://doi.org/10.48550/arXiv.2406.1"), (4, "", 1, ""), (5, None, 1, None)], "id long, title string, cited_by_count long, doi string")
    rows = [("d", "doi:10.1/a", None, "x"), ("a", "10.9/none", "2406.1", "small ring"), ("t", None, None, "Small  ring!"), ("n", None, None, "--"), ("o", None, None, "other")]
    g = spark.createDataFrame(rows, "k string, doi string, arxiv_id string, title string")
    assert {tuple(r) for r in prompts.resolved(w, g, "k").collect()} == {("d", 1, "doi"), ("a", 3, "arxiv"), ("t", 2, "title")}
    assert prompts.resolved(w.where("false"), g, "k").isEmpty() and prompts.resolved(w, g.where("false"), "k").isEmpty()


def test_keyword_run(spark):
    w, c, refs = tiny(spark)
    got = {r.id: r for r in lineage.keyword_lineage(w, c, refs, "S", "small ring", top_k=1).collect()}
    assert set(got) == {"S", "R"} and (got["S"].x, got["S"].y) == (0, 0) and got["R"].relationship.startswith("The seed paper cites")


def test_a_story_that_fails_leaves_the_graph(spark):
    w, c, refs = tiny(spark)
    said = []
    chat = lambda m: '{"clusters": [], "keep": [{"i": 1}]}' if "candidates:" in m[1]["content"] else '{"headline": "h"}'
    g = lineage.curated_lineage(w, c, refs, "S", "small ring", chat, warn=said.append)
    assert g.story is None and g.curation == "llm" and len(said) == 1 and "no story" in said[0]
    assert "narrative" not in json.loads(lineage.graph_json(g, "S", "x", 1).first().json)
    assert lineage.curated_lineage(w, c, refs, "S", "small ring", chat, tell=False, warn=said.append).story is None and len(said) == 1


def test_expansion_document_round_trip_and_summary(spark, tmp_path):
    from strandline.operators.enrich import enrich
    from strandline.operators.expand import expand
    from strandline.operators.select import filter_by_idea
    from strandline.sources.records import read_graph

    w, c, refs = tiny(spark)
    e = expand(w, c, "S")
    nodes = e.nodes.select("id", "hop", "ord").join(w, "id")
    path = str(tmp_path / "deep" / "e.json")
    lineage.write_text(spark, path, lineage.expansion_json(nodes, e.edges, "S", True).first().json)
    got = read_graph(spark, path)
    assert got["meta"].first().truncated and [r.id for r in got["nodes"].orderBy("ord").collect()][0] == "S"
    assert {(r.source, r.target) for r in got["edges"].collect()} == {("S", "R"), ("F", "S")}
    more = enrich(nodes, e.edges, w, refs, "S")
    row = lineage.run_summary(e, filter_by_idea(more.nodes, more.edges, "S", "ring", 1), more.report, "S").first()
    assert (row.seed_id, row.expanded, row.kept, row.truncated, row.intents_labelled, row.curation, row.clusters) == ("S", 3, 2, False, 1, "bm25", 0)


def test_works_once_fetched_come_from_the_cache(spark, tmp_path):
    w, c, refs = tiny(spark)
    asked = []

    def records(ids):
        found = w.join(ids, "id", "left_semi")
        asked.append(ids.count())
        return found

    runs = [sorted(tuple(r) for r in lineage.keyword_lineage(w, c, refs, "S", "ring", records=records, cache=str(tmp_path)).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and asked == [3, 3, 3, 0]  # each run asks for the schema first, then for what is missing


def test_command_line(spark, tmp_path, capsys):
    from strandline import cli

    w, c, refs = tiny(spark)
    for name, t in (("w", w), ("c", c), ("r", refs)):
        t.write.parquet(str(tmp_path / name))
    at = lambda name: str(tmp_path / name)
    assert cli.main(["search-seed", "--works", at("w"), "small ring", "--limit", "1"], spark) == 0
    assert json.loads(capsys.readouterr().out)["id"] in ("F", "R", "S")
    assert cli.main(["expand", "--works", at("w"), "--cites", at("c"), "--seed", "S", "--out", at("e.json")], spark) == 0
    assert cli.main(["filter", "--expansion", at("e.json"), "--idea", "small ring", "--top-k", "1", "--out", at("f.json")], spark) == 0
    assert {n["id"] for n in json.loads((tmp_path / "f.json").read_text())["nodes"]} == {"R", "S"}
    assert cli.main(["render", "--graph", at("f.json"), "--out", at("p.html")], spark) == 0
    assert (tmp_path / "p.html").read_text().count("<circle") == 2
    assert cli.main(["run", "--works", at("w"), "--cites", at("c"), "--refs", at("r"), "--seed", "S", "--idea", "ring", "--out", at("run.html")], spark) == 0
    assert "<svg" in (tmp_path / "run.html").read_text() and "warning: no language model" in capsys.readouterr().err
    assert cli.main(["expand", "--works", at("w"), "--cites", at("c"), "--seed", "none", "--out", at("x")], spark) == 1
    assert cli.main(["search-seed", "--works", at("w"), "ring", "--limit", "0"], spark) == 1 and "--limit is 0" in capsys.readouterr().err


def test_command_line_with_a_model(spark, tmp_path, capsys):
    from strandline import cli
    from strandline.sources.host import Reply

    w, c, _ = tiny(spark)
    w.write.parquet(str(tmp_path / "w"))
    c.write.parquet(str(tmp_path / "c"))
    at = lambda name: str(tmp_path / name)
    said = Reply('{"search_query": "small ring", "doi": "https://doi.org/10.1/R", "confidence": "high", "alternatives": [{"title": "o", "note": "n"}]}')
    said.urls, said.model = ["u1"], "m"
    assert cli.main(["identify-seed", "the ring one", "--works", at("w")], spark, lambda m: said) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["found"] == {"id": "R", "matched_by": "doi"} and got["sources"] == ["u1"] and got["model"] == "m" and got["alternatives"] == [{"title": "o", "note": "n"}]
    assert set(got) - {"found"} == {"search_query", "title", "arxiv_id", "doi", "authors", "year", "confidence", "reasoning", "alternatives", "sources", "model"}
    assert cli.main(["identify-seed", " "], spark, lambda m: said) == 1
    assert cli.main(["--settings", at("none"), "identify-seed", "x"], spark) == 1 and "no model is set" in capsys.readouterr().err
    chat = lambda m: '{"clusters": [{"id": "a", "name": "Rings"}], "keep": [{"i": 1, "cluster": "a"}]}' if "candidates:" in m[1]["content"] else '{"headline": "Of rings", "overview": "They grew."}'
    run = ["run", "--works", at("w"), "--cites", at("c"), "--seed", "S", "--idea", "ring", "--out", at("run.html")]
    assert cli.main(run, spark, chat) == 0 and "Of rings" in (tmp_path / "run.html").read_text() and "warning" not in capsys.readouterr().err
    assert cli.main([*run, "--no-narrative"], spark, chat) == 0 and "Of rings" not in (tmp_path / "run.html").read_text()
    assert cli.main([*run, "--mode", "llm"], spark, lambda m: "nothing") == 1


def test_second_source_gives_both_lists_or_none(spark):
    from strandline.sources.host import SourceError
    from strandline.sources.neighbours import paper_of, refs_of

    paper = lambda k: {"paperId": f"p{k}", "externalIds": {"DOI": f"10.1/{k}"}, "title": f"t{k}", "abstract": "a"}
    asked = []

    def fetch(path):
        asked.append(path)
        if "/references" in path:
            return {"data": [{"intents": ["result"], "isInfluential": True, "citedPaper": paper(k)} for k in (1, 2, 3)]}
        if "/citations" in path:
            return {"data": [{"citingPaper": paper(9)}, {"citingPaper": {"paperId": None}}]}
        return paper(7)

    rows = refs_of(spark, fetch, "DOI:10.1/s", limit=2).orderBy("ord").collect()
    assert [(r.doi, r.direction, r.intents, r.is_influential, r.ord) for r in rows] == [("https://doi.org/10.1/1", "cited", ["result"], True, 0), ("https://doi.org/10.1/2", "cited", ["result"], True, 1), ("https://doi.org/10.1/9", "citing", [], False, 2)]
    assert all("limit=2" in p and "DOI:10.1/s" in p.replace("%2F", "/") for p in asked)
    assert paper_of(spark, fetch, "DOI:10.1/7").first().id == "S2:p7"

    def broken(path):
        if "/citations" in path:
            raise SourceError("no")
        return fetch(path)

    with pytest.raises(SourceError):
        refs_of(spark, broken, "DOI:10.1/s")


def test_cited_addresses_and_account_tables(spark):
    from strandline.functions import accounts

    message = {"annotations": [{"url_citation": {"url": "u1"}}, "x", {"url_citation": None}, {"url_citation": {"url": 3}}, {"url_citation": {"url": "u2"}}, {"url_citation": {"url": "u1"}}]}
    assert prompts.cited_urls(message) == ["u1", "u2"] and prompts.cited_urls({}) == []
    users = spark.createDataFrame([(1, "a@b.c", "h", __import__("datetime").datetime(2020, 1, 1), None)], accounts.USERS)
    assert spark.createDataFrame([], accounts.INVITES).count() == 0
    assert accounts.select(spark, "select id from people where email = ?", "a@b.c", people=users).first().id == 1
    assert accounts.select(spark, "select id from people where email = ?", "' or 1=1 --", people=users).count() == 0


def test_titles_are_not_dealt_by_customer(spark, tmp_path):
    from strandline.sources import substrate

    tables = {
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int", [(1, 1, 1, 1), (2, 1, 1, 1), (2, 2, 1, 2)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp", [(1, 7, datetime(1995, 1, 1)), (2, None, datetime(1996, 1, 1))]),
        "part": ("p_partkey long, p_name string", [(1, "red ring"), (2, "hot bolt")]), "supplier": ("s_suppkey long, s_name string", [(1, "s")]),
        "customer": ("c_custkey long, c_mktsegment string", [(7, "tools")]), "documents": ("doc_id long, text string", [(1, "of rings")]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        works = substrate.works(spark, str(tmp_path))
        got = [(r.id, r.title, r.abstract, r.venue) for r in works.orderBy("id").collect()]
        plan = works._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [(1, "red ring", "of rings", "tools"), (2, "red ring hot bolt", "", None)]
    dealt = [i for i, line in enumerate(plan) if "hashpartitioning(o_custkey" in line]
    assert len(dealt) == 1
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    below = []
    for line in plan[dealt[0] + 1 :]:
        if depth(line) <= depth(plan[dealt[0]]):
            break
        below.append(line)
    assert below and not any("p_name" in line for line in below)
