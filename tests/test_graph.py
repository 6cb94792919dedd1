import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import contract, direction, enrich, layout, lookup, relate, select
from strandline.operators.expand import Caps, expand


def works(spark, cited):
    return spark.createDataFrame(list(cited.items()), "id string, cited_by_count long")


def cites(spark, pairs):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "src string, tgt string, pos long")


def ids(e):
    return [r.id for r in e.nodes.orderBy("ord").collect()]


def pairs(e):
    return [(r.source, r.target) for r in e.edges.orderBy("ord").collect()]


STAR = {"S": 0, "R0": 0, "R1": 1, "R2": 2, "R3": 3, "R4": 4}
STAR_CITES = [("S", f"R{i}") for i in range(5)]


def test_fanout_keeps_the_most_cited(spark):
    e = expand(works(spark, STAR), cites(spark, STAR_CITES), "S", Caps(500, 2))
    assert ids(e) == ["S", "R4", "R3"] and not e.refused.first().truncated


def test_total_cap_counts_the_seed_and_tells(spark):
    e = expand(works(spark, STAR), cites(spark, STAR_CITES), "S", Caps(3, 100))
    assert ids(e) == ["S", "R4", "R3"] and e.refused.first().truncated
    assert pairs(e) == [("S", "R3"), ("S", "R4")]  # met in the order of the references, as they are not over the fan-out cap


def test_exactly_at_the_fanout_cap_references_keep_their_order(spark):
    e = expand(works(spark, STAR), cites(spark, STAR_CITES), "S", Caps(500, 5))
    assert pairs(e)[:5] == STAR_CITES


def test_a_work_keeps_its_earliest_hop(spark):
    e = expand(works(spark, {"S": 0, "R1": 1, "F1": 1}), cites(spark, [("S", "R1"), ("F1", "S"), ("F1", "R1")]), "S", Caps())
    assert {r.id: r.hop for r in e.nodes.collect()} == {"S": 0, "R1": 1, "F1": 1}
    assert set(pairs(e)) == {("S", "R1"), ("F1", "S"), ("F1", "R1")}


def test_hop_two_adds_edges_when_the_cap_is_full_and_self_citations_stay(spark):
    e = expand(works(spark, {"S": 0, "A": 5, "B": 4, "C": 1}), cites(spark, [("S", "A"), ("S", "B"), ("A", "B"), ("B", "C"), ("A", "A")]), "S", Caps(3, 10))
    assert ids(e) == ["S", "A", "B"] and ("A", "B") in pairs(e) and ("A", "A") in pairs(e) and e.refused.first().truncated


def test_unknown_works_are_dropped_and_an_unknown_seed_gives_nothing(spark):
    assert ids(expand(works(spark, {"S": 0}), cites(spark, [("S", "X")]), "S", Caps())) == ["S"]
    assert ids(expand(works(spark, {"S": 0}), cites(spark, [("S", "X")]), "nobody", Caps())) == []


def test_a_sample_is_fixed_by_its_seed(spark):
    w, c = works(spark, STAR), cites(spark, STAR_CITES)
    take = lambda n: ids(expand(w, c, "S", Caps(500, 2, "random", n)))
    assert take(1) == take(1) and any(take(1) != take(n) for n in range(2, 6))


def edges(spark, ps, labels=None):
    return spark.createDataFrame([(a, b, i, *(labels or {}).get((a, b), ([], False))) for i, (a, b) in enumerate(ps)], "source string, target string, ord long, intents array<string>, is_influential boolean")


def kinds(spark, ps, names, seed="S"):
    n = spark.createDataFrame([(x,) for x in names], "id string")
    levels, walked = ({r.id: r.direction for r in direction.classify(n, edges(spark, ps), seed, capped).collect()} for capped in (False, True))
    assert levels == walked
    return levels


@pytest.mark.parametrize("few", [200_000, 0])
def test_many_seeds_walk_together_over_cycles(spark, monkeypatch, few):
    monkeypatch.setattr(direction, "FEW", few)
    r = random.Random(few)
    ps = [(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(45)] + [("n1", "n1"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c3", "n0"), ("n0", None), (None, "c1")]
    way = {}
    for a, b in ps:
        way.setdefault((a, True), set()).add(b)
        way.setdefault((b, False), set()).add(a)

    def far(x, up):
        met, todo = set(), [x]
        while todo:
            for y in way.get((todo.pop(), up), ()):
                if y is not None and y not in met:
                    met.add(y)
                    todo.append(y)
        return met - {x}

    seeds = [f"n{i}" for i in range(0, 30, 3)] + ["c1", "c3", "nobody", "c1", None]
    want = {(s, x, "mixed" if x in far(s, True) and x in far(s, False) else "ancestor" if x in far(s, True) else "descendant") for s in set(seeds) if s for x in far(s, True) | far(s, False)}
    e = spark.createDataFrame(ps, "source string, target string")
    got = [tuple(x) for x in direction.classify_from(e, spark.createDataFrame([(s,) for s in seeds], "id string")).collect()]
    assert set(got) == want and len(got) == len(want) and any(k == "mixed" for *_, k in want)


def test_seeds_of_a_walk_share_rows(spark):
    ps = [(f"n{i:03}", f"n{i + 1:03}") for i in range(99)]  # more seeds than bits of a row, in a chain
    ps += [(f"n{i:03}", f"n{i + 7:03}") for i in range(0, 90, 5)] + [("n099", "n095")]
    seeds = spark.createDataFrame([(f"n{i:03}",) for i in range(90)], "id string")
    state, bits = direction._walk(edges(spark, ps), seeds)
    assert state.count() <= 2 * 2 * 100 and bits.select("block", "bit").distinct().count() == 90
    got = {(r.seed, r.id): r.direction for r in direction.classify_from(edges(spark, ps), seeds).collect()}
    assert got == {(f"n{s:03}", f"n{x:03}"): "ancestor" if x > s else "descendant" for s in range(90) for x in range(100) if x != s}


def test_a_walk_in_one_task_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(direction, "CAPPED", 1)
    monkeypatch.setattr(direction, "_walked", None)
    e = spark.createDataFrame([("S", "A"), ("B", "S")], "source string, target string")
    assert sorted(map(tuple, direction.reached(e, "S", capped=True).collect())) == [("A", True), ("B", False)]


def test_directions_are_transitive_and_end_on_cycles(spark):
    assert kinds(spark, [("S", "OLD"), ("NEW", "S"), ("FAR", "NEW"), ("A", "B")], ["S", "OLD", "NEW", "FAR", "A"]) == {"OLD": "ancestor", "NEW": "descendant", "FAR": "descendant", "A": "unrelated"}
    assert kinds(spark, [("S", "A"), ("A", "B"), ("B", "S")], ["S", "A", "B"]) == {"A": "mixed", "B": "mixed"}
    assert kinds(spark, [], ["S", "A"]) == {"A": "unrelated"}


def test_frontiers_that_are_dealt_by_key(spark, monkeypatch):
    r = random.Random(3)
    ps = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(90)] + [(None, "n1"), ("n1", None), ("n2", "n2")]
    names = [f"n{i}" for i in range(60)]
    few = kinds(spark, ps, names, "n1")
    monkeypatch.setattr(direction, "FEW", 0)
    assert kinds(spark, ps, names, "n1") == few and len(set(few.values())) > 1


def test_seed_edge_intents_last_label_counts(spark):
    e = edges(spark, [("S", "A"), ("A", "S"), ("A", "B")], {("S", "A"): (["background"], False), ("A", "S"): (["methodology"], True)})
    assert [tuple(r) for r in direction.seed_edge_intents(e, "S").collect()] == [("A", "methodology, influential")]


def test_relationships(spark):
    n = spark.createDataFrame([("S", "seed", 0), ("A", "a", 1), ("B", "b", 2), ("C", "c", 2), ("D", "d", 2)], "id string, title string, hop int")
    e = edges(spark, [("C", "GONE"), ("S", "A"), ("B", "A"), ("C", "B")])
    got = {r.id: (r.kind, r.relationship) for r in relate.relationships(n, e, "S").collect()}
    assert got["S"][0] == "seed" and got["A"][0] == "direct" and got["A"][1].startswith("The seed paper cites this one")
    assert got["B"] == ("bridge", 'Two hops from the seed via "a": "b" cites "a"; "the seed paper" cites "a".')
    assert got["C"][0] == got["D"][0] == "none" and got["C"][1].startswith("Reached 2 hop(s)")


def test_the_first_edge_chooses_the_bridge(spark):
    n = spark.createDataFrame([(x, x.lower(), 1) for x in "SABX"], "id string, title string, hop int")
    got = {r.id: r.relationship for r in relate.relationships(n, edges(spark, [("X", "B"), ("X", "A"), ("S", "A"), ("B", "S")]), "S").collect()}
    assert got["X"] == 'Two hops from the seed via "b": "x" cites "b"; "b" cites "the seed paper".'


def test_enrichment_matches_labels_and_fills(spark):
    n = spark.createDataFrame([("S", "10.0/seed", "x", 0), ("O", "https://doi.org/10.0/OLD", "", 1), ("N", "http://doi.org/10.0/new", "own", 2)], "id string, doi string, abstract string, ord long")
    w = n.select("id", "doi")
    refs = spark.createDataFrame([("10.0/old", "cited", ["methodology"], False, "from refs", 0), ("DOI:10.0/OLD", "citing", [], True, "late", 3), ("10.0/new", "citing", [], False, "other", 1), ("10.0/none", "citing", ["result"], True, "z", 2), (None, "citing", [], True, "", 4)], "doi string, direction string, intents array<string>, is_influential boolean, abstract string, ord long")
    e = enrich.enrich(n, edges(spark, [("S", "O"), ("N", "S")]), w, refs, "S")
    assert {(r.source, r.target): (r.intents, r.is_influential) for r in e.edges.collect()} == {("S", "O"): (["methodology"], False), ("N", "S"): ([], False)}
    assert {r.id: r.abstract for r in e.nodes.collect()} == {"S": "x", "O": "from refs", "N": "own"}
    assert e.report.first().asDict() == {"references_seen": 1, "citations_seen": 4, "matched": 2, "unmatched": 1, "edges_annotated": 1, "abstracts_filled": 1}


def test_without_any_doi_unmatched_counts_records(spark):
    n = spark.createDataFrame([("S", "10.0/s", "x", 0)], "id string, doi string, abstract string, ord long")
    refs = spark.createDataFrame([(None, "cited", [], True, "", 0), ("", "citing", [], True, "", 1)], "doi string, direction string, intents array<string>, is_influential boolean, abstract string, ord long")
    r = enrich.enrich(n, edges(spark, [("S", "S")]), n.select("id", "doi"), refs, "S").report.first()
    assert r.unmatched == 2 and r.edges_annotated == 0


def graph_nodes(spark):
    rows = [("S", "seed paper", "", 0, 9, 0), ("A", "small ring", "", 1, 1, 1), ("B", "nothing", "", 1, 2, 2), ("C", "nothing else", "", 2, 3, 3)]
    return spark.createDataFrame(rows, "id string, title string, abstract string, hop int, cited_by_count long, ord long")


def test_filter_keeps_seed_top_k_and_edges_between(spark):
    g = select.filter_by_idea(graph_nodes(spark), edges(spark, [("S", "A"), ("A", "C"), ("S", "B")], {("S", "A"): (["result"], True)}), "S", "small ring", 2)
    assert [r.id for r in g.nodes.orderBy("rank").collect()] == ["A", "S", "B"]  # zero scores rank by arrival
    assert {(r.source, r.target) for r in g.edges.collect()} == {("S", "A"), ("S", "B")} and "intents" not in g.edges.columns


REPLY = '{"clusters":[{"id":"a","name":"x","role":"ANCESTOR"},{"id":"a","name":"y","role":"odd"}],"keep":[{"i":2,"cluster":"a","importance":5},{"i":"2","cluster":"b"},{"i":99},{"i":3,"cluster":"zz","importance":0}]}'


def test_curation_reply_is_hardened(spark):
    n = graph_nodes(spark)
    none = n.limit(0)
    cand = select.prefilter(n, none.select("id", F.lit("").alias("direction")), none.select("id", F.lit("").alias("intent")), "S", "small", 10)
    assert [(r["index"], r.id, r.direction) for r in cand.orderBy("index").collect()] == [(1, "A", "unrelated"), (2, "C", "unrelated"), (3, "B", "unrelated")]
    g = select.curated(n, edges(spark, [("S", "C"), ("S", "A")]), cand, spark.createDataFrame([(REPLY,)], "reply string"), "S")
    assert [(r.id, r.cluster_id, r.importance) for r in g.nodes.orderBy("rank").collect()] == [("S", None, 5), ("C", "a", 5), ("B", "other", 3)]
    assert [(r.id, r.name, r.role) for r in g.clusters.orderBy("ord").collect()] == [("a", "y", "contemporary"), ("other", "Other related work", "contemporary")]
    assert [(r.source, r.target) for r in g.edges.collect()] == [("S", "C")]


def years(spark, rows):
    return spark.createDataFrame(rows, "id string, publication_year int")


def test_layout_orders_years_and_keeps_the_seed_at_the_origin(spark):
    p = {r.id: (r.x, r.y) for r in layout.by_year(years(spark, [("S", 2010), ("O", 2000), ("N", 2020), ("U", None)]), "S").collect()}
    assert p["S"] == (0, 0) and p["O"][0] < p["N"][0] and len(set(p.values())) == 4
    assert p["O"] == pytest.approx((-900, -900)) and p["U"] == pytest.approx((35 / 2**0.5, -35 / 2**0.5))


def test_crowded_years_spread_wider(spark):
    gap = lambda n: abs((lambda p: p["w01"][0] - p["w00"][0])({r.id: (r.x, r.y) for r in layout.by_year(years(spark, [("S", 2001)] + [(f"w{i:02}", 2000) for i in range(n)]), "S").collect()}))
    assert gap(20) > gap(4)


def test_clusters_take_upper_medians_lanes_and_grids(spark):
    n = spark.createDataFrame([("S", 2015, None), ("a", 2010, "old"), ("b", 2012, "old"), ("c", 2022, "new"), ("d", 2024, "new"), ("e", None, "none")], "id string, publication_year int, cluster_id string")
    s = {r.cluster_id: (r.n, r.median_year, r.span) for r in layout.cluster_stats(n, "S").collect()}
    assert s == {"old": (2, 2012, "2010–2012"), "new": (2, 2024, "2022–2024"), "none": (1, None, "")}
    c = {r.cluster_id: (r.x, r.y) for r in layout.cluster_centres(layout.cluster_stats(n, "S"), F.lit(2015)).collect()}
    assert c["old"] == pytest.approx((-1500, -1500)) and c["new"][0] > c["old"][0]
    g = {r.id: (r.x, r.y) for r in layout.in_clusters(n, "S", F.lit(2015)).collect()}
    assert g["b"][0] - g["a"][0] == pytest.approx(190) and g["a"][1] == g["b"][1] and "S" not in g
    assert set(r.id for r in layout.positions(n, "S").collect()) == {"S", "a", "b", "c", "d", "e"}


def test_contraction_merges_and_drops_loops(spark):
    n = spark.createDataFrame([("S", None), ("a", "x"), ("b", "x"), ("c", "y")], "id string, cluster_id string")
    e = edges(spark, [("a", "b"), ("S", "a"), ("S", "b"), ("c", "a")])
    got = {(r["from"], r["to"]): (r.weight, r.width, r.label) for r in contract.contracted(e, n).collect()}
    assert got == {("cluster:x", "S"): (2, 2.4, "2"), ("cluster:x", "cluster:y"): (1, 1.5, None)}
    assert ("a", "cluster:y") in {(r["from"], r["to"]) for r in contract.contracted(e, n, ["x"]).collect()}


def test_lookups(spark):
    w = spark.createDataFrame([("W1", "10.1/a", 1), ("W2", "https://doi.org/10.1/A", 2), ("W3", None, 3)], "id string, doi string, cited_by_count long")
    keys = spark.createDataFrame([("W1",), ("W9",), ("W1",)], "id string")
    assert [r.id for r in lookup.by_ids(w, keys).collect()] == ["W1"] and [r.id for r in lookup.missing(w, keys).collect()] == ["W9"]
    got = lookup.by_doi(w, spark.createDataFrame([("DOI:10.1/a",), (None,), ("",)], "doi string")).collect()
    assert [(r.asked_doi, r.id) for r in got] == [("10.1/a", "W2")]


def test_places_in_ranges_are_those_of_one_window(spark):
    from strandline.operators.rank import placed

    r = random.Random(2)
    rows = [(i, None if i % 11 == 0 else (2000 if i % 3 else 2000 + r.randrange(5)), r.randrange(50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, year int, x int").repartition(5)
    got = [{(x.id, x.nth, x.n) for x in placed(df, ["year"], [F.col("x"), F.col("id")], spread).collect()} for spread in (True, False)]
    assert got[0] == got[1] and len(got[0]) == 3000
    flat = placed(df.select("id"), [], [F.col("id")]).collect()
    assert all(x.id == x.nth and x.n == 3000 for x in flat) and placed(df.where("false"), ["year"], [F.col("id")]).count() == 0


def test_two_dois_that_lead_to_one_node(spark):
    from strandline.operators.enrich import enrich

    nodes = spark.createDataFrame([("S", "10.1/s", "x", 0), ("N", "10.1/own", "", 1)], "id string, doi string, abstract string, ord long")
    edges = spark.createDataFrame([("S", "N", 0)], "source string, target string, ord long")
    works = spark.createDataFrame([("N", "10.1/other"), ("N", "10.1/own")], "id string, doi string")
    refs = spark.createDataFrame([("10.1/other", "cited", ["result"], False, "text a", 0), ("10.1/own", "cited", ["methodology"], False, "text b", 1)], "doi string, direction string, intents array<string>, is_influential boolean, abstract string, ord long")
    e = enrich(nodes, edges, works, refs, "S")
    # Own DOIs are matched first, then the works table: the last one labels, the first one fills.
    assert e.edges.first().intents == ["result"] and {r.id: r.abstract for r in e.nodes.collect()} == {"S": "x", "N": "text b"}


def test_an_enrichment_is_counted_as_it_is_written(spark):
    from strandline.operators.enrich import enrich

    nodes = spark.createDataFrame([("S", "10.1/s", "x", 0), ("N", "10.1/n", "", 1), ("M", None, None, 2)], "id string, doi string, abstract string, ord long")
    edges = spark.createDataFrame([("S", "N", 0), ("S", "M", 1)], "source string, target string, ord long")
    works = nodes.select("id", "doi")
    refs = spark.createDataFrame([("10.1/n", "cited", ["result"], False, "text", 0), ("DOI:10.1/N", "cited", [], True, "again", 1), (None, "cited", ["x"], True, "y", 2), ("10.9/z", "citing", [], False, None, 3), (" ", "citing", [], False, None, 4)], "doi string, direction string, intents array<string>, is_influential boolean, abstract string, ord long")
    e = enrich(nodes, edges, works, refs, "S")
    assert tuple(e.report.first()) == (3, 2, 1, 1, 1, 1) and e.nodes.columns == nodes.columns
    # Without any DOI all records are unmatched; without records there is nothing to count.
    assert tuple(enrich(nodes, edges, works, refs.where("doi is null or doi = ' '"), "S").report.first()) == (1, 1, 0, 2, 0, 0)
    assert tuple(enrich(nodes, edges, works, refs.where("false"), "S").report.first()) == (0, 0, 0, 0, 0, 0)


def test_of_works_with_one_doi_the_last_to_arrive(spark):
    from strandline.operators.lookup import by_doi

    works = spark.createDataFrame([(1, "10.1/A", 5), (2, "https://doi.org/10.1/a", 3)], "id long, doi string, place int")
    keys = spark.createDataFrame([("DOI:10.1/a",)], "doi string")
    assert by_doi(works, keys).first().id == 2 and by_doi(works, keys, "place").first().id == 1


def test_numbers_in_replies(spark):
    from strandline.functions import wording as W
    from strandline.operators.select import kept_of

    told = {"5": 5, "100000000000": 5, "-99999999999999999999": 1, "0": 3, "x": 3, "3.0": 3, "+2": 2}
    got = {r.t: r.n for r in spark.createDataFrame([(t,) for t in told], "t string").select("t", W.importance(F.col("t")).alias("n")).collect()}
    assert got == told
    reply = spark.createDataFrame([('{"keep": [{"i": null, "index": 1}, {"index": 2}, {"i": "3", "index": 1}]}',)], "reply string")
    candidates = spark.createDataFrame([(k,) for k in (1, 2, 3)], "index int")
    none = spark.createDataFrame([], "id string, name string, role string, summary string, ord int")
    assert sorted(r["index"] for r in kept_of(reply, candidates, none).collect()) == [2, 3]


def test_login_rule_is_the_plain_fold(spark):
    from strandline.operators.throttle import login_decisions

    r = random.Random(7)
    rows = [(r.choice([1, 1, 1, 2, None]), f"2020-01-01 00:{r.randrange(60):02d}:{r.randrange(60):02d}", i, r.random() < 0.8) for i in range(2500)] + [(1, None, 9999, True)]
    df = spark.createDataFrame(rows, "key int, t string, id long, failed boolean").withColumn("ts", F.col("t").cast("timestamp"))
    want, recent = {}, {}
    for key, t, i, failed in sorted((x for x in rows if x[1]), key=lambda x: (x[1], x[2])):
        now = int(t[14:16]) * 60 + int(t[17:])
        mine = [x for x in recent.get(key, []) if now - x <= 60]
        want[i] = len(mine) >= 3
        recent[key] = mine if want[i] else [*mine, now] if failed else []
    assert {x.id: x.blocked for x in login_decisions(df, 60, 3).collect()} == want and len(set(want.values())) == 2


def test_scratch_tables_go_and_a_cluster_must_name_its_folder(spark):
    from types import SimpleNamespace

    from strandline.sources import shared

    with shared.scratch(spark) as keep:
        gone, kept = shared.stored(spark.range(3), "gone"), keep(shared.stored(spark.range(3), "kept"))
    assert kept.count() == 3 and gone.stored_at not in shared._made and kept.stored_at in shared._made
    shared.discard(kept)
    bare = SimpleNamespace(sparkContext=SimpleNamespace(getConf=dict, master="spark://x"), conf={})
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(bare)
