"""Every query of the lineage engine, by name, with its DuckDB text.

The inputs come from the order tables (``sources.substrate``). Queries that
need an expansion share one: that of the most cited work under the default caps.
"""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import accounts, ids, text, wording
from ..operators import contract, direction, enrich, index, layout, lookup, prompts, relate, select, throttle, titles
from ..operators.expand import Caps, Expansion, expand
from ..sources import cache, records, substrate
from ..sources.shared import new_path, stored
from ..sources.substrate import read
from .oracle import ORACLE_SQL

#: The package's own defaults; and a tighter cap, under which the small tables show how works are refused.
CAPS, TOP_K, PREFILTER, IDEA = Caps(), 40, 120, "small red ring of the ancient widget"
TIGHT = Caps(total=60, fanout=3)
THROTTLE_S, THROTTLE_LIMIT = 3 * 24 * 3600, 2

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


class Setting:
    """The works, citations, seed and expansion that lineage queries start from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.cites = substrate.citations(spark, sf_dir).persist()  # first, as the works count it too

    @cached_property
    def ranks(self) -> DataFrame:
        """Works without their texts, which is all that traversals and drawings of every work need."""
        return substrate.ranks(self.spark, self.sf_dir, self.cites).persist()

    @cached_property
    def works(self) -> DataFrame:
        return substrate.works(self.spark, self.sf_dir, self.cites).persist()

    def records(self, ids: DataFrame) -> DataFrame:
        """Full works of some ids."""
        return substrate.works(self.spark, self.sf_dir, self.cites, ids)

    @cached_property
    def seed(self):
        return substrate.seed(self.ranks)

    @cached_property
    def expansion(self) -> Expansion:
        return expand(self.ranks, self.cites, self.seed, CAPS)

    @cached_property
    def nodes(self) -> DataFrame:
        """The expansion's nodes as full records; capped, so written down once."""
        e = self.expansion.nodes
        return stored(e.drop("cited_by_count").join(self.records(e), "id"), "records")

    @property
    def edges(self) -> DataFrame:
        return self.expansion.edges

    @cached_property
    def refs(self) -> DataFrame:
        """What the second source says of the seed's neighbours: made from the lines that tie the two orders, with spellings that differ."""
        cited = self.cites.where(F.col("src") == F.lit(self.seed)).select(F.col("tgt").alias("id"), F.lit("cited").alias("direction"), F.lit(0).alias("side"))
        citing = self.cites.where(F.col("tgt") == F.lit(self.seed)).select(F.col("src").alias("id"), F.lit("citing").alias("direction"), F.lit(1).alias("side"))
        near = stored(cited.unionByName(citing), "neighbours")
        lines = read(self.spark, self.sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_discount").join(near, F.col("l_orderkey") == F.col("id"), "left_semi")
        lines = lines.groupBy("l_orderkey").agg(F.min("l_returnflag").alias("flag"), F.max("l_discount").alias("discount"))
        both = near.join(lines, F.col("id") == F.col("l_orderkey"))
        key = F.col("id").cast("string")
        spelt = F.when(F.col("id") % 4 == 0, F.concat(F.lit("https://doi.org/10.0/"), key)).when(F.col("id") % 4 == 1, F.concat(F.lit(" DOI:10.0/"), key)).when(F.col("id") % 4 == 2, F.concat(F.lit("HTTP://doi.org/10.0/"), key)).otherwise(F.concat(F.lit("10.0/"), key))
        intent = F.when(F.col("flag") == "A", "methodology").when(F.col("flag") == "R", "result").otherwise("background")
        return stored(both.select(spelt.alias("doi"), "direction", F.when(F.col("id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(intent)).alias("intents"), (F.col("discount") >= 0.08).alias("is_influential"), F.concat(F.lit("abstract of "), key).alias("abstract"), (F.col("side") * 1_000_000_000_000 + F.col("id")).alias("ord")), "refs")

    @cached_property
    def enriched(self) -> enrich.Enriched:
        return enrich.enrich(self.nodes, self.edges, self.ranks, self.refs, self.seed)

    @property
    def clustered(self) -> DataFrame:
        """Nodes with their venue as cluster."""
        return self.nodes.withColumn("cluster_id", F.col("venue"))

    def reply(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(text,)], "reply string")


# Identifiers and parsers


def _spellings(spark, sf_dir) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    form = F.col("o_orderkey") % 7
    raw_id = F.when(form == 0, F.concat(F.lit("https://openalex.org/W"), key)).when(form == 1, F.concat(F.lit(" w"), key)).when(form == 2, F.concat(F.lit("S2:ab"), key)).otherwise(F.concat(F.lit("W"), key))
    raw_doi = F.when(form == 0, F.concat(F.lit("https://doi.org/10.0/A"), key)).when(form == 1, F.concat(F.lit(" DOI:10.0/"), key)).when(form == 2, F.concat(F.lit("http://doi.org/10.0/"), key)).when(form == 3, "").when(form == 4, F.concat(F.lit("https://doi.org/doi:10.0/"), key)).when(form == 5, F.concat(F.lit("10.0/Xy"), key))
    arxiv = F.when(form.isin(3, 5), F.concat(F.lit("ARX."), key))
    return read(spark, sf_dir, "orders").select("o_orderkey", raw_id.alias("raw_id"), raw_doi.alias("raw_doi"), arxiv.alias("arxiv"))


@query
def normalize_work_id(spark, sf_dir):
    return _spellings(spark, sf_dir).select("o_orderkey", ids.work_id(F.col("raw_id")).alias("work_id"))


@query
def normalize_doi(spark, sf_dir):
    return _spellings(spark, sf_dir).select("o_orderkey", ids.doi(F.col("raw_doi")).alias("doi"))


@query
def dedupe_key(spark, sf_dir):
    s = _spellings(spark, sf_dir)
    external = records.present(F.create_map(F.lit("arxiv"), F.col("arxiv")))
    return s.select("o_orderkey", ids.dedupe_key(F.col("raw_doi"), external, F.col("raw_id")).alias("dedupe_key"), ids.seed_reference(F.col("raw_doi"), external).alias("seed_reference"))


@query
def s2_reference(spark, sf_dir):
    s = _spellings(spark, sf_dir)
    any_id = F.coalesce(ids.blank_to_null(F.col("raw_doi")), F.concat(F.lit("arXiv:"), F.col("arxiv")), F.col("raw_id"))
    return s.select("o_orderkey", ids.neighbour_reference(any_id).alias("reference"))


@query
def parse_source_record(spark, sf_dir):
    s = Setting(spark, sf_dir)
    refs = s.cites.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("tgt")).alias("refs"))
    w = substrate.works(spark, sf_dir, s.cites).join(refs, "id", "left")  # read once, so not kept
    form, key = F.col("id") % 3, F.col("id").cast("string")
    raw = F.to_json(
        F.struct(
            F.concat(F.when(form == 0, "https://openalex.org/w").otherwise("W"), key).alias("id"),
            F.when(form == 1, F.col("title")).alias("display_name"),
            F.when(form == 2, F.col("title")).alias("title"),
            "publication_year",
            F.when(F.col("cited_by_count") > 0, F.col("cited_by_count")).alias("cited_by_count"),
            F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))).alias("authorships"),
            F.struct(F.struct(F.col("venue").alias("display_name")).alias("source"), F.when(form == 1, F.concat(F.lit("https://arxiv.org/abs/"), key)).alias("landing_page_url")).alias("primary_location"),
            F.when(form == 0, F.concat(F.lit("https://doi.org/10.0/Q"), key)).alias("doi"),
            F.transform(F.coalesce("refs", F.array()), lambda x: F.concat(F.lit("https://openalex.org/W"), x.cast("string"))).alias("referenced_works"),
        )
    )
    got = records.works_from_json(w.select(raw.alias("raw")), "raw")
    return got.select("id", "title", "publication_year", "cited_by_count", F.array_join("authors", "|").alias("authors"), "venue", "doi", F.array_join("referenced_works", "|").alias("referenced_works"), F.col("external_ids")["doi"].alias("ext_doi"), F.col("external_ids")["arxiv"].alias("ext_arxiv"))


def _paper() -> Column:
    key = F.col("id").cast("string")
    return F.struct(
        F.when(F.col("id") % 5 != 0, key).otherwise("").alias("paperId"),
        F.create_map(F.lit("DOI"), F.concat(F.lit("10.0/Q"), key), F.lit("ArXiv"), F.when(F.col("id") % 3 == 0, key)).alias("externalIds"),
        F.when(F.col("id") % 4 != 0, F.col("title")).alias("title"), F.col("publication_year").alias("year"), F.col("venue"), F.col("cited_by_count").alias("citationCount"),
        F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors"),
    )


@query
def parse_paper_record(spark, sf_dir):
    s = Setting(spark, sf_dir)
    got = records.papers_from_json(s.works.select(F.to_json(_paper()).alias("raw")), "raw")
    return got.select("id", "title", "publication_year", "cited_by_count", F.array_join("authors", "|").alias("authors"), "venue", "doi", F.col("external_ids")["arxiv"].alias("ext_arxiv"))


@query
def parse_neighbour_record(spark, sf_dir):
    s = Setting(spark, sf_dir)
    paper = _paper()
    item = F.struct(F.array(F.lit("background"), F.lit(" ")).alias("intents"), (F.col("id") % 2 == 0).alias("isInfluential"), paper.alias("citedPaper"))
    got = records.neighbours_from_json(s.works.select(F.to_json(F.struct(F.array(item).alias("data"))).alias("raw")), "raw", "citedPaper")
    return got.select("id", "title", "publication_year", "cited_by_count", F.array_join("authors", "|").alias("authors"), "venue", "doi", F.col("external_ids")["arxiv"].alias("ext_arxiv"), F.array_join("intents", "|").alias("intents"), "is_influential")


@query
def reconstruct_abstract(spark, sf_dir):
    """Every document's words put into an inverted index and back; line breaks become single blanks."""
    words = F.split("text", r"[ \t\n\r\f\x0B]+")
    index = read(spark, sf_dir, "documents").select("doc_id", "text", text.inverted_index(words).alias("index"))
    return index.select("doc_id", F.when(F.col("text").isNotNull(), F.md5(text.abstract(F.lit(""), F.col("index")))).alias("abstract_md5"))


@query
def account_fields(spark, sf_dir):
    """Addresses, invite hashes and time stamps of the customers' and orders' columns."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    key = F.col("o_custkey").cast("string")
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit(" User"), key, F.lit("@Example.ORG "))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("user"), key)).when(F.col("o_orderkey") % 4 == 2, F.concat(F.repeat(F.lit("x"), F.lit(250)), F.lit("@e.org"))).otherwise(F.concat(F.lit("a b"), key, F.lit("@e.org")))
    code = F.concat(F.lit(" code-"), key, F.lit(" "))
    token = accounts.url_base64(F.sha2(key, 256).cast("binary"))
    return o.select("o_orderkey", accounts.email(raw).alias("email"), accounts.invite_hash(code).alias("invite"), token.alias("token"), accounts.from_url_base64(token).cast("string").alias("token_text"), accounts.to_iso(F.col("at")).alias("created"), accounts.token_is_current(F.unix_seconds("at"), F.lit(900_000_000)).alias("current"))


@query
def session_tokens(spark, sf_dir):
    """Tokens signed at each order's time, some of them altered, and whom they are good for."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"))
    token = accounts.session_token(F.col("o_custkey"), F.col("at"), "a secret")
    sent = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("1"), token)).when(F.col("o_orderkey") % 5 == 1, F.concat(token, F.lit(".x"))).otherwise(token)
    now = F.col("at") + (F.col("o_orderkey") % 3 - 1) * (20 * 24 * 3600)
    return o.select("o_orderkey", token.alias("token"), accounts.session_user(sent, now, "a secret").alias("user_id"))


# Text and search


@query
def tokenize_documents(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query
def bm25_scores_orders(spark, sf_dir):
    return select.scored(Setting(spark, sf_dir).works, IDEA).select("id", "score")


@query
def bm25_scores_documents(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("title"), F.col("text").alias("abstract"))
    return select.scored(d, "the reer of heonand").select("id", "score")


@query
def bm25_top_k(spark, sf_dir):
    return lookup.search(Setting(spark, sf_dir).works, IDEA, 25).select("id", "score")


@query
def bm25_indexed_top_k(spark, sf_dir):
    """The same result from a stored index, to which a third of the works came later."""
    folder = new_path(spark, "index")
    works = substrate.works(spark, sf_dir).select("id", "title", "abstract").persist()  # what is read several times, and no more
    w = works.select("id", text.tokens(text.document_text(F.col("title"), F.col("abstract"))).alias("tokens"))
    for part in ("id % 3 <> 0", "true"):  # what is there already is left out
        index.add(w.where(part), folder)
    return index.search(spark, folder, IDEA, 25)


@query
def title_similarity_join(spark, sf_dir):
    """Titles of every fiftieth work, misspelt, and the works with titles like them."""
    w = Setting(spark, sf_dir).works.select("id", "title")
    wrong = F.when(F.col("id") % 3 == 0, F.concat(F.substring("title", 1, 4), F.expr("substring(title, 6)"))).when(F.col("id") % 3 == 1, F.concat(F.substring("title", 1, 7), F.lit("x"), F.expr("substring(title, 8)"))).otherwise(F.upper(F.reverse(F.reverse("title"))))
    asked = w.where("id % 50 = 0").select("id", wrong.alias("title"))
    return titles.alike(asked, w).select("asked_id", "id", F.round("similarity", 6).alias("similarity"))


@query
def cache_segments(spark, sf_dir):
    """Works saved in three goes, two of which are made one, and those of them that the events ask for."""
    r, folder = Setting(spark, sf_dir).ranks, new_path(spark, "works-cache")
    rows = lambda when, go: r.where(when).select("id", F.lit(go).alias("origin"))
    cache.save(rows("id % 2 = 0", "first"), folder, "S")
    cache.save(rows("id % 3 = 0", "second"), folder, "S")
    cache.compact(spark, folder, "S", "id long, origin string")
    cache.save(rows("id % 5 = 0 and id < 30000", "third"), folder, "S")
    asked = read(spark, sf_dir, "events").select((F.col("event_id") * 3).alias("id"))
    return cache.lookup(spark, folder, "S", "id long, origin string", asked)


@query
def search_seed_candidates(spark, sf_dir):
    s = Setting(spark, sf_dir)
    other = s.works.select((F.col("id") + 0).alias("id"), "title", "cited_by_count", F.upper("doi").alias("doi"))
    title = s.records(s.ranks.where(F.col("id") == F.lit(s.seed))).first().title
    return lookup.seed_candidates(s.works, other, title, 10)


@query
def lookup_by_ids(spark, sf_dir):
    s = Setting(spark, sf_dir)
    asked = read(spark, sf_dir, "events").select((F.col("event_id") * 3).alias("id"))
    found = lookup.by_ids(s.ranks, asked).select("id", F.lit("found").alias("state"))
    return found.unionByName(lookup.missing(s.ranks, asked).select("id", F.lit("missing").alias("state")))


@query
def lookup_by_doi(spark, sf_dir):
    s = Setting(spark, sf_dir)
    twice = s.ranks.select("id", "doi", F.lit(1).alias("place")).unionByName(s.ranks.select((F.col("id") + 10_000_000).alias("id"), F.upper("doi").alias("doi"), F.lit(0).alias("place")))
    asked = _spellings(spark, sf_dir).select(F.col("raw_doi").alias("doi"))
    return lookup.by_doi(twice, asked, "place").select("asked_doi", "id")


@query
def cache_merge(spark, sf_dir):
    s = Setting(spark, sf_dir)
    cache = s.ranks.where("cited_by_count > 0").select("id", F.lit("cache").alias("origin"))
    fetched = s.ranks.where("publication_year >= 1998").select("id", F.lit("fetched").alias("origin"))
    return lookup.cached_or_fetched(cache, fetched)


@query
def citing_works_top_n(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return lookup.citing(s.ranks, s.cites, s.ranks, 3).select("cited_id", "id", "cited_by_count", F.col("rank").cast("long").alias("rank"))


@query
def references_top_n(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return lookup.references(s.ranks, s.cites, s.ranks, 2).select("citing_id", "id", "cited_by_count", F.col("rank").cast("long").alias("rank"))


@query
def citing_works_sample(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return lookup.citing(s.ranks, s.cites, s.ranks, 2, "random", 11).select("cited_id", "id")


# Expansion and enrichment


@query
def expand_nodes(spark, sf_dir):
    return Setting(spark, sf_dir).expansion.nodes


@query
def expand_edges(spark, sf_dir):
    return Setting(spark, sf_dir).expansion.edges


@query
def expand_nodes_tight(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return expand(s.ranks, s.cites, s.seed, TIGHT).nodes


@query
def expand_edges_tight(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return expand(s.ranks, s.cites, s.seed, TIGHT).edges


@query
def expand_truncated(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return expand(s.ranks, s.cites, s.seed, Caps(total=10, fanout=3)).refused


@query
def expand_hop_counts(spark, sf_dir):
    return Setting(spark, sf_dir).expansion.nodes.groupBy(F.col("hop").cast("long").alias("hop")).agg(F.count(F.lit(1)).alias("n"))


@query
def enrich_edge_intents(spark, sf_dir):
    e = Setting(spark, sf_dir).enriched.edges
    return e.select("source", "target", F.array_join("intents", ",").alias("intents"), "is_influential")


@query
def enrich_abstracts(spark, sf_dir):
    return Setting(spark, sf_dir).enriched.nodes.select("id", F.md5("abstract").alias("abstract_md5"))


@query
def enrich_report(spark, sf_dir):
    return Setting(spark, sf_dir).enriched.report


# Direction, relationship, selection


@query
def classify_directions(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return direction.classify(s.ranks, s.cites.select(F.col("src").alias("source"), F.col("tgt").alias("target")), s.seed)


@query
def classify_many_seeds(spark, sf_dir):
    """Ancestors, descendants and mixed of a hundred seeds at once, those whose hash is smallest."""
    s = Setting(spark, sf_dir)
    seeds = s.ranks.orderBy(F.md5(F.col("id").cast("string")), "id").limit(100)
    return direction.classify_from(s.cites.select(F.col("src").alias("source"), F.col("tgt").alias("target")), seeds)


@query
def seed_edge_intents(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return direction.seed_edge_intents(s.enriched.edges, s.seed)


@query
def describe_relationship(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return relate.relationships(s.nodes, s.enriched.edges, s.seed)


@query
def relationship_after_filter(spark, sf_dir):
    """Over the kept graph, where bridges may be missing and intents are forgotten."""
    s = Setting(spark, sf_dir)
    g = select.filter_by_idea(s.nodes, s.edges, s.seed, IDEA, TOP_K)
    bare = g.edges.select("source", "target", F.array().cast("array<string>").alias("intents"), F.lit(False).alias("is_influential"), "ord")
    return relate.relationships(g.nodes, bare, s.seed)


@query
def filter_by_idea_nodes(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return select.filter_by_idea(s.nodes, s.edges, s.seed, IDEA, TOP_K).nodes.select("id", "hop", "score", F.col("rank").cast("long").alias("rank"))


@query
def filter_by_idea_edges(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return select.filter_by_idea(s.nodes, s.edges, s.seed, IDEA, TOP_K).edges.select("source", "target")


def _candidates(s: Setting) -> DataFrame:
    return stored(select.prefilter(s.nodes, direction.classify(s.nodes, s.edges, s.seed, capped=True), direction.seed_edge_intents(s.enriched.edges, s.seed), s.seed, IDEA, PREFILTER), "candidates")


@query
def prefilter_candidates(spark, sf_dir):
    return _candidates(Setting(spark, sf_dir)).select(F.col("index").cast("long").alias("index"), "id", "score", "direction", "intent")


@query
def candidate_prompt_lines(spark, sf_dir):
    lines = prompts.candidate_lines(_candidates(Setting(spark, sf_dir)))
    return lines.select(F.col("index").cast("long").alias("index"), F.md5("line").alias("line_md5"))


REPLY = """{"clusters": [{"id": "a", "name": "Early", "role": "Ancestor ", "summary": "s1"}, {"id": "b", "name": " Late ", "role": "nonsense"}, {"id": "c", "name": ""}, {"id": "a", "name": "Earlier", "role": "ancestor", "summary": "s2"}, {"id": "unused", "name": "Unused", "role": "descendant"}],
"keep": [{"i": 1, "cluster": "b", "importance": 9, "why": " first "}, {"i": "3", "cluster": "a", "importance": "2"}, {"i": 3, "cluster": "b", "importance": 5}, {"i": 999, "cluster": "a"}, {"index": 5, "cluster": "7", "importance": 0}, {"i": 2.0, "cluster": "a"}, {"i": 8, "importance": "high"}, {"i": 4, "cluster": "a", "importance": -2}], "dropped_summary": "rest"}"""


def _curated(s: Setting) -> select.Graph:
    return select.curated(s.nodes, s.enriched.edges, _candidates(s), s.reply(REPLY), s.seed, 5)


@query
def curated_graph(spark, sf_dir):
    return _curated(Setting(spark, sf_dir)).nodes.select("id", "score", "cluster_id", F.col("importance").cast("long").alias("importance"), "why", F.col("rank").cast("long").alias("rank"))


@query
def curated_edges(spark, sf_dir):
    return _curated(Setting(spark, sf_dir)).edges.select("source", "target", F.array_join("intents", ",").alias("intents"), "is_influential")


@query
def curated_clusters(spark, sf_dir):
    return _curated(Setting(spark, sf_dir)).clusters.select("id", "name", "role", "summary")


BEATS = """{"headline": "h", "overview": "o", "beats": [{"title": "t1", "text": "x1", "papers": [1, 99, "2", null, 1]}, {"title": "none", "text": " "}, {"text": "x3", "papers": []}, {"title": "t4", "text": "x4", "papers": ["3", 2]}, {"title": "t5", "text": "x5"}, {"title": "t6", "text": "x6"}, {"title": "t7", "text": "x7", "papers": [4]}, {"title": "t8", "text": "x8"}]}"""


@query
def lineage_beats(spark, sf_dir):
    s = Setting(spark, sf_dir)
    g = _curated(s)
    beats = prompts.beats_of(s.reply(BEATS), prompts.paper_lines(g.nodes, g.clusters, s.seed))
    return beats.select(F.col("beat").cast("long").alias("beat"), "title", "text", F.array_join("node_ids", ",").alias("node_ids"))


def _replies(works: DataFrame) -> DataFrame:
    """``id, reply``: what a model might say of each work, in seven ways by id, three of which hold no guess."""
    way = F.col("id") % 7
    other = lambda title, note=None: F.struct(F.lit(title).alias("title"), F.lit(note).alias("note"))
    others = F.array(other("A"), other(" "), other(" B ", "n"), other("C"), other("D"))
    fields = {
        "search_query": F.when(way == 3, "  ").otherwise(F.concat("title", F.lit(" "))),
        "title": F.when(way == 0, F.col("title")).when(way == 1, F.upper("title")).when(way == 5, F.replace("title", F.lit(" "), F.lit(", "))),
        "arxiv_id": F.when(way == 2, F.col("id").cast("string")),
        "doi": F.when(way == 0, F.col("doi")),
        "authors": F.when(way != 5, F.col("authors")),
        "year": F.when(way == 5, F.col("publication_year") + 1000).otherwise(F.col("publication_year")).cast("string"),
        "confidence": F.when(way == 5, " ").otherwise("high"),
        "reasoning": F.when(way != 2, "because"),
        "alternatives": F.when(way == 0, others),
    }
    said = F.to_json(F.struct(*(c.alias(name) for name, c in fields.items())))
    odd = F.concat(F.rtrim(said, F.lit("}")), F.lit(', "authors": "nobody", "alternatives": {"title": "A"}}'))
    reply = F.when(way == 0, F.concat(F.lit("```json\n"), said, F.lit("\n```\nas {asked}")))
    reply = reply.when(way == 1, F.concat(F.lit("It is: "), said, F.lit(" I think."))).when(way == 4, F.concat(F.lit("["), said, F.lit("]")))
    return works.select("id", reply.when(way == 5, odd).when(way == 6, "I cannot tell.").otherwise(said).alias("reply"))


@query
def identify_seed_reply(spark, sf_dir):
    """What the replies say, one for each work."""
    g = prompts.guess_of(_replies(substrate.works(spark, sf_dir)))
    told = F.array_join(F.transform("alternatives", lambda a: F.concat(a["title"], F.lit(":"), a["note"])), ",")
    return g.select("id", "search_query", "title", "arxiv_id", "doi", F.array_join("authors", "|").alias("authors"), "year", "confidence", "reasoning", told.alias("alternatives"))


@query
def resolve_seed_guesses(spark, sf_dir):
    """The works that the guesses name; some works have the DOI of an arXiv paper."""
    w = substrate.works(spark, sf_dir)
    arxiv = w.withColumn("doi", F.when(F.col("id") % 7 == 2, F.concat(F.lit("10.48550/arXiv."), F.col("id").cast("string"))).otherwise(F.col("doi")))
    found = prompts.resolved(arxiv, prompts.guess_of(_replies(w)), "id")
    return found.toDF("asked", "id", "matched_by")


# Layout and drawing


@query
def year_layout(spark, sf_dir):
    s = Setting(spark, sf_dir)
    # Crowded years reach millions; three decimals are then all that a double adds up alike in any order.
    return layout.by_year(s.ranks, s.seed).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query
def cluster_stats(spark, sf_dir):
    s = Setting(spark, sf_dir)
    year = s.ranks.where(F.col("id") == F.lit(s.seed)).first().publication_year
    got = layout.cluster_centres(layout.cluster_stats(s.ranks.withColumn("cluster_id", F.col("venue")), s.seed), F.lit(year))
    return got.select("cluster_id", "n", F.col("median_year").cast("long").alias("median_year"), "span", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query
def cluster_layout(spark, sf_dir):
    s = Setting(spark, sf_dir)
    year = s.nodes.where(F.col("id") == F.lit(s.seed)).first().publication_year
    return layout.in_clusters(s.clustered, s.seed, F.lit(year)).select("id", "cluster_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


#: Clusters of the drawn graph, in the order of a curator's reply; the last one has no members.
DRAWN = [("MACHINERY", "descendant"), ("AUTOMOBILE", "ancestor"), ("BUILDING", "ancestor"), ("FURNITURE", "contemporary"), ("HOUSEHOLD", "descendant"), ("NONE", "contemporary")]


def _super_nodes(s: Setting) -> DataFrame:
    clusters = s.spark.createDataFrame([(name, name.capitalize(), role, f"about {name}", k) for k, (name, role) in enumerate(DRAWN)], "id string, name string, role string, summary string, ord int")
    year = s.nodes.where(F.col("id") == F.lit(s.seed)).first().publication_year
    return layout.cluster_payload(clusters, s.clustered, s.seed, F.lit(year))


@query
def cluster_payload(spark, sf_dir):
    p = _super_nodes(Setting(spark, sf_dir))
    return p.select("id", "label", "summary", "role_label", "count", "span", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "background", F.round("size", 6).alias("size"))


@query
def legend_roles(spark, sf_dir):
    return layout.legend(_super_nodes(Setting(spark, sf_dir))).select(F.col("place").cast("long").alias("place"), "label", "colour")


@query
def members_by_year(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return layout.members(s.ranks.withColumn("cluster_id", F.col("venue")), s.seed).select("cluster_id", "id", F.col("place").cast("long").alias("place"))


@query
def contract_edges(spark, sf_dir):
    s = Setting(spark, sf_dir)
    every = s.ranks.withColumn("cluster_id", F.when(F.col("id") != F.lit(s.seed), F.col("venue")))
    cites = s.cites.select(F.col("src").alias("source"), F.col("tgt").alias("target"))
    return contract.contracted(cites, every, ["BUILDING"]).select("from", "to", "weight", F.round("width", 6).alias("width"), "label")


@query
def node_payload(spark, sf_dir):
    s = Setting(spark, sf_dir)
    place = layout.by_year(s.nodes, s.seed, spread=False)  # capped
    none = s.ranks.limit(0).select("id", F.lit("").alias("intent"))
    told = s.nodes.withColumns({"score": F.lit(0.0), "why": F.lit(""), "cluster_id": F.lit(None).cast("string"), "importance": F.lit(None).cast("int")})
    p = contract.node_payload(told, s.seed, place, relate.relationships(s.nodes, s.enriched.edges, s.seed), none)
    return p.select("id", "label", "is_seed", "background", "border", F.round("size", 6).alias("size"), "border_width", F.col("font_size").cast("long").alias("font_size"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query
def edge_payload(spark, sf_dir):
    return contract.edge_payload(Setting(spark, sf_dir).edges)


@query
def paper_description(spark, sf_dir):
    w = Setting(spark, sf_dir).works
    return w.select("id", F.md5(wording.description(F.col("title"), F.col("authors"), F.col("publication_year"), F.col("cited_by_count"), F.col("abstract"))).alias("description_md5"), wording.author_line(F.col("authors")).alias("author_line"))


# Attempts and requests


def _attempts(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events").where("event_type in ('error', 'signup')")
    return e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("failed"))


@query
def throttle_failure_count(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("failed"))
    return throttle.failure_counts(e, THROTTLE_S).select("key", "id", "n")


@query
def login_throttle(spark, sf_dir):
    return throttle.login_decisions(_attempts(spark, sf_dir), THROTTLE_S, THROTTLE_LIMIT)


@query
def login_throttle_stream(spark, sf_dir):
    """The same rule over the events table read as a stream, run until it has no more."""
    from ..streaming import login
    # A file stream reads folders; a one-file table is found in its own by name, where it is.
    many = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(many.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    attempts = stream.where("event_type in ('error', 'signup')").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("failed"))
    out = new_path(spark, "decisions")
    said = login.login_decisions(attempts, THROTTLE_S, THROTTLE_LIMIT)
    run = said.writeStream.format("parquet").option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True).start(out)
    run.awaitTermination()
    return spark.read.schema(said.schema).parquet(out)


@query
def request_spacing(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))
    return throttle.spacing(e, 3600.0).select("id", F.round("gap_s", 6).alias("gap_s"), F.round("wait_s", 6).alias("wait_s"))


def _read_back(spark, json_row: DataFrame) -> dict[str, DataFrame]:
    """A graph's JSON document written to a file and read again."""
    from .lineage import write_text

    path = new_path(spark, "graph") + ".json"
    write_text(spark, path, json_row.first().json)
    return records.read_graph(spark, path)


@query
def filtered_graph_json(spark, sf_dir):
    """The kept graph as a JSON file, read back."""
    from .lineage import graph_json

    s = Setting(spark, sf_dir)
    g = select.filter_by_idea(s.nodes, s.edges, s.seed, IDEA, TOP_K)
    got = _read_back(spark, graph_json(g, s.seed, IDEA, TOP_K))
    meta = got["meta"].select("seed_id", "idea_text", F.col("top_k").cast("long").alias("top_k"), "curation")
    return got["nodes"].select("id", "title", "hop", "bm25_score", "ord").crossJoin(meta)  # one row


@query
def expansion_json(spark, sf_dir):
    """The expansion as a JSON file, read back: its edges, with the nodes at their ends."""
    from . import lineage

    s = Setting(spark, sf_dir)
    got = _read_back(spark, lineage.expansion_json(s.nodes, s.edges, s.seed, False))
    n = got["nodes"].select("id", "hop", "cited_by_count")
    ends = [n.select(*(F.col(c).alias(f"{side}_{c}") for c in n.columns)) for side in ("source", "target")]
    out = got["edges"].select("source", "target", "ord").join(ends[0], F.col("source") == F.col("source_id")).join(ends[1], F.col("target") == F.col("target_id"))
    return out.select("source", "target", "ord", "source_hop", "target_hop", "source_cited_by_count", "target_cited_by_count")


@query
def graphs_json(spark, sf_dir):
    """The neighbourhoods of the 50 most cited works as a JSON file each, saved in the tasks and read back."""
    from . import lineage
    from ..sources import documents

    s = Setting(spark, sf_dir)
    seeds = s.ranks.orderBy(F.desc("cited_by_count"), "id").limit(50).select("id")
    folder = new_path(spark, "graphs")
    documents.save(lineage.neighbourhoods(s.ranks, s.cites, seeds, 3, s.records), folder)
    kind = "struct<seed_id:string,nodes:array<struct<id:string,title:string,cited_by_count:long,hop:int>>,edges:array<struct<source:string,target:string>>>"
    read_back = documents.load(spark, folder).select("name", F.from_json("text", kind).alias("g"))
    return read_back.select("name", F.array_join(F.transform("g.edges", lambda e: F.concat(e["source"], F.lit(">"), e["target"])), ",").alias("edges"), F.posexplode("g.nodes").alias("ord", "n")).select(F.col("name").alias("seed_id"), "ord", "n.*", "edges")


@query
def run_summary(spark, sf_dir):
    from . import lineage

    s = Setting(spark, sf_dir)
    return lineage.run_summary(s.expansion, _curated(s), s.enriched.report, s.seed)


@query
def lineage_bm25(spark, sf_dir):
    """The whole keyword pipeline: expand, enrich, score, cut, relate, place."""
    from .lineage import keyword_lineage

    s = Setting(spark, sf_dir)
    return keyword_lineage(s.ranks, s.cites, s.refs, s.seed, IDEA, CAPS, TOP_K, s.records)
