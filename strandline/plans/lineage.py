"""The composed pipelines and their sinks."""

from __future__ import annotations

import html
import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import LineageError, ReplyError
from ..functions import wording as W
from ..operators import contract, direction, layout, lookup, prompts, relate, select
from ..operators.enrich import enrich
from ..operators.expand import Caps, Expansion, expand
from ..sources import cache as works_cache
from ..sources.records import read_graph
from ..sources.shared import stored


#: Full works of a table of ids. Where they are costly to make, this makes only those asked for.
Records = Callable[[DataFrame], DataFrame]


def _records(e: Expansion, works: DataFrame, records: Records | None, seed=None, cache: str | None = None) -> DataFrame:
    """The nodes of an expansion as full works; capped, so written down once.

    With ``cache``, a folder, works that an earlier run of this seed has put
    there are not made again, and new ones are added to it.
    """
    ids = e.nodes.select("id")
    make = records or (lambda asked: works.join(asked, "id", "left_semi"))
    if cache is None:
        return stored(e.nodes.select("id", "hop", "ord").join(make(ids), "id"), "records")
    blank = make(ids)
    held = works_cache.lookup(works.sparkSession, cache, str(seed), blank.schema, ids)
    new = stored(make(lookup.missing(held, ids)), "fetched")
    full = lookup.cached_or_fetched(held, new)
    out = stored(e.nodes.select("id", "hop", "ord").join(full, "id"), "records")
    works_cache.save(new, cache, str(seed))
    return out


def keyword_lineage(works: DataFrame, cites: DataFrame, refs: DataFrame, seed, idea: str, caps: Caps = Caps(), top_k: int = 40, records: Records | None = None, cache: str | None = None) -> DataFrame:
    """The kept works of a keyword run, with score, rank, relationship and place. With ``records``, ``works`` needs id, cited_by_count and doi only."""
    e = expand(works, cites, seed, caps)
    nodes = _records(e, works, records, seed, cache)
    more = enrich(nodes, e.edges, works, refs, seed)
    g = select.filter_by_idea(more.nodes, more.edges, seed, idea, top_k)
    g = select.Graph(stored(g.nodes, "kept"), stored(g.edges, "kept-edges"))
    bare = g.edges.select("source", "target", F.array().cast("array<string>").alias("intents"), F.lit(False).alias("is_influential"), "ord")
    told = relate.relationships(g.nodes, bare, seed)
    placed = layout.by_year(g.nodes, seed, spread=False)  # top_k + 1 rows at most
    kept = g.nodes.join(told, "id").join(placed, "id")
    return kept.select("id", "title", "publication_year", "cited_by_count", F.col("hop").cast("long").alias("hop"), "score", F.col("rank").cast("long").alias("rank"), "relationship", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def curated_lineage(works: DataFrame, cites: DataFrame, refs: DataFrame, seed, idea: str, chat: prompts.Chat | None, caps: Caps = Caps(), shortlist: int = 120, max_keep: int = 35, top_k: int = 40, mode: str = "auto", warn: Callable[[str], None] = lambda text: None, records: Records | None = None, tell: bool = True, cache: str | None = None) -> select.Graph:
    """A curator's choice where there is one and its reply can be used; else, unless ``mode`` is llm, the keyword choice with a warning.

    With ``tell`` the model is then asked for the story of what it chose; where that fails, the graph comes without one, with a warning.
    """
    e = expand(works, cites, seed, caps)
    nodes = _records(e, works, records, seed, cache)
    more = enrich(nodes, e.edges, works, refs, seed)
    plain = lambda: select.filter_by_idea(more.nodes, more.edges, seed, idea, top_k)
    if mode == "bm25":
        return plain()
    if chat is None:
        if mode == "llm":
            raise ReplyError("no language model to ask")
        warn("no language model: kept by keywords")
        return plain()
    try:
        found = select.prefilter(more.nodes, direction.classify(nodes, e.edges, seed, capped=True), direction.seed_edge_intents(more.edges, seed), seed, idea, shortlist)
        found = stored(found, "candidates")
        lines = [r.line for r in prompts.candidate_lines(found).orderBy("index").collect()]  # shortlist rows
        about = prompts.descriptions(more.nodes.where(F.col("id") == F.lit(seed))).first().description
        reply = prompts.json_object(chat(prompts.curation_messages(about, idea, lines, max_keep)))
        g = select.curated(more.nodes, more.edges, found, works.sparkSession.createDataFrame([(json.dumps(reply),)], "reply string"), seed, max_keep)
        if g.nodes.where(F.col("id") != F.lit(seed)).isEmpty():
            raise ReplyError("the reply keeps no candidate")
    except LineageError as problem:
        if mode == "llm":
            raise
        warn(f"{problem}: kept by keywords")
        return plain()
    g = replace(g, nodes=stored(g.nodes, "kept"), edges=stored(g.edges, "kept-edges"), notes=str(reply.get("dropped_summary") or "").strip())
    if tell:
        try:
            g = replace(g, story=narrative(g, seed, idea, chat))
        except LineageError as problem:
            warn(f"{problem}: no story is told")
    return g


def narrative(g: select.Graph, seed, idea: str, chat: prompts.Chat) -> dict:
    """Headline, overview and beats that cite kept works by id."""
    clusters = g.clusters if g.clusters is not None else g.nodes.limit(0).select(F.lit("").alias("id"), F.lit("").alias("name"), F.lit("").alias("role"), F.lit("").alias("summary"), F.lit(0).alias("ord"))
    nodes = g.nodes if "why" in g.nodes.columns else g.nodes.withColumns({"why": F.lit(""), "cluster_id": F.lit(None).cast("string")})
    numbered = stored(prompts.paper_lines(nodes, clusters, seed), "numbered")
    papers = [r.line for r in numbered.orderBy("index").collect()]  # kept works
    groups = [f"- {r['name']} ({r['role']}): {r['summary']}" for r in clusters.orderBy("ord").collect()]
    title = nodes.where(F.col("id") == F.lit(seed)).first()
    if title is None or not papers:
        raise ReplyError("there is nothing to write about")
    reply = prompts.json_object(chat(prompts.narrative_messages(title.title, idea, groups, papers)))
    overview = str(reply.get("overview") or "").strip()
    if not overview:
        raise ReplyError("the reply has no overview")
    frame = nodes.sparkSession.createDataFrame([(json.dumps(reply),)], "reply string")
    beats = [{"title": r.title, "text": r.text, "node_ids": list(r.node_ids)} for r in prompts.beats_of(frame, numbered).orderBy("beat").collect()]
    return {"headline": str(reply.get("headline") or "").strip(), "overview": overview, "beats": beats}


def identify_seed(spark, description: str, chat: prompts.Chat) -> DataFrame:
    """One row of what a model takes a description to mean: ``prompts.guess_of``, and the ``sources`` and ``model`` that the reply tells of."""
    if not description.strip():
        raise ReplyError("there is no description")
    ask = "Name the published paper that the description means; null is better than an identifier that may be wrong. Answer with a JSON object: search_query (what finds it by title, always), title, arxiv_id, doi, authors (a list), year, confidence (high, medium or low), reasoning, alternatives (title, note; three at most)."
    said = chat([{"role": "system", "content": ask}, {"role": "user", "content": description.strip()}])
    row = (json.dumps(prompts.json_object(said)), list(getattr(said, "urls", [])), getattr(said, "model", ""))
    guess = prompts.guess_of(spark.createDataFrame([row], "reply string, sources array<string>, model string"))
    if guess.isEmpty():
        raise ReplyError("the reply has no search_query")
    return guess


def graph_json(g: select.Graph, seed, idea: str, top_k: int) -> DataFrame:
    """One row with the graph as a JSON document that can stand in a script element. A kept graph is capped, so it fits a row."""
    keep = [c for c in ("id", "title", "abstract", "authors", "venue", "publication_year", "cited_by_count", "doi", "hop", "score", "cluster_id", "importance", "why") if c in g.nodes.columns]
    node = F.struct("rank", *[F.col(c).cast("string").alias(c) if c == "id" else F.col(c).alias("bm25_score" if c == "score" else c) for c in keep])
    edge_fields = [F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), *(F.col(c) for c in ("intents", "is_influential") if c in g.edges.columns)]
    nodes = g.nodes.agg(F.transform(F.array_sort(F.collect_list(node)), lambda n: n.dropFields("rank")).alias("nodes"))
    edges = g.edges.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", *edge_fields))), lambda e: e.dropFields("ord")).alias("edges"))
    both = nodes.crossJoin(edges)  # one row each
    if g.clusters is not None:
        both = both.crossJoin(g.clusters.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "name", "role", "summary"))), lambda c: c.dropFields("ord")).alias("clusters")))
    meta = [F.lit(str(seed)).alias("seed_id"), F.lit(idea).alias("idea_text"), F.lit(top_k).alias("top_k"), F.lit(g.curation).alias("curation"), F.lit(g.notes).alias("curation_notes")]
    if g.story is not None:
        meta.append(F.from_json(F.lit(json.dumps(g.story)), STORY).alias("narrative"))
    return both.select(W.script_safe(F.to_json(F.struct(*meta, *both.columns))).alias("json"))


STORY = "struct<headline:string,overview:string,beats:array<struct<title:string,text:string,node_ids:array<string>>>,model:string>"


def expansion_json(nodes: DataFrame, edges: DataFrame, seed, truncated: bool) -> DataFrame:
    """One row with an expansion (capped, so it fits) as the JSON document that ``records.read_graph`` reads."""
    fields = [c for c in ("title", "publication_year", "cited_by_count", "authors", "venue", "abstract", "hop", "doi", "source") if c in nodes.columns]
    node = F.struct("ord", F.col("id").cast("string").alias("id"), *fields)
    edge = F.struct("ord", F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), *(c for c in ("intents", "is_influential") if c in edges.columns))
    listed = lambda of, x, name: of.agg(F.transform(F.array_sort(F.collect_list(x)), lambda r: r.dropFields("ord")).alias(name))
    both = listed(nodes, node, "nodes").crossJoin(listed(edges, edge, "edges"))  # one row each
    return both.select(F.to_json(F.struct(F.lit(str(seed)).alias("seed_id"), F.lit(truncated).alias("truncated"), "nodes", "edges")).alias("json"))


def neighbourhoods(works: DataFrame, cites: DataFrame, seeds: DataFrame, fanout: int = 100, records: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``name, text``: for each of ``seeds(id)`` that is a work, one hop both ways as a document in the form of ``expansion_json``.

    A seed has ``fanout`` works at most on either side, the most cited, so a
    document fits a row; seeds are dealt by key and share each step. Nodes
    stand as the seed, what it cites, what cites it. ``works`` needs id and
    cited_by_count only where ``records`` gives the full works of a table of ids.
    """
    end = lambda found, seed, source, target, side: found.select(F.col(seed).alias("seed"), "id", F.col(source).alias("source"), F.col(target).alias("target"), F.lit(side).alias("side"), "rank")
    cites = cites.where("src <> tgt")
    cited = end(lookup.references(works, cites, seeds, fanout), "citing_id", "citing_id", "id", 1)
    near = stored(cited.unionByName(end(lookup.citing(works, cites, seeds, fanout), "cited_id", "id", "cited_id", 2)), "near")
    own = lookup.by_ids(works, seeds).select(F.col("id").alias("seed"), "id", F.lit(0).alias("side"), F.lit(0).alias("rank"))
    place = F.struct("side", "rank").alias("ord")
    nodes = own.unionByName(near.select(*own.columns)).groupBy("seed", "id").agg(F.min(place).alias("ord"))
    ids = nodes.select("id").distinct()
    full = records(ids) if records else lookup.by_ids(works, ids)
    fields = [c for c in ("title", "publication_year", "cited_by_count", "authors", "venue", "abstract", "doi") if c in full.columns]
    hop = F.when(F.col("ord.side") == 0, 0).otherwise(1).alias("hop")
    key = lambda c: F.col(c).cast("string").alias(c)
    listed = lambda rows, name: F.transform(F.array_sort(F.collect_list(rows)), lambda r: r.dropFields("ord")).alias(name)
    nodes = nodes.join(full.select("id", *fields), "id").groupBy("seed").agg(listed(F.struct("ord", key("id"), *fields, hop), "nodes"))
    edges = near.groupBy("seed").agg(listed(F.struct(place, key("source"), key("target")), "edges"))
    none = F.array().cast("array<struct<source:string,target:string>>")
    both = nodes.join(edges, "seed", "left").withColumns({"edges": F.coalesce("edges", none), "seed_id": F.col("seed").cast("string")})
    return both.select(F.col("seed_id").alias("name"), F.to_json(F.struct("seed_id", "nodes", "edges")).alias("text"))


def load_graph(spark, path: str) -> tuple[select.Graph, str, str, int]:
    """A filtered graph from the JSON that ``graph_json`` makes, older ones too, with its seed, idea and top_k; ready to be drawn or summed up."""
    got = read_graph(spark, path)
    meta = got["meta"].first()
    nodes = got["nodes"].withColumnRenamed("bm25_score", "score").withColumn("rank", (F.col("ord") + 1).cast("int"))
    clusters = None if got["clusters"].isEmpty() else got["clusters"]
    story = meta.narrative.asDict(recursive=True) if meta.narrative else None
    return select.Graph(nodes, got["edges"], clusters, meta.curation, meta.curation_notes, story), meta.seed_id, meta.idea_text, meta.top_k


def run_summary(e: Expansion, g: select.Graph, report: DataFrame, seed) -> DataFrame:
    """One row of what a run came to: the seed, how much was met, kept and labelled, how it was chosen."""
    own = g.nodes.where(F.col("id") == F.lit(seed)).select(F.col("id").cast("string").alias("seed_id"), F.col("title").alias("seed_title"), F.col("publication_year").alias("seed_year"))
    count = lambda of, name: of.agg(F.count(F.lit(1)).alias(name))
    clusters = count(g.clusters, "clusters") if g.clusters is not None else own.sparkSession.range(1).select(F.lit(0).cast("long").alias("clusters"))
    one = own.crossJoin(count(e.nodes, "expanded")).crossJoin(count(g.nodes, "kept")).crossJoin(count(g.edges, "edges")).crossJoin(clusters)  # one row each
    one = one.crossJoin(e.refused).crossJoin(report.select(F.col("edges_annotated").alias("intents_labelled")))
    return one.withColumns({"curation": F.lit(g.curation), "headline": F.lit((g.story or {}).get("headline", "")), "beats": F.lit(len((g.story or {}).get("beats", [])))})


def write_text(spark, path: str, text: str) -> None:
    """One text file at ``path``, through Hadoop's file system, so that any store Spark writes to will do."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif;margin:1em}}svg{{width:100%;height:80vh;border:1px solid #ccc}}line{{stroke:#94a3b8}}section{{max-width:60em}}</style>
<h1>{title}</h1><p>{stats}</p><p>{legend}</p>{story}<svg viewBox="{box}">{groups}{lines}{dots}</svg>
<script type="application/json" id="graph">{data}</script>"""


def stats_line(nodes: int, edges: int, clusters: int, curation: str, top_k: int) -> str:
    """What a page shows and how it was chosen."""
    across = f" across {clusters} concept clusters" if clusters else ""
    chosen = f"selected as the lineage of the stated idea{across}" if curation == "llm" else f"top-{top_k} by keyword relevance to the stated idea"
    return f"{nodes} papers shown · {edges} citation edges · {chosen}"


def _story(story: dict | None, titles: dict[str, str]) -> str:
    if not story:
        return ""
    out = [f"<h2>{html.escape(story['headline'])}</h2>", *(f"<p>{html.escape(p.strip())}</p>" for p in story["overview"].split("\n\n") if p.strip())]
    for beat in story["beats"]:
        cited = "; ".join(titles[i] for i in beat["node_ids"] if i in titles)
        out.append(f"<h3>{html.escape(beat['title'])}</h3><p>{html.escape(beat['text'])}</p>" + (f"<p><small>{html.escape(cited)}</small></p>" if cited else ""))
    return "<section>" + "".join(out) + "</section>"


def page(g: select.Graph, seed, idea: str, top_k: int, title: str) -> str:
    """A page that draws the kept graph (capped, so collected), by clusters where it has some, tells its story and holds its JSON."""
    lacking = {"why": "string", "cluster_id": "string", "importance": "int"}
    nodes = stored(g.nodes.withColumns({c: F.lit(None).cast(k) for c, k in lacking.items() if c not in g.nodes.columns}), "drawn")
    labelled = g.edges if "intents" in g.edges.columns else g.edges.withColumns({"intents": F.array().cast("array<string>"), "is_influential": F.lit(False)})
    intents = direction.seed_edge_intents(labelled, seed)
    where = layout.positions(nodes, seed, spread=False) if g.clusters is not None else layout.by_year(nodes, seed, spread=False)
    drawn = {r.id: r for r in contract.node_payload(nodes, seed, where, relate.relationships(nodes, labelled, seed), intents).collect()}
    groups, legend = [], [(W.HOP_LABELS[h], c) for h, c in W.HOP_COLOURS.items()]
    if g.clusters is not None:
        year = drawn[seed].publication_year if seed in drawn else None
        payload = stored(layout.cluster_payload(g.clusters, nodes, seed, F.lit(year).cast("int"), spread=False), "super-nodes")
        groups = payload.orderBy("ord").collect()
        legend = [(r.label, r.colour) for r in layout.legend(payload).orderBy("place").collect()] if groups else legend
    edges = contract.edge_payload(g.edges).collect()
    points = [(r.x, r.y) for r in [*drawn.values(), *groups]] or [(0, 0)]
    (x0, y0), (x1, y1) = (tuple(f(p[k] for p in points) for k in (0, 1)) for f in (min, max))
    box = f"{x0 - 80:.0f} {y0 - 80:.0f} {x1 - x0 + 160:.0f} {y1 - y0 + 160:.0f}"
    lines = "".join(f'<line x1="{drawn[a].x:.1f}" y1="{drawn[a].y:.1f}" x2="{drawn[b].x:.1f}" y2="{drawn[b].y:.1f}"/>' for a, b in edges if a in drawn and b in drawn)
    dots = "".join(f'<g><circle cx="{r.x:.1f}" cy="{r.y:.1f}" r="{r.size / 2:.1f}" fill="{r.background}" stroke="{r.border}"/><title>{html.escape(f"{r.title}: {r.relationship}")}</title></g>' for r in drawn.values())
    rings = "".join(f'<g><circle cx="{r.x:.1f}" cy="{r.y:.1f}" r="{r.size:.1f}" fill="{r.background}" fill-opacity="0.35"/><text x="{r.x:.1f}" y="{r.y - r.size - 6:.1f}">{html.escape(r.label)}</text><title>{html.escape(" ".join(x for x in (r.role_label, r.span, r.summary) if x))}</title></g>' for r in groups)
    keys = " · ".join(f'<span style="color:{c}">{html.escape(label)}</span>' for label, c in legend)
    stats = stats_line(len(drawn), len(edges), len(groups), g.curation, top_k)
    story = _story(g.story, {str(r.id): r.title for r in drawn.values()})
    return PAGE.format(title=html.escape(title), stats=html.escape(stats), legend=keys, story=story, box=box, groups=rings, lines=lines, dots=dots, data=graph_json(g, seed, idea, top_k).first().json)
