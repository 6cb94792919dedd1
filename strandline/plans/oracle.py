"""DuckDB text of the catalogue's queries, written from the semantics and not from the Spark plans."""

from __future__ import annotations

from ..functions import wording as W
from ..operators.prompts import MAX_BEATS
from ..sources.substrate import SQL as SUBSTRATE

ORACLE_SQL: dict[str, str] = {}
FANOUT, TOTAL, TOP_K, PREFILTER = 100, 500, 40, 120
IDEA = ["small", "red", "ring", "of", "the", "ancient", "widget"]
TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def _with(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ", ".join(p.strip().rstrip(",") for p in parts) + "\n" + select


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _case(column: str, table: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_text(k) if isinstance(k, str) else k} THEN {_text(v)}" for k, v in table.items()) + f" ELSE {default} END"


# The expansion


def _candidates(name: str, parents: str, fanout: int) -> str:
    return f"""{name} AS (
  SELECT parent, id, side, cited, pord, CASE WHEN side = 0 AND n <= {fanout} THEN pos ELSE rk END AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY parent, side ORDER BY cited DESC, pos, id) AS rk, count(*) OVER (PARTITION BY parent, side) AS n FROM (
      SELECT p.id AS parent, p.ord AS pord, tgt AS id, 0 AS side, pos, cited_by_count AS cited FROM {parents} p JOIN cites ON src = p.id JOIN works w ON w.id = tgt
      UNION ALL SELECT p.id, p.ord, src, 1, 0, cited_by_count FROM {parents} p JOIN cites ON tgt = p.id JOIN works w ON w.id = src)) WHERE rk <= {fanout}
)"""


def _expansion(total: int = TOTAL, fanout: int = FANOUT) -> str:
    admit = lambda cand, known, hop: f"""
    SELECT id, {hop} AS hop, cited, (SELECT count(*) FROM {known}) + row_number() OVER (ORDER BY cited DESC, pord, side, place, id) - 1 AS ord FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY pord, side, place, id) AS k FROM {cand} WHERE id NOT IN (SELECT id FROM {known})) WHERE k = 1"""  # noqa: E731
    return f"""
n0 AS (SELECT id, 0 AS hop, cited_by_count AS cited, CAST(0 AS BIGINT) AS ord FROM works WHERE id = (SELECT seed_id FROM seed)),
{_candidates("c1", "n0", fanout)},
a1 AS ({admit("c1", "n0", 1)}), l1 AS (SELECT * FROM a1 WHERE ord < {total}), n1 AS (SELECT * FROM n0 UNION ALL SELECT * FROM l1),
{_candidates("c2", "l1", fanout)},
a2 AS ({admit("c2", "n1", 2)}), n2 AS (SELECT * FROM n1 UNION ALL SELECT * FROM a2 WHERE ord < {total}),
met AS (SELECT 1 AS hop, * FROM c1 UNION ALL SELECT 2, * FROM c2),
pairs AS (SELECT CASE WHEN side = 0 THEN parent ELSE id END AS source, CASE WHEN side = 0 THEN id ELSE parent END AS target, hop, pord, side, place, id FROM met WHERE id IN (SELECT id FROM (SELECT id FROM n1 WHERE met.hop = 1 UNION ALL SELECT id FROM n2 WHERE met.hop = 2))),
firsts AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY hop, pord, side, place, id) AS k FROM pairs),
edges AS (SELECT source, target, row_number() OVER (ORDER BY hop, pord, side, place, id) - 1 AS ord FROM firsts WHERE k = 1),
nodes AS (SELECT n.id, hop, n.ord, title, abstract, publication_year, cited_by_count, authors, venue, doi FROM n2 n JOIN works w ON n.id = w.id)
"""


EXPANSION = _expansion()

# BM25


def _bm25(corpus: str, words: list[str], name: str = "scores") -> str:
    counts = {w: words.count(w) for w in words}
    asked = ", ".join(f"('{w}', {n})" for w, n in counts.items())
    return f"""
{name}_t AS (SELECT id, {TOKENS.format("trim(title || ' ' || abstract)")} AS t FROM {corpus}),
{name}_s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM {name}_t),
{name}_f AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS word FROM {name}_t) GROUP BY word),
{name}_i AS (SELECT word, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM {name}_f, {name}_s),
{name}_q AS (SELECT q.word, q.times, CASE WHEN idf >= 0 THEN idf ELSE 0.25 * (SELECT avg(idf) FROM {name}_i) END AS idf FROM (VALUES {asked}) q(word, times) JOIN {name}_i USING (word)),
{name}_w AS (SELECT id, word, count(*) AS f FROM (SELECT id, unnest(t) AS word FROM {name}_t) GROUP BY id, word),
{name} AS (SELECT t.id, round(coalesce((SELECT sum(times * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t.t) / mean))) FROM {name}_w w JOIN {name}_q q USING (word) WHERE w.id = t.id), 0), 6) AS score FROM {name}_t t, {name}_s)
"""


# Identifiers

SPELLINGS = """
spelt AS (
  SELECT o_orderkey,
    CASE o_orderkey % 7 WHEN 0 THEN 'https://openalex.org/W' || o_orderkey WHEN 1 THEN ' w' || o_orderkey WHEN 2 THEN 'S2:ab' || o_orderkey ELSE 'W' || o_orderkey END AS raw_id,
    CASE o_orderkey % 7 WHEN 0 THEN 'https://doi.org/10.0/A' || o_orderkey WHEN 1 THEN ' DOI:10.0/' || o_orderkey WHEN 2 THEN 'http://doi.org/10.0/' || o_orderkey WHEN 3 THEN '' WHEN 4 THEN 'https://doi.org/doi:10.0/' || o_orderkey WHEN 5 THEN '10.0/Xy' || o_orderkey END AS raw_doi,
    CASE WHEN o_orderkey % 7 IN (3, 5) THEN 'ARX.' || o_orderkey END AS arxiv
  FROM orders
), bare AS (
  SELECT *, nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(raw_doi)), '^https://doi\\.org/', ''), '^http://doi\\.org/', ''), '^doi:', ''), '') AS doi FROM spelt
)"""

ORACLE_SQL["normalize_work_id"] = _with(SPELLINGS, select="""
SELECT o_orderkey, CASE WHEN regexp_matches(s, '^[wW]') THEN upper(s) ELSE s END AS work_id FROM (SELECT o_orderkey, regexp_replace(trim(raw_id), '^https://openalex\\.org/', '') AS s FROM spelt)""")
ORACLE_SQL["normalize_doi"] = _with(SPELLINGS, select="SELECT o_orderkey, doi FROM bare")
ORACLE_SQL["dedupe_key"] = _with(SPELLINGS, select="""
SELECT o_orderkey, coalesce('doi:' || doi, 'arxiv:' || lower(arxiv), 'id:' || raw_id) AS dedupe_key, coalesce('DOI:' || doi, 'ARXIV:' || arxiv) AS seed_reference FROM bare""")
ORACLE_SQL["s2_reference"] = _with(SPELLINGS, select="""
SELECT o_orderkey, CASE
  WHEN regexp_matches(v, '^(?i:doi|arxiv|corpusid|mag|pmid|pmcid|url):.') THEN upper(split_part(v, ':', 1)) || substr(v, instr(v, ':'))
  WHEN regexp_matches(v, '^https?://doi\\.org/') THEN 'DOI:' || regexp_replace(v, '^https?://doi\\.org/', '')
  WHEN v LIKE '10.%' THEN 'DOI:' || v ELSE v END AS reference
FROM (SELECT o_orderkey, trim(coalesce(nullif(raw_doi, ''), 'arXiv:' || arxiv, raw_id)) AS v FROM spelt)""")
ORACLE_SQL["parse_source_record"] = _with(SUBSTRATE, "refs AS (SELECT src, string_agg('W' || tgt, '|' ORDER BY tgt) AS r FROM cites GROUP BY src)", select="""
SELECT 'W' || id AS id, CASE WHEN id % 3 = 0 THEN '(untitled)' ELSE title END AS title, publication_year, cited_by_count, array_to_string(authors, '|') AS authors, venue,
  CASE WHEN id % 3 = 0 THEN 'https://doi.org/10.0/Q' || id END AS doi, coalesce(r, '') AS referenced_works,
  CASE WHEN id % 3 = 0 THEN '10.0/q' || id END AS ext_doi, CASE WHEN id % 3 = 1 THEN CAST(id AS VARCHAR) END AS ext_arxiv
FROM works LEFT JOIN refs ON src = id""")
ORACLE_SQL["parse_neighbour_record"] = _with(SUBSTRATE, select="""
SELECT 'S2:' || id AS id, CASE WHEN id % 4 <> 0 THEN title ELSE '(untitled)' END AS title, publication_year, cited_by_count, array_to_string(authors, '|') AS authors, venue,
  'https://doi.org/10.0/Q' || id AS doi, CASE WHEN id % 3 = 0 THEN CAST(id AS VARCHAR) END AS ext_arxiv, 'background' AS intents, id % 2 = 0 AS is_influential
FROM works WHERE id % 5 <> 0""")
ORACLE_SQL["parse_paper_record"] = ORACLE_SQL["parse_neighbour_record"].replace(", 'background' AS intents, id % 2 = 0 AS is_influential", "")
ORACLE_SQL["reconstruct_abstract"] = "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS abstract_md5 FROM documents"

ORACLE_SQL["account_fields"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'user' || o_custkey || '@example.org' END AS email, sha256('code-' || o_custkey) AS invite,
  replace(replace(rtrim(to_base64(CAST(sha256(CAST(o_custkey AS VARCHAR)) AS BLOB)), '='), '+', '-'), '/', '_') AS token, sha256(CAST(o_custkey AS VARCHAR)) AS token_text,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS created, 900000000 - epoch_us(o_orderdate) // 1000000 BETWEEN -60 AND 2592000 AS current
FROM orders"""

_PADS = ["'" + "".join(f"\\x{k ^ pad:02X}" for k in b"a secret".ljust(64, b"\0")) + "'::BLOB" for pad in (0x36, 0x5C)]
ORACLE_SQL["session_tokens"] = f"""
WITH o AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) // 1000000 AS at, o_custkey || '.' || epoch_us(o_orderdate) // 1000000 AS said FROM orders)
SELECT o_orderkey, said || '.' || sha256({_PADS[1]} || unhex(sha256({_PADS[0]} || CAST(said AS BLOB)))) AS token,
  CASE WHEN o_orderkey % 5 > 1 AND o_orderkey % 3 >= 1 THEN o_custkey END AS user_id FROM o"""

# Text and search

ORACLE_SQL["tokenize_documents"] = f"""
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents)"""
ORACLE_SQL["bm25_scores_orders"] = _with(SUBSTRATE, _bm25("works", IDEA), select="SELECT id, score FROM scores")
ORACLE_SQL["bm25_scores_documents"] = _with("d AS (SELECT doc_id AS id, '' AS title, text AS abstract FROM documents)", _bm25("d", ["the", "reer", "of", "heonand"]), select="SELECT id, score FROM scores")
ORACLE_SQL["bm25_top_k"] = _with(SUBSTRATE, _bm25("works", IDEA), select="SELECT id, score FROM scores ORDER BY score DESC, id LIMIT 25")
ORACLE_SQL["bm25_indexed_top_k"] = ORACLE_SQL["bm25_top_k"]
ORACLE_SQL["title_similarity_join"] = _with(SUBSTRATE, f"""
wrong AS (SELECT id, CASE WHEN id % 3 = 0 THEN substr(title, 1, 4) || substr(title, 6) WHEN id % 3 = 1 THEN substr(title, 1, 7) || 'x' || substr(title, 8) ELSE upper(title) END AS title FROM works WHERE id % 50 = 0),
named AS (SELECT 0 AS side, id, array_to_string({TOKENS.format("title")}, ' ') AS t FROM wrong UNION ALL SELECT 1, id, array_to_string({TOKENS.format("title")}, ' ') FROM works),
grams AS (SELECT side, id, CASE WHEN length(t) >= 3 THEN list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) WHEN t <> '' THEN [t] ELSE [] END AS g FROM named),
each AS (SELECT side, id, len(g) AS n, unnest(g) AS gram FROM grams),
shared AS (SELECT a.id AS asked_id, b.id, a.n, b.n AS m, count(*) AS c FROM each a JOIN each b ON a.gram = b.gram AND b.n * 0.79 <= a.n AND a.n * 0.79 <= b.n WHERE a.side = 0 AND b.side = 1 GROUP BY ALL)""", select="""
SELECT asked_id, id, round(c::double / (n + m - c), 6) AS similarity FROM shared WHERE c::double / (n + m - c) >= 0.8""")
ORACLE_SQL["cache_segments"] = _with(SUBSTRATE, "asked AS (SELECT DISTINCT event_id * 3 AS id FROM events)", select="SELECT id, CASE WHEN id % 5 = 0 AND id < 30000 THEN 'third' WHEN id % 3 = 0 THEN 'second' ELSE 'first' END AS origin FROM works JOIN asked USING (id) WHERE id % 2 = 0 OR id % 3 = 0 OR (id % 5 = 0 AND id < 30000)")
# The query is the seed's own title, so its words are read from the table.
_OWN = "asked AS (SELECT word, count(*) AS times FROM (SELECT unnest(" + TOKENS.format("title") + ") AS word FROM works WHERE id = (SELECT seed_id FROM seed)) GROUP BY word)"
ORACLE_SQL["search_seed_candidates"] = _with(SUBSTRATE, _OWN, _bm25("works", ["x"]).replace("(VALUES ('x', 1)) q(word, times)", "asked q"), f"""
same AS (SELECT id FROM works WHERE array_to_string({TOKENS.format("title")}, ' ') = (SELECT array_to_string({TOKENS.format("title")}, ' ') FROM works WHERE id = (SELECT seed_id FROM seed)) ORDER BY cited_by_count DESC, id LIMIT 1),
found AS (SELECT id, 'title' AS matched_by, 0 AS source, CAST(0 AS DOUBLE) AS score FROM same UNION ALL (SELECT id, 'search', 1, score FROM scores ORDER BY score DESC, id LIMIT 10)),
once AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source) AS n FROM found)""", select="""
SELECT o.id, title, publication_year, cited_by_count, matched_by, CAST(row_number() OVER (ORDER BY source, score DESC, o.id) AS INTEGER) AS place FROM once o JOIN works w ON o.id = w.id WHERE n = 1""")
ORACLE_SQL["lookup_by_ids"] = _with(SUBSTRATE, "asked AS (SELECT DISTINCT event_id * 3 AS id FROM events)", select="SELECT a.id, CASE WHEN w.id IS NULL THEN 'missing' ELSE 'found' END AS state FROM asked a LEFT JOIN works w ON a.id = w.id")
ORACLE_SQL["lookup_by_doi"] = _with(SUBSTRATE, SPELLINGS, select="SELECT DISTINCT b.doi AS asked_doi, w.id FROM bare b JOIN works w ON b.doi = '10.0/' || w.id")
ORACLE_SQL["cache_merge"] = _with(SUBSTRATE, select="SELECT id, CASE WHEN publication_year >= 1998 THEN 'fetched' ELSE 'cache' END AS origin FROM works WHERE cited_by_count > 0 OR publication_year >= 1998")
_TOP = "SELECT {a} AS {name}, w.id, w.cited_by_count, row_number() OVER (PARTITION BY {a} ORDER BY w.cited_by_count DESC, w.id) AS rank FROM cites JOIN works w ON w.id = {b} JOIN works k ON k.id = {a} QUALIFY rank <= {n}"
ORACLE_SQL["citing_works_top_n"] = _with(SUBSTRATE, select=_TOP.format(a="tgt", b="src", name="cited_id", n=3))
ORACLE_SQL["references_top_n"] = _with(SUBSTRATE, select=_TOP.format(a="src", b="tgt", name="citing_id", n=2))
ORACLE_SQL["citing_works_sample"] = _with(SUBSTRATE, select="SELECT tgt AS cited_id, w.id FROM cites JOIN works w ON w.id = src JOIN works k ON k.id = tgt QUALIFY row_number() OVER (PARTITION BY tgt ORDER BY md5(w.id || ':11'), w.id) <= 2")

# Expansion and enrichment

ORACLE_SQL["expand_nodes"] = _with(SUBSTRATE, EXPANSION, select="SELECT id, hop, cited_by_count, ord FROM nodes")
ORACLE_SQL["expand_edges"] = _with(SUBSTRATE, EXPANSION, select="SELECT source, target, ord FROM edges")
ORACLE_SQL["expand_nodes_tight"] = _with(SUBSTRATE, _expansion(60, 3), select="SELECT id, hop, cited_by_count, ord FROM nodes")
ORACLE_SQL["expand_edges_tight"] = _with(SUBSTRATE, _expansion(60, 3), select="SELECT source, target, ord FROM edges")
ORACLE_SQL["expand_truncated"] = _with(SUBSTRATE, _expansion(10, 3), select="SELECT (SELECT count(*) FROM a1 WHERE ord >= 10) + (SELECT count(*) FROM a2 WHERE ord >= 10) > 0 AS truncated")
ORACLE_SQL["expand_hop_counts"] = _with(SUBSTRATE, EXPANSION, select="SELECT CAST(hop AS BIGINT) AS hop, count(*) AS n FROM nodes GROUP BY hop")
# Every neighbour's DOI resolves to the work with its number, however it is spelt.
ENRICHED = """
told AS (SELECT l_orderkey AS k, min(l_returnflag) AS flag, max(l_discount) AS discount FROM lineitem GROUP BY l_orderkey),
near AS (
  SELECT tgt AS id, 'cited' AS direction, 0 AS side FROM cites WHERE src = (SELECT seed_id FROM seed) UNION ALL SELECT src, 'citing', 1 FROM cites WHERE tgt = (SELECT seed_id FROM seed)
), refs AS (
  SELECT id, direction, CASE WHEN id % 5 = 0 THEN '' WHEN flag = 'A' THEN 'methodology' WHEN flag = 'R' THEN 'result' ELSE 'background' END AS intents, discount >= 0.08 AS is_influential, side * 1000000000000 + id AS ord FROM near JOIN told ON k = id
), first_refs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS nth FROM refs) WHERE nth = 1),
hits AS (
  SELECT *, CASE WHEN direction = 'cited' THEN (SELECT seed_id FROM seed) ELSE id END AS source, CASE WHEN direction = 'cited' THEN id ELSE (SELECT seed_id FROM seed) END AS target FROM first_refs WHERE id IN (SELECT id FROM nodes)
), labelled AS (
  SELECT e.source, e.target, e.ord, coalesce(h.intents, '') AS intents, coalesce(h.is_influential, false) AS is_influential FROM edges e LEFT JOIN (SELECT * FROM hits WHERE intents <> '' OR is_influential) h ON e.source = h.source AND e.target = h.target
), filled AS (
  SELECT n.* EXCLUDE (abstract), CASE WHEN n.abstract = '' AND h.id IS NOT NULL THEN 'abstract of ' || n.id ELSE n.abstract END AS abstract FROM nodes n LEFT JOIN hits h ON n.id = h.id
)"""
_E = (SUBSTRATE.replace("told AS (", "parts AS (").replace("FROM told JOIN", "FROM parts JOIN"), EXPANSION, ENRICHED)
ORACLE_SQL["enrich_edge_intents"] = _with(*_E, select="SELECT source, target, intents, is_influential FROM labelled")
ORACLE_SQL["enrich_abstracts"] = _with(*_E, select="SELECT id, md5(abstract) AS abstract_md5 FROM filled")
ORACLE_SQL["enrich_report"] = _with(*_E, select="""
SELECT (SELECT count(*) FROM refs WHERE direction = 'cited') AS references_seen, (SELECT count(*) FROM refs WHERE direction = 'citing') AS citations_seen, (SELECT count(*) FROM hits) AS matched,
  (SELECT count(*) FROM first_refs) - (SELECT count(*) FROM hits) AS unmatched, (SELECT count(*) FROM labelled WHERE intents <> '' OR is_influential) AS edges_annotated,
  (SELECT count(*) FROM nodes n JOIN hits h ON n.id = h.id WHERE abstract = '') AS abstracts_filled""")

# Direction, relationship, selection


def _reach(edges: str, source: str, target: str) -> str:
    return f"""
up(id) AS (SELECT {target} FROM {edges} WHERE {source} = (SELECT seed_id FROM seed) UNION SELECT {target} FROM up JOIN {edges} ON {source} = up.id),
down(id) AS (SELECT {source} FROM {edges} WHERE {target} = (SELECT seed_id FROM seed) UNION SELECT {source} FROM down JOIN {edges} ON {target} = down.id)"""


_SIDE = "CASE WHEN {0} IN (SELECT id FROM up) AND {0} IN (SELECT id FROM down) THEN 'mixed' WHEN {0} IN (SELECT id FROM up) THEN 'ancestor' WHEN {0} IN (SELECT id FROM down) THEN 'descendant' ELSE 'unrelated' END"
ORACLE_SQL["classify_directions"] = _with(SUBSTRATE, _reach("cites", "src", "tgt"), select=f"SELECT id, {_SIDE.format('works.id')} AS direction FROM works WHERE id <> (SELECT seed_id FROM seed)")
ORACLE_SQL["classify_many_seeds"] = _with(SUBSTRATE, """
hundred AS (SELECT id FROM works ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 100),
far_up AS (SELECT id AS seed, id FROM hundred UNION SELECT u.seed, c.tgt FROM far_up u JOIN cites c ON c.src = u.id),
far_down AS (SELECT id AS seed, id FROM hundred UNION SELECT d.seed, c.src FROM far_down d JOIN cites c ON c.tgt = d.id),
met AS (SELECT seed, id, 1 AS side FROM far_up UNION ALL SELECT seed, id, 2 FROM far_down)""", select="SELECT seed, id, CASE sum(side) WHEN 1 THEN 'ancestor' WHEN 2 THEN 'descendant' ELSE 'mixed' END AS direction FROM met WHERE seed <> id GROUP BY seed, id")
SEED_INTENT = """
seed_intent AS (
  SELECT CASE WHEN source = (SELECT seed_id FROM seed) THEN target ELSE source END AS id, arg_max(concat_ws(', ', nullif(intents, ''), CASE WHEN is_influential THEN 'influential' END), ord) AS intent
  FROM labelled WHERE (SELECT seed_id FROM seed) IN (source, target) AND (intents <> '' OR is_influential) GROUP BY 1
)"""
ORACLE_SQL["seed_edge_intents"] = _with(*_E, SEED_INTENT, select="SELECT id, intent FROM seed_intent")


def _relation(nodes: str, edges: str) -> str:
    intent = _case("intents", W.INTENT_WORDS, "intents")
    return f"""
ends AS (SELECT *, (SELECT seed_id FROM seed) AS s FROM {edges} WHERE source <> target),
direct AS (SELECT * FROM (SELECT CASE WHEN source = s THEN target ELSE source END AS id, source = s AS from_seed, intents, is_influential, row_number() OVER (PARTITION BY CASE WHEN source = s THEN target ELSE source END ORDER BY ord) AS k FROM ends WHERE s IN (source, target)) WHERE k = 1),
clause AS (SELECT *, concat_ws('; ', CASE WHEN intents <> '' THEN 'cited for ' || {intent} END, CASE WHEN is_influential THEN 'flagged as an influential citation' END) AS c FROM direct),
ways AS (SELECT source AS id, target AS bridge, true AS forth, ord FROM ends WHERE s NOT IN (source, target) UNION ALL SELECT target, source, false, ord FROM ends WHERE s NOT IN (source, target)),
bridges AS (SELECT * FROM (SELECT w.*, d.from_seed, n.title AS bt, row_number() OVER (PARTITION BY w.id ORDER BY w.ord) AS k FROM ways w JOIN direct d ON w.bridge = d.id JOIN {nodes} n ON n.id = w.bridge WHERE w.id NOT IN (SELECT id FROM direct)) WHERE k = 1),
related AS (
  SELECT n.id, CASE
    WHEN n.id = (SELECT seed_id FROM seed) THEN {_text(W.SEED_TEXT)}
    WHEN d.id IS NOT NULL THEN CASE WHEN d.from_seed THEN {_text(W.BUILT_ON)} ELSE {_text(W.GREW_OUT)} END || CASE WHEN c <> '' THEN ' (' || upper(substr(c, 1, 1)) || lower(substr(c, 2)) || '.)' ELSE '' END
    WHEN b.id IS NOT NULL THEN 'Two hops from the seed via "' || bt || '": ' || CASE WHEN forth THEN '"' || n.title || '" cites "' || bt || '"' ELSE '"' || bt || '" cites "' || n.title || '"' END || '; '
      || CASE WHEN b.from_seed THEN '"the seed paper" cites "' || bt || '"' ELSE '"' || bt || '" cites "the seed paper"' END || '.'
    ELSE 'Reached ' || hop || ' hop(s) from the seed during traversal, but the connecting paper(s) didn''t make the relevance cutoff, so the direct path isn''t shown.' END AS relationship,
    CASE WHEN n.id = (SELECT seed_id FROM seed) THEN 'seed' WHEN d.id IS NOT NULL THEN 'direct' WHEN b.id IS NOT NULL THEN 'bridge' ELSE 'none' END AS kind
  FROM {nodes} n LEFT JOIN clause d ON n.id = d.id LEFT JOIN bridges b ON n.id = b.id
)"""


def _kept(nodes: str) -> str:
    return _bm25(nodes, IDEA) + f""",
best AS (SELECT n.id FROM {nodes} n JOIN scores s ON n.id = s.id WHERE n.id <> (SELECT seed_id FROM seed) ORDER BY score DESC, ord LIMIT {TOP_K}),
kept AS (SELECT n.*, score, row_number() OVER (ORDER BY score DESC, ord) AS rank FROM {nodes} n JOIN scores s ON n.id = s.id WHERE n.id IN (SELECT id FROM best) OR n.id = (SELECT seed_id FROM seed)),
kept_edges AS (SELECT source, target, ord, '' AS intents, false AS is_influential FROM edges WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept))"""


ORACLE_SQL["describe_relationship"] = _with(*_E, _relation("nodes", "labelled"), select="SELECT id, relationship, kind FROM related")
ORACLE_SQL["relationship_after_filter"] = _with(*_E, _kept("nodes"), _relation("kept", "kept_edges"), select="SELECT id, relationship, kind FROM related")
ORACLE_SQL["filter_by_idea_nodes"] = _with(*_E, _kept("nodes"), select="SELECT id, hop, score, rank FROM kept")
ORACLE_SQL["filter_by_idea_edges"] = _with(*_E, _kept("nodes"), select="SELECT source, target FROM kept_edges")
CANDIDATES = _bm25("nodes", IDEA) + "," + _reach("edges", "source", "target") + "," + SEED_INTENT + f""",
candidates AS (
  SELECT n.*, score, {_SIDE.format("n.id")} AS direction, coalesce(intent, '') AS intent, row_number() OVER (ORDER BY score DESC, cited_by_count DESC, ord) AS index
  FROM nodes n JOIN scores s ON n.id = s.id LEFT JOIN seed_intent i ON n.id = i.id WHERE n.id <> (SELECT seed_id FROM seed) QUALIFY index <= {PREFILTER}
)"""


def _described(t: str) -> str:
    flat = f"replace(trim({t}.abstract), chr(10), ' ')"
    short = f"CASE WHEN length({flat}) > 320 THEN regexp_replace(substr({flat}, 1, 320), ' [^ ]*$', '') || '…' ELSE {flat} END"
    head = f"{t}.title || ' (' || coalesce(regexp_extract({t}.authors[1], '([^ ]+) *$', 1), 'unknown') || CASE WHEN len({t}.authors) > 1 THEN ' et al.' ELSE '' END || ', ' || coalesce(CAST({t}.publication_year AS VARCHAR), 'n.d.') || ', ' || {t}.cited_by_count || ' citations)'"
    return f"{head} || CASE WHEN {flat} <> '' THEN chr(10) || {short} ELSE '' END"


ORACLE_SQL["prefilter_candidates"] = _with(*_E, CANDIDATES, select="SELECT index, id, score, direction, intent FROM candidates")
ORACLE_SQL["candidate_prompt_lines"] = _with(*_E, CANDIDATES, select=f"""
SELECT index, md5('[' || index || '] (' || direction || CASE WHEN intent <> '' THEN ', citation intent: ' || intent ELSE '' END || ') ' || {_described("c")}) AS line_md5 FROM candidates c""")
# What the catalogue's canned replies come to, read by hand.
CURATED = """
picks(index, cluster_id, importance, why, nth) AS (VALUES (1, 'b', 5, 'first', 0), (3, 'a', 2, '', 1), (5, 'other', 3, '', 4), (8, 'other', 3, '', 6), (4, 'a', 1, '', 7)),
chosen AS (
  SELECT c.id, score, cluster_id, importance, p.why, c.title, c.publication_year, row_number() OVER (ORDER BY importance DESC, score DESC, nth) + 1 AS rank FROM picks p JOIN candidates c USING (index)
), final AS (
  SELECT (SELECT seed_id FROM seed) AS id, CAST(0 AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS cluster_id, 5 AS importance, 'The seed paper this map is built around.' AS why, 1 AS rank UNION ALL SELECT id, score, cluster_id, importance, why, rank FROM chosen
)"""
ORACLE_SQL["curated_graph"] = _with(*_E, CANDIDATES, CURATED, select="SELECT id, CAST(score AS DOUBLE) AS score, cluster_id, CAST(importance AS BIGINT) AS importance, why, CAST(rank AS BIGINT) AS rank FROM final")
ORACLE_SQL["curated_edges"] = _with(*_E, CANDIDATES, CURATED, select="SELECT source, target, intents, is_influential FROM labelled WHERE source IN (SELECT id FROM final) AND target IN (SELECT id FROM final)")
ORACLE_SQL["curated_clusters"] = "SELECT * FROM (VALUES ('a', 'Earlier', 'ancestor', 's2'), ('b', 'Late', 'contemporary', ''), ('other', 'Other related work', 'contemporary', '')) t(id, name, role, summary)"
ORACLE_SQL["lineage_beats"] = _with(*_E, CANDIDATES, CURATED, f"""
cited(beat, title, text, p) AS (VALUES (1, 't1', 'x1', [1, 2]), (2, '', 'x3', []), (3, 't4', 'x4', [3, 2]), (4, 't5', 'x5', []), (5, 't6', 'x6', []), (6, 't7', 'x7', [4]), (7, 't8', 'x8', [])),
numbers AS (SELECT beat, unnest(p) AS k, generate_subscripts(p, 1) AS place FROM cited)""", select=f"""
SELECT CAST(beat AS BIGINT) AS beat, any_value(cited.title) AS title, any_value(text) AS text, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY place), '') AS node_ids
FROM cited LEFT JOIN numbers USING (beat) LEFT JOIN chosen ON rank = k + 1 WHERE beat <= {MAX_BEATS} GROUP BY beat""")
ORACLE_SQL["identify_seed_reply"] = _with(SUBSTRATE, select="""
SELECT id, title AS search_query, CASE id % 7 WHEN 0 THEN title WHEN 1 THEN upper(title) WHEN 5 THEN replace(title, ' ', ', ') END AS title,
  CASE WHEN id % 7 = 2 THEN CAST(id AS VARCHAR) END AS arxiv_id, CASE WHEN id % 7 = 0 THEN doi END AS doi,
  CASE WHEN id % 7 = 5 THEN '' ELSE array_to_string(authors, '|') END AS authors, CASE WHEN id % 7 <> 5 THEN publication_year END AS year,
  CASE WHEN id % 7 = 5 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN id % 7 = 2 THEN '' ELSE 'because' END AS reasoning, CASE WHEN id % 7 = 0 THEN 'A:,B:n,C:' ELSE '' END AS alternatives
FROM works WHERE id % 7 IN (0, 1, 2, 5)""")
ORACLE_SQL["resolve_seed_guesses"] = _with(SUBSTRATE, select="""
SELECT id AS asked, id, CASE id % 7 WHEN 0 THEN 'doi' ELSE 'arxiv' END AS matched_by FROM works WHERE id % 7 IN (0, 2)
UNION ALL SELECT a.id, w.id, 'title' FROM works a JOIN (SELECT title, id FROM works QUALIFY row_number() OVER (PARTITION BY title ORDER BY cited_by_count DESC, id) = 1) w ON a.title = w.title WHERE a.id % 7 IN (1, 5)""")
ORACLE_SQL["run_summary"] = _with(*_E, CANDIDATES, CURATED, select="""
SELECT CAST(id AS VARCHAR) AS seed_id, title AS seed_title, publication_year AS seed_year, (SELECT count(*) FROM nodes) AS expanded, (SELECT count(*) FROM final) AS kept,
  (SELECT count(*) FROM labelled WHERE source IN (SELECT id FROM final) AND target IN (SELECT id FROM final)) AS edges, CAST(3 AS BIGINT) AS clusters,
  (SELECT count(*) FROM a1 WHERE ord >= 500) + (SELECT count(*) FROM a2 WHERE ord >= 500) > 0 AS truncated, (SELECT count(*) FROM labelled WHERE intents <> '' OR is_influential) AS intents_labelled,
  'llm' AS curation, '' AS headline, 0 AS beats
FROM nodes WHERE id = (SELECT seed_id FROM seed)""")
ORACLE_SQL["filtered_graph_json"] = _with(*_E, _kept("nodes"), select=f"""
SELECT CAST(id AS VARCHAR) AS id, title, hop, score AS bm25_score, rank - 1 AS ord, CAST((SELECT seed_id FROM seed) AS VARCHAR) AS seed_id, '{" ".join(IDEA)}' AS idea_text, CAST({TOP_K} AS BIGINT) AS top_k, 'bm25' AS curation FROM kept""")
ORACLE_SQL["expansion_json"] = _with(SUBSTRATE, EXPANSION, select="""
SELECT CAST(source AS VARCHAR) AS source, CAST(target AS VARCHAR) AS target, e.ord, s.hop AS source_hop, t.hop AS target_hop, s.cited_by_count AS source_cited_by_count, t.cited_by_count AS target_cited_by_count
FROM edges e JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target""")
ORACLE_SQL["graphs_json"] = _with(SUBSTRATE, """
many AS (SELECT id AS seed_id FROM works ORDER BY cited_by_count DESC, id LIMIT 50),
ends AS (
  SELECT src AS s, tgt AS id, src AS source, tgt AS target, 1 AS side FROM cites WHERE src IN (FROM many)
  UNION ALL SELECT tgt, src, src, tgt, 2 FROM cites WHERE tgt IN (FROM many)),
near AS (SELECT s, e.id, source, target, side, row_number() OVER (PARTITION BY s, side ORDER BY cited_by_count DESC, e.id) AS rk FROM ends e JOIN works w ON w.id = e.id QUALIFY rk <= 3),
placed AS (SELECT s, id, min(side * 10 + rk) AS place FROM (SELECT s, id, side, rk FROM near UNION ALL SELECT seed_id, seed_id, 0, 0 FROM many) GROUP BY s, id),
lines AS (SELECT s, string_agg(source || '>' || target, ',' ORDER BY side, rk) AS edges FROM near GROUP BY s)""", select="""
SELECT CAST(s AS VARCHAR) AS seed_id, CAST(row_number() OVER (PARTITION BY s ORDER BY place) - 1 AS INTEGER) AS ord, CAST(id AS VARCHAR) AS id, title, cited_by_count, CASE WHEN place = 0 THEN 0 ELSE 1 END AS hop, coalesce(edges, '') AS edges
FROM placed JOIN works USING (id) LEFT JOIN lines USING (s)""")

# Layout and drawing


def _diagonal(year: str, seed_year: str, first: str, last: str) -> str:
    return f"CASE WHEN {year} IS NULL OR {seed_year} IS NULL THEN 0 WHEN {year} <= {seed_year} THEN CASE WHEN {seed_year} > {first} THEN -(({seed_year} - {year}) / CAST({seed_year} - {first} AS DOUBLE)) ELSE 0 END ELSE ({year} - {seed_year}) / CAST({last} - {seed_year} AS DOUBLE) END"


def _year_layout(nodes: str, name: str = "flat") -> str:
    return f"""
{name}_y AS (SELECT (SELECT publication_year FROM {nodes} WHERE id = (SELECT seed_id FROM seed)) AS sy, min(publication_year) AS y0, max(publication_year) AS y1 FROM {nodes}),
{name}_c AS (SELECT 70.0 * (1 + 0.08 * greatest(0, max(n) - 4)) AS step FROM (SELECT count(*) AS n FROM {nodes} GROUP BY publication_year)),
{name}_p AS (
  SELECT id, step, {_diagonal("publication_year", "sy", "y0", "y1")} * 900 AS base,
    (row_number() OVER (PARTITION BY publication_year ORDER BY id) - 1 - (count(*) OVER (PARTITION BY publication_year) - 1) / 2.0) * step AS aside FROM {nodes}, {name}_y, {name}_c
), {name} AS (
  SELECT id, CASE WHEN id = (SELECT seed_id FROM seed) THEN 0.0 ELSE base + (CASE WHEN base = 0 AND aside = 0 THEN step / 2 ELSE aside END) / sqrt(2) END AS x,
    CASE WHEN id = (SELECT seed_id FROM seed) THEN 0.0 ELSE base - (CASE WHEN base = 0 AND aside = 0 THEN step / 2 ELSE aside END) / sqrt(2) END AS y FROM {name}_p
)"""


def _clusters(nodes: str) -> str:
    return f"""
members AS (SELECT id, venue AS cluster_id, publication_year FROM {nodes} WHERE id <> (SELECT seed_id FROM seed)),
stats AS (SELECT cluster_id, count(*) AS n, list_sort(list(publication_year))[count(publication_year) // 2 + 1] AS median_year, min(publication_year) || '–' || max(publication_year) AS span FROM members GROUP BY cluster_id),
lanes AS (SELECT *, row_number() OVER (ORDER BY median_year IS NULL, median_year, cluster_id) - 1 AS lane, min(median_year) OVER () AS y0, max(median_year) OVER () AS y1, (SELECT seed_year FROM seed) AS sy FROM stats),
offsets AS (SELECT *, {_diagonal("median_year", "sy", "y0", "y1")} * 1500 AS base, ((lane + 1) // 2) * (CASE WHEN lane % 2 = 1 THEN 1 ELSE -1 END) * 520.0 / sqrt(2) AS o FROM lanes),
centres AS (SELECT cluster_id, n, median_year, span, base + o AS x, base - o AS y FROM offsets)"""


ORACLE_SQL["year_layout"] = _with(SUBSTRATE, _year_layout("works"), select="SELECT id, round(x, 3) AS x, round(y, 3) AS y FROM flat")
ORACLE_SQL["cluster_stats"] = _with(SUBSTRATE, _clusters("works"), select="SELECT cluster_id, n, CAST(median_year AS BIGINT) AS median_year, span, round(x, 6) AS x, round(y, 6) AS y FROM centres")
ORACLE_SQL["cluster_layout"] = _with(SUBSTRATE, EXPANSION, _clusters("nodes"), """
grid AS (SELECT m.id, m.cluster_id, row_number() OVER (PARTITION BY m.cluster_id ORDER BY coalesce(publication_year, 0), m.id) - 1 AS i, CAST(ceil(sqrt(n)) AS BIGINT) AS cols, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS rows, x, y FROM members m JOIN centres c USING (cluster_id))""", select="""
SELECT id, cluster_id, round(x + (i % cols - (cols - 1) / 2.0) * 190, 6) AS x, round(y + (i // cols - (rows - 1) / 2.0) * 190, 6) AS y FROM grid""")
_DRAWN = """
drawn(id, name, role, ord) AS (VALUES ('MACHINERY', 'Machinery', 'descendant', 0), ('AUTOMOBILE', 'Automobile', 'ancestor', 1), ('BUILDING', 'Building', 'ancestor', 2), ('FURNITURE', 'Furniture', 'contemporary', 3), ('HOUSEHOLD', 'Household', 'descendant', 4), ('NONE', 'None', 'contemporary', 5)),
shown AS (SELECT d.*, c.n, c.span, c.x, c.y FROM drawn d JOIN centres c ON d.id = c.cluster_id)"""
_ROLE = {"label": _case("role", W.ROLE_LABELS, "role"), "colour": _case("role", W.ROLE_COLOURS, _text(W.OTHER_COLOUR))}
ORACLE_SQL["cluster_payload"] = _with(SUBSTRATE, EXPANSION, _clusters("nodes"), _DRAWN, select=f"""
SELECT 'cluster:' || id AS id, name || chr(10) || '(' || n || ' papers)' AS label, 'about ' || id AS summary, {_ROLE["label"]} AS role_label, n AS count, span, round(x, 6) AS x, round(y, 6) AS y,
  {_ROLE["colour"]} AS background, round(26 + pow(least(n, 40), 0.6) * 6, 6) AS size FROM shown""")
ORACLE_SQL["legend_roles"] = _with(SUBSTRATE, EXPANSION, _clusters("nodes"), _DRAWN, select=f"""
SELECT CAST(0 AS BIGINT) AS place, {_text(W.SEED_LABEL)} AS label, {_text(W.SEED_COLOUR)} AS colour
UNION ALL SELECT row_number() OVER (ORDER BY first), {_ROLE["label"]}, {_ROLE["colour"]} FROM (SELECT role, min(ord) AS first FROM shown GROUP BY role)""")
ORACLE_SQL["members_by_year"] = _with(SUBSTRATE, select="SELECT venue AS cluster_id, id, row_number() OVER (PARTITION BY venue ORDER BY coalesce(publication_year, 0), id) AS place FROM works WHERE id <> (SELECT seed_id FROM seed)")
ORACLE_SQL["contract_edges"] = _with(SUBSTRATE, "shown AS (SELECT id, CASE WHEN id = (SELECT seed_id FROM seed) OR venue = 'BUILDING' THEN CAST(id AS VARCHAR) ELSE 'cluster:' || venue END AS shown FROM works)", select="""
SELECT t.shown AS "from", s.shown AS "to", count(*) AS weight, round(CAST(least(1.5 + (count(*) - 1) * 0.9, 7.0) AS DOUBLE), 6) AS width, CASE WHEN count(*) > 1 THEN CAST(count(*) AS VARCHAR) END AS label
FROM cites JOIN shown t ON t.id = tgt JOIN shown s ON s.id = src WHERE t.shown <> s.shown GROUP BY t.shown, s.shown""")
ORACLE_SQL["node_payload"] = _with(SUBSTRATE, EXPANSION, _year_layout("nodes"), select=f"""
SELECT n.id, regexp_extract(authors[1], '([^ ]+) *$', 1) || CASE WHEN len(authors) > 1 THEN ' et al.' ELSE '' END || ' ' || publication_year AS label, n.id = (SELECT seed_id FROM seed) AS is_seed,
  CASE WHEN n.id = (SELECT seed_id FROM seed) THEN '{W.SEED_COLOUR}' ELSE {_case("hop", W.HOP_COLOURS, _text(W.OTHER_COLOUR))} END AS background, CASE WHEN n.id = (SELECT seed_id FROM seed) THEN '{W.SEED_BORDER}' ELSE '{W.BORDER}' END AS border,
  round(14 + sqrt(least(cited_by_count, 5000)), 6) AS size, CASE WHEN n.id = (SELECT seed_id FROM seed) THEN CAST(3 AS DOUBLE) ELSE CAST(1.5 AS DOUBLE) END AS border_width, CAST(CASE WHEN n.id = (SELECT seed_id FROM seed) THEN 13 ELSE 11 END AS BIGINT) AS font_size, round(x, 6) AS x, round(y, 6) AS y
FROM nodes n JOIN flat f ON n.id = f.id""")
ORACLE_SQL["edge_payload"] = _with(SUBSTRATE, EXPANSION, select='SELECT target AS "from", source AS "to" FROM edges')
ORACLE_SQL["paper_description"] = _with(SUBSTRATE, select=f"SELECT id, md5({_described('w')}) AS description_md5, array_to_string(authors[1:4], ', ') || CASE WHEN len(authors) > 4 THEN ', et al.' ELSE '' END AS author_line FROM works w")

# Attempts and requests

ORACLE_SQL["throttle_failure_count"] = """
SELECT user_id AS key, event_id AS id, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 259200000000 PRECEDING AND CURRENT ROW) AS n FROM events"""
ORACLE_SQL["login_throttle"] = """
WITH RECURSIVE a AS (
  SELECT user_id AS key, event_id AS id, epoch_us(ts) AS us, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events WHERE event_type IN ('error', 'signup')
), fold AS (
  SELECT key, CAST(NULL AS BIGINT) AS id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS recent, false AS blocked FROM (SELECT DISTINCT key FROM a)
  UNION ALL
  SELECT key, id, k, CASE WHEN len(still) >= 2 THEN still WHEN failed THEN list_append(still, us) ELSE CAST([] AS BIGINT[]) END, len(still) >= 2
  FROM (SELECT a.key, a.id, a.k, a.us, a.failed, list_filter(f.recent, lambda t: a.us - t <= 259200000000) AS still FROM fold f JOIN a ON a.key = f.key AND a.k = f.k + 1)
)
SELECT key, id, blocked FROM fold WHERE k > 0"""
ORACLE_SQL["login_throttle_stream"] = ORACLE_SQL["login_throttle"]
ORACLE_SQL["request_spacing"] = """
SELECT id, round(gap, 6) AS gap_s, round(greatest(0.0, 3600 - gap), 6) AS wait_s FROM (
  SELECT event_id AS id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)) / 1000000.0 AS gap FROM events)"""
ORACLE_SQL["lineage_bm25"] = _with(*_E, _kept("filled"), _relation("kept", "kept_edges"), _year_layout("kept"), select="""
SELECT k.id, title, publication_year, cited_by_count, CAST(hop AS BIGINT) AS hop, score, rank, relationship, round(x, 6) AS x, round(y, 6) AS y FROM kept k JOIN related r ON k.id = r.id JOIN flat f ON k.id = f.id""")
