"""Raw source records (JSON text) to works and neighbours, and graphs to and from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import blank_to_null, work_id
from ..functions.text import abstract

#: The nested shapes of the two sources, as far as they are read.
WORK = "struct<id:string,display_name:string,title:string,publication_year:int,cited_by_count:bigint,authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<source:struct<display_name:string>,landing_page_url:string>,doi:string,ids:struct<doi:string,mag:string>,referenced_works:array<string>,abstract_inverted_index:map<string,array<int>>>"
PAPER = "struct<paperId:string,externalIds:map<string,string>,title:string,abstract:string,year:int,venue:string,citationCount:bigint,authors:array<struct<name:string>>>"
NEIGHBOURS = f"struct<data:array<struct<intents:array<string>,isInfluential:boolean,citedPaper:{PAPER},citingPaper:{PAPER}>>>"


def present(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))


def works_from_json(raw: DataFrame, column: str) -> DataFrame:
    """Works of the first source; absent fields take their defaults, text that isn't a record gives no row."""
    r = F.col("r")
    landing = r["primary_location"]["landing_page_url"]
    told_doi = F.coalesce(blank_to_null(r["ids"]["doi"]), blank_to_null(r["doi"]))
    external = F.create_map(
        F.lit("doi"), F.lower(F.replace(told_doi, F.lit("https://doi.org/"), F.lit(""))),
        F.lit("mag"), r["ids"]["mag"],
        F.lit("arxiv"), F.when(F.contains(landing, F.lit("arxiv.org/abs/")), F.substring_index(landing, "/", -1)),
    )
    names = F.transform(F.coalesce(r["authorships"], F.array()), lambda a: a["author"]["display_name"])
    return raw.select(F.from_json(column, WORK).alias("r")).where(r["id"].isNotNull()).select(
        work_id(r["id"]).alias("id"),
        F.coalesce(blank_to_null(r["display_name"]), blank_to_null(r["title"]), F.lit("(untitled)")).alias("title"),
        r["publication_year"].alias("publication_year"),
        F.coalesce(r["cited_by_count"], F.lit(0)).alias("cited_by_count"),
        F.filter(names, lambda n: n.isNotNull() & (n != "")).alias("authors"),
        r["primary_location"]["source"]["display_name"].alias("venue"),
        r["doi"].alias("doi"),
        F.transform(F.coalesce(r["referenced_works"], F.array()), work_id).alias("referenced_works"),
        abstract(F.lit(""), r["abstract_inverted_index"]).alias("abstract"),
        present(external).alias("external_ids"),
        F.lit("openalex").alias("source"),
    )


def _paper(p: Column) -> list[Column]:
    told = F.coalesce(p["externalIds"], F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    doi = blank_to_null(told["DOI"])
    return [
        F.concat(F.lit("S2:"), p["paperId"]).alias("id"),
        F.coalesce(blank_to_null(p["title"]), F.lit("(untitled)")).alias("title"),
        p["year"].alias("publication_year"),
        F.coalesce(p["citationCount"], F.lit(0)).alias("cited_by_count"),
        F.filter(F.transform(F.coalesce(p["authors"], F.array()), lambda a: a["name"]), lambda n: n.isNotNull() & (n != "")).alias("authors"),
        blank_to_null(p["venue"]).alias("venue"),
        F.concat(F.lit("https://doi.org/"), doi).alias("doi"),
        F.coalesce(p["abstract"], F.lit("")).alias("abstract"),
        F.transform_keys(present(told), lambda k, v: F.lower(k)).alias("external_ids"),
        F.lit("s2").alias("source"),
    ]


def papers_from_json(raw: DataFrame, column: str) -> DataFrame:
    """Works of the second source; records without a paperId give no row."""
    return raw.select(F.from_json(column, PAPER).alias("p")).where(F.col("p.paperId") != "").select(*_paper(F.col("p")))


def neighbours_from_json(raw: DataFrame, column: str, key: str) -> DataFrame:
    """Neighbours in a reply of the second source; ``key`` is citedPaper or citingPaper. Adds intents (blank ones dropped), is_influential and place."""
    rows = raw.select(F.posexplode(F.from_json(column, NEIGHBOURS)["data"]).alias("place", "d")).where(F.col(f"d.{key}.paperId") != "")
    intents = F.filter(F.coalesce(F.col("d.intents"), F.array()), lambda i: i.isNotNull() & (F.trim(i) != ""))
    return rows.select("place", *_paper(F.col(f"d.{key}")), intents.alias("intents"), F.coalesce(F.col("d.isInfluential"), F.lit(False)).alias("is_influential"))


NODE_JSON = "struct<id:string,title:string,abstract:string,authors:array<string>,venue:string,publication_year:int,cited_by_count:bigint,doi:string,hop:int,external_ids:map<string,string>,bm25_score:double,cluster_id:string,importance:int,why:string>"
EDGE_JSON = "struct<source:string,target:string,intents:array<string>,is_influential:boolean>"
GRAPH_JSON = f"seed_id string, idea_text string, top_k int, truncated boolean, curation string, curation_notes string, narrative struct<headline:string,overview:string,beats:array<struct<title:string,text:string,node_ids:array<string>>>,model:string>, clusters array<struct<id:string,name:string,role:string,summary:string>>, nodes array<{NODE_JSON}>, edges array<{EDGE_JSON}>"


def read_graph(spark, path: str) -> dict[str, DataFrame]:
    """An expansion or filtered graph from a JSON file: ``meta``, ``clusters``, ``nodes`` and ``edges``. Fields that older files lack take their defaults."""
    doc = spark.read.schema(GRAPH_JSON).json(path, multiLine=True)
    node, edge = F.col("x"), F.col("x")
    nodes = doc.select(F.posexplode("nodes").alias("ord", "x")).select(
        node["id"].alias("id"), F.coalesce(node["title"], F.lit("(untitled)")).alias("title"), F.coalesce(node["abstract"], F.lit("")).alias("abstract"),
        F.coalesce(node["authors"], F.array()).alias("authors"), node["venue"].alias("venue"), node["publication_year"].alias("publication_year"),
        F.coalesce(node["cited_by_count"], F.lit(0)).alias("cited_by_count"), node["doi"].alias("doi"), F.coalesce(node["hop"], F.lit(0)).alias("hop"),
        F.coalesce(node["bm25_score"], F.lit(0.0)).alias("bm25_score"), node["cluster_id"].alias("cluster_id"), node["importance"].alias("importance"),
        F.coalesce(node["why"], F.lit("")).alias("why"), F.col("ord").cast("long").alias("ord"),
    )
    edges = doc.select(F.posexplode("edges").alias("ord", "x")).select(
        edge["source"].alias("source"), edge["target"].alias("target"), F.coalesce(edge["intents"], F.array()).alias("intents"),
        F.coalesce(edge["is_influential"], F.lit(False)).alias("is_influential"), F.col("ord").cast("long").alias("ord"),
    )
    clusters = doc.select(F.posexplode("clusters").alias("ord", "x")).select("x.*", "ord")
    meta = doc.select("seed_id", F.coalesce("idea_text", F.lit("")).alias("idea_text"), F.coalesce("top_k", F.lit(0)).alias("top_k"), F.coalesce("truncated", F.lit(False)).alias("truncated"), F.coalesce("curation", F.lit("bm25")).alias("curation"), F.coalesce("curation_notes", F.lit("")).alias("curation_notes"), "narrative")
    return {"meta": meta, "clusters": clusters, "nodes": nodes, "edges": edges}
