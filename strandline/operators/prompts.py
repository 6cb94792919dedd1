"""Prompts for an injected language model, and what its replies say."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ReplyError
from ..functions import ids
from ..functions import wording as W
from .titles import plain

MAX_BEATS, MAX_ALTERNATIVES = 6, 3
#: What a model is: messages in, text out.
Chat = Callable[[list[dict]], str]
NARRATIVE = "struct<headline:string,overview:string,beats:array<struct<title:string,text:string,papers:array<string>>>>"
GUESS = "struct<title:string,search_query:string,arxiv_id:string,doi:string,authors:array<string>,year:string,confidence:string,reasoning:string,alternatives:array<string>>"
#: Fixed value: what stands before an arXiv id in the DOI that arXiv gives each of its papers.
ARXIV_DOI = "10.48550/arxiv."


def json_object(reply: str) -> dict:
    """The JSON object in a reply, which may stand in a code fence or between sentences."""
    text = reply.strip()
    if text.startswith("```"):
        text = text[3:].split("```", 1)[0].strip()
        text = text[4:].strip() if text[:4].lower() == "json" else text
    for part in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            value = json.loads(part)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
        break
    raise ReplyError(f"no JSON object in the reply: {reply[:300]}")


def object_text(c: Column) -> Column:
    """The JSON object in a column of replies, found as ``json_object`` finds it; null where there is none."""
    text = F.regexp_replace(c, r"^\s+|\s+$", "")
    body = F.when(F.startswith(text, F.lit("```")), F.split_part(text, F.lit("```"), F.lit(2))).otherwise(text)
    body = F.when(~body.rlike(r"^\s*\[(?s:.*)\]\s*$"), body)
    return F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit(""))


def cited_urls(message: dict) -> list[str]:
    """The addresses that a model's reply cites in its annotations, in order, each once."""
    notes = (note.get("url_citation") for note in message.get("annotations") or [] if isinstance(note, dict))
    urls = (note.get("url") for note in notes if isinstance(note, dict))
    return list(dict.fromkeys(url for url in urls if isinstance(url, str)))


def descriptions(nodes: DataFrame) -> DataFrame:
    """``id, description``: a paper as a prompt shows it."""
    return nodes.select("id", W.description(F.col("title"), F.col("authors"), F.col("publication_year"), F.col("cited_by_count"), F.col("abstract")).alias("description"))


def candidate_lines(candidates: DataFrame) -> DataFrame:
    """``index, line`` of a prefilter's output: number, direction, seed intent, description."""
    tags = F.concat("direction", F.when(F.col("intent") != "", F.concat(F.lit(", citation intent: "), "intent")).otherwise(""))
    told = W.description(F.col("title"), F.col("authors"), F.col("publication_year"), F.col("cited_by_count"), F.col("abstract"))
    return candidates.select("index", F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] ("), tags, F.lit(") "), told).alias("line"))


def curation_messages(seed_text: str, idea: str, lines: list[str], max_keep: int) -> list[dict]:
    system = (
        "Pick the papers that show how an idea grew around one paper. Every candidate has a number and a side (ancestor, descendant, mixed, unrelated), some the purpose of a citation. "
        f"Reply with one JSON object. clusters: id, name, role (ancestor, descendant or contemporary), summary. keep: i (the number), cluster, importance from 1 to 5, why; {max(5, max_keep // 3)} to {max_keep} of them. dropped_summary: what the others are about."
    )
    user = f"The idea to follow: {idea}\n\nThe paper it is followed around:\n{seed_text}\n\n{len(lines)} candidates:\n" + "\n".join(lines)
    return [{"role": "system", "content": system}, {"role": "user", "content": user}]


def narrative_messages(seed_title: str, idea: str, clusters: list[str], papers: list[str]) -> list[dict]:
    system = f"You write how an idea came about, from the papers given and nothing else. Answer with a JSON object: headline, overview, beats (title, text, papers: their numbers), {MAX_BEATS} beats at most."
    user = f"The idea: {idea}\nIt is followed around: {seed_title}\n\nGroups:\n" + "\n".join(clusters or ["- none"]) + f"\n\n{len(papers)} papers:\n" + "\n".join(papers)
    return [{"role": "system", "content": system}, {"role": "user", "content": user}]


def paper_lines(nodes: DataFrame, clusters: DataFrame, seed) -> DataFrame:
    """``index, id, line`` of the kept works but the seed, in their order (``rank``)."""
    from pyspark.sql import Window

    named = nodes.where(F.col("id") != F.lit(seed)).join(clusters.select(F.col("id").alias("cluster_id"), F.col("name").alias("cluster")), "cluster_id", "left")
    index = F.row_number().over(Window.orderBy("rank"))  # kept works: few
    parts = F.array(F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] "), F.coalesce(F.col("publication_year").cast("string"), F.lit("n.d.")), F.lit(" — "), F.col("title")), F.concat(F.lit("cluster: "), "cluster"), F.when(F.col("why") != "", F.concat(F.lit("role: "), "why")))
    return named.withColumn("index", index).select("index", "id", F.array_join(F.array_compact(parts), " | ").alias("line"))


def beats_of(reply: DataFrame, numbered: DataFrame, column: str = "reply") -> DataFrame:
    """``beat, title, text, node_ids``: the first MAX_BEATS beats with a text; unknown and repeated numbers are dropped, order is kept."""
    rows = reply.select(F.posexplode(F.from_json(column, NARRATIVE)["beats"]).alias("at", "b")).select("at", F.coalesce(W.clean_text(F.col("b.title")), F.lit("")).alias("title"), W.clean_text(F.col("b.text")).alias("text"), "b.papers").where("text is not null")
    rows = rows.orderBy("at").limit(MAX_BEATS)
    cited = rows.select("at", F.posexplode(F.coalesce("papers", F.array())).alias("place", "p")).select("at", "place", W.whole_number(F.col("p")).alias("index")).join(numbered.select("index", "id"), "index")
    once = cited.groupBy("at", "id").agg(F.min("place").alias("place"))
    ids = once.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("ids"))
    out = rows.join(ids, "at", "left").select("at", "title", "text", F.coalesce(F.transform("ids", lambda x: x["id"].cast("string")), F.array().cast("array<string>")).alias("node_ids"))
    from pyspark.sql import Window

    return out.select(F.row_number().over(Window.orderBy("at")).alias("beat"), "title", "text", "node_ids")


def guess_of(reply: DataFrame, column: str = "reply") -> DataFrame:
    """Seed guesses, one for each reply that has a search query; the table's other columns come along.

    Adds ``search_query, title, arxiv_id, doi, authors, year, confidence,
    reasoning, alternatives(title, note)``. Blank texts are null, but for
    confidence (``low``) and reasoning (empty); a year that is none is null;
    blank authors are left out, and alternatives without a title; three
    alternatives stay at most. A field of another kind than asked for, null
    and an empty reply take no other field with them.
    """
    told = reply.withColumn("__g", F.from_json(object_text(F.col(column)), GUESS))
    g, nothing = F.col("__g"), F.array().cast("array<string>")
    others = F.transform(F.coalesce(g["alternatives"], nothing), lambda a: F.from_json(a, "title string, note string"))
    others = F.transform(others, lambda a: F.struct(W.clean_text(a["title"]).alias("title"), F.coalesce(W.clean_text(a["note"]), F.lit("")).alias("note")))
    fields = {
        "search_query": W.clean_text(g["search_query"]),
        "title": W.clean_text(g["title"]),
        "arxiv_id": W.clean_text(g["arxiv_id"]),
        "doi": W.clean_text(g["doi"]),
        "authors": F.filter(F.coalesce(g["authors"], nothing), lambda a: F.trim(a) != ""),
        "year": W.valid_year(g["year"]),
        "confidence": F.coalesce(W.clean_text(g["confidence"]), F.lit("low")),
        "reasoning": F.coalesce(W.clean_text(g["reasoning"]), F.lit("")),
        "alternatives": F.slice(F.filter(others, lambda a: a["title"].isNotNull()), 1, MAX_ALTERNATIVES),
    }
    kept = [F.col(f"`{c}`") for c in reply.columns if c != column and c not in fields]
    return told.select(*kept, *(c.alias(name) for name, c in fields.items())).where("search_query is not null")


def resolved(works: DataFrame, guesses: DataFrame, key: str) -> DataFrame:
    """``key, id, matched_by`` of the guesses that name a work: by DOI, else by the DOI of their arXiv id, else by a title of the same tokens, blank ones never.

    Of several works of the best kind the most cited is taken, then the smallest
    id. Every way is a join by key, and a guess's ways are compared after a
    work has been picked for each. Nulls match nothing; ``key`` tells guesses apart.
    """
    def way(way: str, order: int, name: Column) -> Column:
        return F.struct(F.lit(way).alias("way"), F.lit(order).alias("order"), F.lit("title" if way == "title" else "doi").alias("kind"), name.alias("name"))

    titled = way("title", 2, ids.blank_to_null(plain(F.col("title"))))
    ways = F.array(way("doi", 0, ids.doi(F.col("doi"))), way("arxiv", 1, F.concat(F.lit(ARXIV_DOI), F.lower("arxiv_id"))), titled)
    asked = guesses.select(F.col(key).alias("guess"), F.explode(ways).alias("w")).select("guess", "w.*").where("name is not null")
    named = works.select("id", "cited_by_count", F.explode(F.array(way("doi", 0, ids.doi(F.col("doi"))), titled)).alias("w"))
    best = F.min_by("id", F.struct(-F.col("cited_by_count"), "id"))
    named = named.select("id", "cited_by_count", "w.kind", "w.name").where("name is not null").groupBy("kind", "name").agg(best.alias("id"))  # a title many works share is one row
    found = asked.join(named, ["kind", "name"])
    return found.groupBy(F.col("guess").alias(key)).agg(F.min_by(F.struct("id", F.col("way").alias("matched_by")), "order").alias("m")).select(key, "m.*")
