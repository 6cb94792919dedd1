"""A thin command line: ``python -m strandline.cli COMMAND --works DIR --cites DIR ...``; tables are Parquet, results JSON or a page."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import LineageError
from .operators.expand import Caps, expand
from .operators.lookup import search
from .operators.select import filter_by_idea
from .operators import prompts
from .plans.lineage import curated_lineage, expansion_json, graph_json, identify_seed, load_graph, page, write_text
from .sources.host import Settings
from .sources.records import read_graph

#: Who may choose a run's papers, and the least that numbers may be.
MODES = ("auto", "llm", "bm25")
BOUNDS = {"limit": 1, "top_k": 1, "total": 1, "fanout": 1}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="strandline")
    out.add_argument("--settings", default=".env", help="file of NAME=value lines, under the environment")
    sub = out.add_subparsers(dest="command", required=True)
    tables = argparse.ArgumentParser(add_help=False)
    tables.add_argument("--works", required=True, help="table of works")
    asked = argparse.ArgumentParser(add_help=False)
    for name in ("--idea", "--out"):
        asked.add_argument(name, required=True)
    asked.add_argument("--top-k", type=int, default=None)
    who = sub.add_parser("identify-seed", help="what paper a description means, as a model has it: one JSON object")
    who.add_argument("description")
    who.add_argument("--works", help="table of works, in which the guess is looked up")
    who.add_argument("--model", help="instead of the settings' model")
    who.add_argument("--web", action=argparse.BooleanOptionalAction, default=None, help="let the model look pages up")
    find = sub.add_parser("search-seed", parents=[tables], help="works by title, one JSON object a line")
    find.add_argument("query")
    find.add_argument("--limit", type=int, default=5)
    for name, more in (("expand", []), ("run", [asked])):
        p = sub.add_parser(name, parents=[tables, *more])
        for option in ("--cites", "--seed"):
            p.add_argument(option, required=True)
        p.add_argument("--total", type=int, default=None)
        p.add_argument("--fanout", type=int, default=None)
        if name == "expand":
            p.add_argument("--out", required=True)
        else:
            p.add_argument("--refs", help="table of what the second source says")
            p.add_argument("--title", default="Lineage")
            p.add_argument("--model", help="instead of the settings' model")
            p.add_argument("--mode", choices=MODES, default=None, help="who chooses the papers")
            p.add_argument("--narrative", action=argparse.BooleanOptionalAction, default=True, help="have a story told")
    p = sub.add_parser("filter", parents=[asked], help="an expansion's JSON to a filtered graph's")
    p.add_argument("--expansion", required=True)
    p = sub.add_parser("render", help="a filtered graph's JSON to a page")
    for option in ("--graph", "--out"):
        p.add_argument(option, required=True)
    p.add_argument("--title", default="Lineage")
    return out


def _seed(works, text: str):
    """The seed in the type of the works' ids."""
    row = works.where(F.col("id").cast("string") == text).select("id").first()
    if row is None:
        raise LineageError(f"no work has the id {text}")
    return row.id


def _identified(spark, a, told: Settings, chat) -> str:
    """A guess as JSON, with the work that it names where there is a table of works."""
    chat = chat or told.chat(a.model, told.web_search if a.web is None else a.web)
    if chat is None:
        raise LineageError("no model is set: chat_url, chat_model and chat_key of the settings")
    guess = identify_seed(spark, a.description, chat)
    row = guess.first().asDict(recursive=True)
    if a.works:
        works = spark.read.parquet(a.works)
        found = prompts.resolved(works, guess.withColumn("k", F.lit(0)), "k").first()
        row["found"] = {"id": found.id, "matched_by": found.matched_by} if found else None
    return json.dumps(row, ensure_ascii=False)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, chat: prompts.Chat | None = None) -> int:
    """0, or 1 with a line on the error stream where the run can't be made. ``chat`` stands in for the settings' model."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("strandline").getOrCreate()
    told = Settings.load(a.settings)
    try:
        for name, least in BOUNDS.items():
            if getattr(a, name, None) is not None and getattr(a, name) < least:
                raise LineageError(f"--{name.replace('_', '-')} is {getattr(a, name)}, but has to be {least} at least")
        if a.command == "identify-seed":
            print(_identified(spark, a, told, chat))
            return 0
        if a.command == "search-seed":
            found = search(spark.read.parquet(a.works), a.query, a.limit)
            for line in found.drop("abstract").toJSON().collect():  # limit rows
                print(line)
            return 0
        if a.command == "render":
            g, seed, idea, top_k = load_graph(spark, a.graph)
            write_text(spark, a.out, page(g, seed, idea, top_k, a.title))
            return 0
        if a.command == "filter":
            g = read_graph(spark, a.expansion)
            seed, top_k = g["meta"].first().seed_id, a.top_k or told.top_k
            kept = filter_by_idea(g["nodes"], g["edges"], seed, a.idea, top_k)
            write_text(spark, a.out, graph_json(kept, seed, a.idea, top_k).first().json)
            return 0
        works, cites = spark.read.parquet(a.works), spark.read.parquet(a.cites)
        seed, caps = _seed(works, a.seed), Caps(a.total or told.total_cap, a.fanout or told.fanout_cap, told.strategy)
        if a.command == "expand":
            e = expand(works, cites, seed, caps)
            nodes = e.nodes.select("id", "hop", "ord").join(works, "id")
            write_text(spark, a.out, expansion_json(nodes, e.edges, seed, bool(e.refused.first().truncated)).first().json)
            return 0
        refs = spark.read.parquet(a.refs) if a.refs else spark.createDataFrame([], "doi string, direction string, intents array<string>, is_influential boolean, abstract string, ord long")
        top_k = a.top_k or told.top_k
        g = curated_lineage(works, cites, refs, seed, a.idea, chat or told.chat(a.model), caps, told.shortlist, told.max_keep, top_k, a.mode or told.mode, tell=a.narrative, warn=lambda text: print(f"warning: {text}", file=sys.stderr))
        write_text(spark, a.out, page(g, seed, a.idea, top_k, a.title))
        return 0
    except (LineageError, ValueError) as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
