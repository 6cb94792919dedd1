"""What the second source says of a seed's neighbours: both of its lists, or none."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import blank_to_null
from .host import PAPER_FIELDS, nested_fields
from .records import neighbours_from_json, papers_from_json

#: Neighbours of each list at most.
LIMIT = 500


def _asked(path: str, of: str, limit: int) -> str:
    return f"{path}?fields={nested_fields(of)}&limit={limit}"


def refs_of(spark: SparkSession, fetch: Callable[[str], dict], reference: str, limit: int = LIMIT) -> DataFrame:
    """``refs(doi, direction, intents, is_influential, abstract, ord)`` of a seed, as ``enrich`` takes them.

    ``fetch`` gives the reply for a path; where it fails for either list its
    error goes to the caller, and nothing of the other list is used.
    References come before citations, each in the order of the source.
    """
    at = f"/paper/{quote(reference, safe=':')}"
    replies = [(direction, key, json.dumps(fetch(_asked(f"{at}/{name}", key, limit)))) for direction, name, key in (("cited", "references", "citedPaper"), ("citing", "citations", "citingPaper"))]
    out = None
    for k, (direction, key, raw) in enumerate(replies):
        rows = neighbours_from_json(spark.createDataFrame([(raw,)], "raw string"), "raw", key)
        rows = rows.select(blank_to_null(F.col("doi")).alias("doi"), F.lit(direction).alias("direction"), "intents", "is_influential", "abstract", (F.col("place") + F.lit(k) * limit).cast("long").alias("ord"))
        rows = rows.where(F.col("ord") < (k + 1) * limit)
        out = rows if out is None else out.unionByName(rows)
    return out


def paper_of(spark: SparkSession, fetch: Callable[[str], dict], reference: str) -> DataFrame:
    """One work of the second source; no row where it has no such paper."""
    raw = json.dumps(fetch(f"/paper/{quote(reference, safe=':')}?fields={','.join(PAPER_FIELDS)}"))
    return papers_from_json(spark.createDataFrame([(raw,)], "raw string"), "raw")
