"""Document quality: gradient-boosted trees over document statistics."""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import sliced
from .language import held_out

#: Labelled rows to learn from, at most; picked by hash.
TRAIN = 20_000
#: From this score a document counts as good.
GOOD = 0.3

CLASSES = {
    "letters": b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digits": b"0123456789",
    "blanks": b" \t",
    "breaks": b"\r\n",
    "stops": b".!?",
    "shouts": b"!",
    "commas": b",;:",
    "quotes": b"\"'`",
    "brackets": b"()[]{}<>",
    "symbols": b"#$%&*+=@^_|~\\",
    "pipes": b"|",
    "slashes": b"/",
    "beyond": bytes(range(128, 256)),
}
GROUP = np.array([[b in c for c in CLASSES.values()] for b in range(256)], np.float64)
FEATURES = [*CLASSES, "log_bytes", "log_words", "word_bytes", "distinct", "doubled", "short_words", "long_words", "log_lines", "distinct_lines", "line_words", "log_sentence"]


def statistics(text: bytes | None) -> list[float]:
    """FEATURES of a text; shares of its bytes, words or lines, so that length enters by its own columns alone."""
    text = text or b""
    size = max(1, len(text))
    chars = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ GROUP).tolist()
    words = text.split()
    n = max(1, len(words))
    lengths = list(map(len, words))
    lines = [x for x in text.split(b"\n") if x]
    stops = chars[5]
    return [c / size for c in chars] + [
        math.log1p(len(text)),
        math.log1p(len(words)),
        sum(lengths) / n,
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(1 for x in lengths if x <= 2) / n,
        sum(1 for x in lengths if x >= 12) / n,
        math.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)),
        len(words) / max(1, len(lines)),
        math.log1p(len(words) / max(1.0, stops)),
    ]


def _measured(batches):
    for b in sliced(batches):
        rows = [statistics(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])


def learn(docs: DataFrame, labels: DataFrame, train: int = TRAIN) -> Boosted | None:
    """Trees fitted on ``train`` labelled rows at most, none of them held out; None without any."""
    usable = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(train)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # TRAIN rows of two numbers
    rows = rows.select(F.col("text").cast("binary").alias("text"), "doc_id", "quality").mapInArrow(_measured, "doc_id long, quality int, x array<double>")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("x").alias("x"))  # a document that the table repeats counts once
    got = rows.toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    if not got.num_rows:
        return None
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    return Boosted().fit(x, got["quality"].to_numpy().astype(np.float64))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of every whole text of ``docs(doc_id, text)``, as ``labels(doc_id, quality)`` marks it.

    Returns ``doc_id, held_out, score`` (0 to 1, higher: label 1 likelier) and
    ``predicted`` (1 from GOOD on), a row per row. Learns only from labelled
    rows that are not held out (crc32 of doc_id as text, modulo 5, is not 0);
    labels other than 0 and 1 count for nothing. Null and empty texts are
    scored by their statistics, all zero; without any label to learn from every
    score is 0.5. Repeated rows are scored each; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches):
        model = held.value
        for b in sliced(batches):
            x = np.array([statistics(t) for t in b.column(0).to_pylist()]).reshape(b.num_rows, len(FEATURES))
            score = model.score(x) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(score), pa.array((score >= GOOD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select(F.col("text").cast("binary").alias("text"), "doc_id").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
