"""Substring dedup over sliding sentence spans.

A text falls into sentences: a sentence ends after ``.``, ``!`` or ``?`` with
white space behind it, or at a line break. One of more than LONG words is cut
after words that its own surroundings choose, so that a passage is cut alike
whatever stands before it in its sentence. From each sentence starts one run:
the fewest consecutive sentences, two at least, that hold RUN_WORDS words. Runs
are hashed (128 bits, A-Z lowered, white space joined), written down once, and
grouped over the whole corpus. Of equal runs the one with the smallest (doc_id,
hash of the text, position) stays; the sentences covered by any other are
removed.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, sliced, stored

LONG, RUN_SENTENCES, RUN_WORDS = 25, 2, 20
#: Of so many neighbouring pairs of words, a cut parts the one with the least hash. Of 51 words in a row in long
#: sentences, whatever stands around, 20 at least are then cut alike, which hold a run.
NEAR = 8
STOP = re.compile(rb"[.!?][ \t-\r]+|\n[ \t-\r]*")
WORD = re.compile(rb"[^ \t-\r]+[ \t-\r]*")


def _cuts(words: list[bytes]) -> np.ndarray:
    """How many words of a long sentence stand before each cut; only the words near a cut decide on it."""
    pair = np.frombuffer(b"".join([hashlib.md5(a + b" " + b).digest() for a, b in zip(words, words[1:])]), "<u8")[1::2]
    near = np.lib.stride_tricks.sliding_window_view(pair, NEAR)[:, ::-1]  # of equal hashes the last one counts
    return np.unique(np.arange(len(near)) + NEAR - near.argmin(1))


def _split(text: bytes) -> tuple[list[int], list[list[bytes]]]:
    """Where each sentence ends, with the white space that follows it, and its words, lowered."""
    low, ends, words, at = text.lower(), [], [], 0
    for end in [*(m.end() for m in STOP.finditer(low)), len(low)]:
        if end > at:
            w = low[at:end].split()
            if len(w) > LONG and end - at > 2 * LONG:
                behind, k = [m.end() for m in WORD.finditer(low, at, end)], 0
                for c in _cuts(w).tolist():
                    ends.append(behind[c - 1])
                    words.append(w[k:c])
                    k = c
                w = w[k:]
            ends.append(end)
            words.append(w)
            at = end
    return ends, words


def sentences(text: bytes) -> list[bytes]:
    """The sentences with the white space that follows each; joined they give the text."""
    ends, _ = _split(text)
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def runs(text: bytes) -> tuple[list[bytes], list[int], list[int], int]:
    """Digest, index of the first sentence and index after the last one, for each run of a text; and how many sentences it has."""
    _, words = _split(text)
    index = [i for i, w in enumerate(words) if w]
    size = [len(words[i]) for i in index]
    own = [xxhash.xxh3_128_digest(b" ".join(words[i])) for i in index]
    digests, first, after = [], [], []
    end, n = 0, 0  # of the run that starts at i
    for i in range(len(own)):
        end = max(end, i)
        while end < len(own) and (n < RUN_WORDS or end - i < RUN_SENTENCES):
            n += size[end]
            end += 1
        if n < RUN_WORDS or end - i < RUN_SENTENCES:
            break
        digests.append(xxhash.xxh3_128_digest(b"".join(own[i:end])))
        first.append(index[i])
        after.append(index[end - 1] + 1)
        n -= size[i]
    return digests, first, after, len(words)


def _all_runs(batches, most: int = 1 << 16):
    """text, doc_id, copy -> a row for each run; and one for each text with ``again`` null and its number of sentences as ``first``."""
    rows: list[tuple] = []
    digests: list[bytes] = []

    def out():
        h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        cols = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()))]
        batch = pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), *cols], names=["h1", "h2", "doc_id", "copy", "first", "after", "again"])
        rows.clear(), digests.clear()
        return batch

    for b in sliced(batches):
        for text, i, k in zip(*(c.to_pylist() for c in b.columns)):
            if not text:
                continue
            d, first, after, n = runs(text)
            met = set()
            rows.extend((i, k, f, a, x in met or met.add(x) is not None) for x, f, a in zip(d, first, after))
            rows.append((i, k, n, -1, None))
            digests.extend(d)
            digests.append(bytes(16))
            if len(rows) >= most:
                yield out()
    yield out()


def _several(docs: DataFrame) -> DataFrame:
    """``doc_id`` of those that stand for more than one text."""
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("said").alias("a"), F.max("said").alias("b")).where("a <> b")
    return stored(ids.select("doc_id"), "ids-with-texts")


def repeated_spans(docs: DataFrame, several: DataFrame | None = None) -> DataFrame:
    """``doc_id, copy, first, after``: sentence ranges of ``docs(doc_id, copy, text)`` that repeat an earlier run.

    Besides, a row (number of sentences, -1) for each text that is not empty.
    ``copy`` tells the texts of one doc_id apart; it is 0 but for the ids in ``several``.
    """
    found = docs.where("doc_id is not null").select(F.col("text").cast("binary").alias("text"), "doc_id", "copy")
    found = stored(found.mapInArrow(_all_runs, "h1 long, h2 long, doc_id long, copy long, first int, after int, again boolean"), "runs")
    # A run's first place in its own document is known at once, so the corpus only has to find the first document.
    once = found.where("not again").drop("again")
    heads = once.groupBy("h1", "h2").agg(F.min("doc_id").alias("head_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = stored(heads.select("h1", "h2", "head_id"), "run-heads")  # so that the join below reads two exchanges and can split a hot run
    met = once.join(heads, ["h1", "h2"])
    place = ["doc_id", "copy", "first", "after"]
    spans = met.where("doc_id <> head_id").select(place).unionByName(found.where("again or again is null").select(place))
    if several is not None:  # of the texts of one doc_id, that with the smallest hash comes first
        same = met.where("doc_id = head_id").join(several, "doc_id", "left_semi")
        least = same.groupBy("h1", "h2", "doc_id").agg(F.min("copy").alias("least"))
        spans = spans.unionByName(same.join(least, ["h1", "h2", "doc_id"]).where("copy > least").select(place))
    return spans


def _cut(batches):
    """text, spans, ... -> ..., text, n_sentences, n_removed. Spans are first * 2**32 + after; one below 0 is -1 less the number of sentences."""
    for b in sliced(batches):
        texts, total, gone = [], [], []
        for text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            at = np.array(spans or [], np.int64)
            n = at[at < 0]
            at = at[at >= 0]
            if not len(at):
                texts.append(text)
                total.append(int(-1 - n[0]) if len(n) else len(_split(text or b"")[0]))
                gone.append(0)
                continue
            s = sentences(text)
            mark = np.zeros(len(s) + 1, np.int32)
            np.add.at(mark, at >> 32, 1)
            np.add.at(mark, at & 0xFFFFFFFF, -1)
            out = np.cumsum(mark)[:-1] > 0
            total.append(len(s))
            gone.append(int(out.sum()))
            texts.append(b"".join([x for x, drop in zip(s, out) if not drop]))
        yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(texts, pa.binary()), pa.array(total, pa.int32()), pa.array(gone, pa.int32())], names=[*b.schema.names[2:], "t", "n", "r"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with every non-first repeated span cut out of ``text``, and ``n_sentences, n_removed`` (int) behind.

    Every row stays, in all its columns (``n_chars``, if there, follows the
    text). Null text stays null and empty text empty; a very long text is one
    row's work. Rows with the same doc_id and text are the same document and
    are cut alike, and never repeat each other; several texts of one doc_id are
    documents of their own, that with the smallest hash first. A null doc_id
    takes no part and stays as it is. Columns that are called n_sentences or
    n_removed are replaced.
    """
    rest = [f for f in docs.schema if f.name not in ("text", "n_sentences", "n_removed")]
    keyed = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(quoted(f.name)).alias(f"k{i}") for i, f in enumerate(rest)))
    said, several = F.xxhash64("text"), _several(keyed.select("doc_id", F.xxhash64("text").alias("said")))
    if several.isEmpty():
        keyed, several = keyed.withColumn("copy", F.lit(0).cast("long")), None
    else:
        keyed = keyed.join(several.select(F.col("doc_id").alias("__of")), F.col("doc_id") == F.col("__of"), "left").withColumn("copy", F.when(F.col("__of").isNotNull(), said).otherwise(0)).drop("__of")
    spans = repeated_spans(keyed.select("doc_id", "copy", "text"), several)
    # A set, as a repeated row repeats its spans: so it is no larger than its text.
    place = F.when(F.col("after") < 0, -1 - F.col("first").cast("long")).otherwise(F.col("first").cast("long") * (1 << 32) + F.col("after"))
    spans = spans.groupBy("doc_id", "copy").agg(F.collect_set(place).alias("spans"))
    both = keyed.join(spans, ["doc_id", "copy"], "left").select(F.col("text").cast("binary").alias("text"), "spans", *(f"k{i}" for i in range(len(rest))))
    cut = both.mapInArrow(_cut, ", ".join([*(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(rest)), "t binary", "n int", "r int"]))
    at, text = {f.name: i for i, f in enumerate(rest)}, F.col("t").cast("string")
    out = []
    for f in docs.schema:
        if f.name == "text":
            out.append(text.alias("text"))
        elif f.name == "n_chars":
            out.append(F.length(text).cast(f.dataType).alias("n_chars"))
        elif f.name in at:
            out.append(F.col(f"k{at[f.name]}").alias(f.name))
    return cut.select(*out, F.col("n").alias("n_sentences"), F.col("r").alias("n_removed"))


#: What op1 returns. DuckDB groups the runs by their own words instead of a hash.
SQL = r"""
WITH marked AS (
  SELECT doc_id, text, regexp_replace(text, '([.!?][ \t-\r]+|\n[ \t-\r]*)', '\1' || chr(1), 'g') AS m FROM documents
), whole AS (
  SELECT doc_id, unnest(list_filter(string_split(m, chr(1)), lambda x: x <> '')) AS s,
         generate_subscripts(list_filter(string_split(m, chr(1)), lambda x: x <> ''), 1) AS k FROM marked
), told AS (
  SELECT doc_id, k, s, regexp_extract_all(s, '[^ \t-\r]+[ \t-\r]*') AS v,
         regexp_extract_all(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM whole
), pairs AS (
  SELECT *, list_transform(range(1, len(w)), lambda i: md5_number_lower(w[i] || ' ' || w[i + 1])) AS p FROM told WHERE len(w) > 25 AND strlen(s) > 50
), cut AS (
  SELECT doc_id, k, s, v, list_sort(list_distinct(list_transform(range(1, len(p) - 6), lambda j: j + 8 - list_position(list_reverse(p[j : j + 7]), list_min(p[j : j + 7]))))) AS c FROM pairs
), pieces AS (
  SELECT doc_id, k, [s] AS p FROM told WHERE NOT (len(w) > 25 AND strlen(s) > 50)
  UNION ALL
  SELECT doc_id, k, list_transform(range(1, len(c) + 2), lambda i:
    CASE WHEN i = 1 THEN regexp_extract(s, '^[ \t-\r]*') ELSE '' END
    || array_to_string(v[CASE WHEN i = 1 THEN 1 ELSE c[i - 1] + 1 END : CASE WHEN i > len(c) THEN len(v) ELSE c[i] END], '')) AS p FROM cut
), flat AS (
  SELECT doc_id, k, unnest(p) AS s, generate_subscripts(p, 1) AS j FROM pieces
), units AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS pos,
         regexp_extract_all(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM flat
), worded AS (
  SELECT doc_id, pos, array_to_string(w, ' ') AS norm, len(w) AS n FROM units WHERE len(w) > 0
), ahead AS (
  SELECT doc_id, pos, list(norm) OVER f AS norms, list(n) OVER f AS ns, list(pos) OVER f AS ends FROM worded
  WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), sized AS (
  SELECT *, list_min(list_filter(range(2, len(ns) + 1), lambda r: list_sum(ns[1:r]) >= 20)) AS r FROM ahead
), runs AS (
  SELECT doc_id, pos, ends[r] AS upto, array_to_string(norms[1:r], chr(10)) AS run FROM sized WHERE r IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS nth FROM runs
), gone AS (
  SELECT DISTINCT u.doc_id, u.pos FROM units u JOIN ranked r ON u.doc_id = r.doc_id AND r.nth > 1 AND u.pos BETWEEN r.pos AND r.upto
), kept AS (
  SELECT u.doc_id, count(*) AS n, count(g.pos) AS removed, coalesce(string_agg(u.s, '' ORDER BY u.pos) FILTER (WHERE g.pos IS NULL), '') AS t
  FROM units u LEFT JOIN gone g ON u.doc_id = g.doc_id AND u.pos = g.pos GROUP BY u.doc_id
)
SELECT d.doc_id, CASE WHEN k.removed > 0 THEN k.t ELSE d.text END AS text,
       CAST(coalesce(k.n, 0) AS INTEGER) AS n_sentences, CAST(coalesce(k.removed, 0) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
