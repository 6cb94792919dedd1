"""Language identification with a bidirectional gated recurrent network over bytes.

A text is its UTF-8 bytes, A-Z lowered: letters, blanks, digits and marks
alike. The network reads each whole text both ways, carries its state from end
to end and labels every byte; a document's probabilities are the mean over all
its bytes. Besides the languages it learns what is none of them, from noise
made of the same bytes, so that a text which is mostly that can be rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bigru import BiGRU
from .common import quoted

#: Labelled texts to learn from, so many different ones of each language, picked by hash; and from each of them so many
#: windows of these many bytes, placed by hash over the whole text.
SAMPLE, WINDOWS, LENGTHS = 300, 8, (16, 64)
#: Bytes of text that are read side by side.
GROUP = 32 << 20
#: A text of this many bytes is rejected where more than this share of them is no language's. Shorter ones tell too little.
TELLING, MOST_NOISE = 256, 0.8
UNDETERMINED, NOISE = "und", ""


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode().lower()


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def windows_of(text: bytes, length: int) -> list[bytes]:
    """WINDOWS pieces of ``length`` bytes; a shorter text is repeated after a blank."""
    if len(text) < length:
        text = b" ".join([text] * (length // (len(text) + 1) + 2))
    rng = np.random.default_rng([xxhash.xxh64_intdigest(text), length])
    return [text[a : a + length] for a in rng.integers(0, len(text) - length + 1, WINDOWS)]


def _cut(batches):
    """text, lang -> lang, and for each of LENGTHS the windows one behind the other."""
    for b in batches:
        rows = [(lang, [b"".join(windows_of(t, n)) for n in LENGTHS]) for t, lang in zip(map(as_bytes, b.column(0).to_pylist()), b.column(1).to_pylist()) if t]
        langs, cut = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(cut, pa.list_(pa.binary()))], names=["lang", "cut"])


def sampled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``text, lang``: ``sample`` different texts of each language at most, those with the smallest hash; repeated rows count once."""
    rows = docs.select("text", "lang").where("lang is not null and text <> ''").withColumn("place", F.xxhash64("text"))
    share = rows.groupBy("lang").agg(F.approx_count_distinct("place").alias("n"))  # one row a language
    share = share.select(F.col("lang").alias("of"), F.least(F.lit(1.0), 4 * sample / F.greatest("n", F.lit(1))).alias("share"))
    near = rows.join(F.broadcast(share), F.col("lang") == F.col("of")).where(F.pmod("place", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    once = near.groupBy("lang", "place").agg(F.min("text").alias("text"))
    first = once.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).where(F.col("nth") <= sample)
    return first.select("text", "lang")


def noise(windows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """As many windows of no language: a third have the bytes of ``windows`` in another order, a third any letters and marks of ASCII, a third any bytes beyond."""
    out = rng.permuted(windows, axis=1)
    out[::3], out[1::3] = rng.integers(33, 127, out[::3].shape), rng.integers(128, 256, out[1::3].shape)
    return np.where((out >= 65) & (out <= 90), out + 32, out).astype(np.uint8)


def learn(docs: DataFrame, sample: int = SAMPLE) -> BiGRU | None:
    """A network fitted on windows of ``sampled`` texts of ``docs(text, lang)``; None without any. The windows, about 5 KB a text, reach the driver."""
    got = sampled(docs, sample).mapInArrow(_cut, "lang string, cut array<binary>").collect()
    if not got:
        return None
    got = sorted((r.lang, list(map(bytes, r.cut))) for r in got)
    langs = sorted({lang for lang, _ in got})
    rng, data = np.random.default_rng(5), {}
    for k, n in enumerate(LENGTHS):
        x = np.frombuffer(b"".join(cut[k] for _, cut in got), np.uint8).reshape(-1, n)
        y = np.repeat([langs.index(lang) for lang, _ in got], WINDOWS)
        z = noise(x[rng.permutation(len(x))[: max(256, len(x) // len(langs))]], rng)
        data[n] = np.concatenate([x, z]), np.concatenate([y, np.full(len(z), len(langs))])
    return BiGRU([*langs, NOISE]).train(data)


def predict(docs: DataFrame, net: BiGRU | None, text_too: bool = True) -> DataFrame:
    """Every column of ``docs`` as k0, k1, ... with ``lang_pred``, ``score``, and ``noise`` (the share of no language) behind, for whole texts; the text itself, if ``text_too``."""
    held, at = docs.sparkSession.sparkContext.broadcast(net), docs.columns.index("text")
    back = [i for i in range(len(docs.columns)) if text_too or i != at]

    def run(batches):
        net = held.value
        for b in batches:
            i = 0
            while i < b.num_rows:
                group, size, first = [], 0, i
                while i < b.num_rows and (i == first or size < GROUP):
                    text = b.column(at)[i].as_py()
                    group.append(as_bytes(text) if net and has_letter(text) else b"")
                    size += len(group[-1])
                    i += 1
                lang, score, none = [UNDETERMINED] * len(group), [0.0] * len(group), [0.0] * len(group)
                for k, (t, p) in enumerate(zip(group, net.pooled(group) if net else group)):
                    if t:
                        best = int(p[:-1].argmax())
                        lang[k], score[k], none[k] = net.classes[best], float(p[best] / max(p[:-1].sum(), 1e-30)), float(p[-1] / p.sum())
                part = b.slice(first, len(group))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in back), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(none, pa.float64())], names=[*(f"k{i}" for i in back), "lang_pred", "score", "noise"])

    schema = ", ".join([*(f"k{i} {docs.schema[i].dataType.simpleString()}" for i in back), "lang_pred string", "score double", "noise double"])
    return docs.select(*(F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(docs.columns))).mapInArrow(run, schema)


def determined(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are in a language that was learnt, with all columns, whatever their names.

    A row goes if its text is null, empty or without a letter, or if it has
    TELLING bytes and more than MOST_NOISE of them are no language's. Learns
    from rows that are not held out; where there is nothing to learn from, no
    row goes. A null ``lang`` becomes the one predicted. Repeated rows and rows
    without doc_id are told each by its text.
    """
    net = learn(docs.where(~held_out()))
    if net is None:
        return docs
    text = F.col(f"k{docs.columns.index('text')}")
    told = predict(docs, net).where((F.col("lang_pred") != UNDETERMINED) & ((F.octet_length(text) < TELLING) | (F.col("noise") <= MOST_NOISE)))
    return told.select(*((F.coalesce(f"k{i}", "lang_pred") if c == "lang" else F.col(f"k{i}")).alias(c) for i, c in enumerate(docs.columns)))


def identify(docs: DataFrame) -> DataFrame:
    """Language of every whole text of ``docs(doc_id, text, lang)``.

    Returns ``doc_id, held_out, lang_pred, score, noise``, a row per row. Learns
    from text and non-null lang of rows that are not held out (crc32 of doc_id
    as text, modulo 5, is not 0; a null doc_id is not held out). ``score`` is
    the language's share among the languages, ``noise`` what is none's. A null
    text, one without a letter, and any text where there is nothing to learn
    from, is ``und`` with score 0. A very long text is read whole, in memory of
    about its size. Repeated rows are labelled each; other columns are ignored.
    """
    net = learn(docs.where(~held_out()))
    told = predict(docs.select("doc_id", "text"), net, text_too=False)
    return told.select(F.col("k0").alias("doc_id"), held_out("k0").alias("held_out"), "lang_pred", F.least("score", F.lit(1.0)).alias("score"), "noise")
