"""Benchmark decontamination: a BM25 inverted index of test items, searched by every training passage with block-max WAND.

The test items are the indexed side. An item is retrieved where a passage
scores at least the least share of the item's own score that a verified match
can have; impacts are divided by it, so one threshold, 1, holds for all items.
Passages are windows of two strides, a stride apart; an item's stride is the
least of STRIDE, 4 STRIDE, 16 STRIDE, ... that holds its words, so every
occurrence lies whole in a window of its size. A passage's distinct terms run
through three bounds, each of which can only overestimate: the sum of the terms'
maxima; the sum of their maxima within a block of item numbers; then WAND's
pivots with block maxima, which score what is left exactly. All items at or
above the threshold are retrieved and their question and answer compared with
the passage by word shingles.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, stored

K1, B = 1.2, 0.75
#: Least share of an item's shingles in a passage, or of its question's and then its answer's.
MIN_OVERLAP, MIN_ANSWER = 0.8, 0.5
SHINGLE, BLOCK, STRIDE = 5, 4, 64
WORD, STOP = re.compile(r"\w+"), re.compile(r"(?<=[.!?])\s+|\n+")
#: Text of the items in one index, which takes about ten times that in memory; more items are indexed in several, by the statistics of all.
INDEX_BYTES = 8 << 20
#: Block maxima that are added up at once, but for one window's own: forty bytes each. Bytes of texts that are searched at once.
AT_ONCE, SLICE = 1 << 18, 1 << 20


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(tokens: list) -> set[tuple]:
    return {tuple(tokens[i : i + SHINGLE]) for i in range(max(1, len(tokens) - SHINGLE + 1))} if tokens else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The answer is the last sentence with a word; of a single sentence, its last quarter."""
    parts = [w for s in STOP.split(text) if (w := words(s))]
    if len(parts) > 1:
        return [x for p in parts[:-1] for x in p], parts[-1]
    w = parts[0] if parts else []
    cut = len(w) - max(1, len(w) // 4)
    return (w[:cut], w[cut:]) if cut else (w, w)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def stride_of(n: int) -> int:
    stride = STRIDE
    while stride < n:
        stride *= 4
    return stride


def _lost(part: list[str], share: float) -> int:
    """How many different words of a part can be missing where ``share`` of its shingles are there.

    Every missing word takes the shingle that begins with it along; of the last four words, that begin none, a repeated
    shingle can take several at once.
    """
    if len(part) < SHINGLE:
        return 0
    n = len(shingles(part))
    return int((1 - share) * n + 1e-9) + (SHINGLE - 1 if n < len(part) - SHINGLE + 1 else 0)


class _Class:
    """Postings, by term, of the items of one stride: item numbers and gains, the best gain, and the best by block."""

    def __init__(self, stride: int, n_terms: int, n_items: int, term: np.ndarray, item: np.ndarray, gain: np.ndarray):
        self.stride, self.blocks = stride, n_items // BLOCK + 1
        self.cut = np.searchsorted(term, np.arange(n_terms + 1))
        self.item, self.gain = item, gain
        self.best = np.zeros(n_terms)
        np.maximum.at(self.best, term, gain)
        key, first = np.unique(term.astype(np.int64) * self.blocks + item // BLOCK, return_index=True)
        self.block_no, self.block_max = key % self.blocks, np.maximum.reduceat(gain, first) if len(first) else np.zeros(0)
        self.block_cut = np.searchsorted(key // self.blocks, np.arange(n_terms + 1))


class Index:
    """BM25 postings with block maxima over ``(item_id, text)``, in arrays; items without a word are left out.

    Where the items are a part of more, ``total`` has the number of all items, how many hold each
    term of this part, and their mean length.
    """

    def __init__(self, items: list[tuple[int, str]], total: tuple[int, dict[str, int], float] | None = None):
        told = [(i, w, *question_and_answer(t)) for i, t in items if (w := words(t))]
        self.ids = [i for i, *_ in told]
        self.term = {t: k for k, t in enumerate(sorted({t for _, w, *_ in told for t in w}))}
        size = np.array([len(w) for _, w, *_ in told], np.int64)
        flat = np.fromiter((self.term[t] for _, w, *_ in told for t in w), np.int32, int(size.sum()))
        #: Words of item d are flat[start[d] : start[d + 1]]; of these the first asks[d] are the question, from answers[d] on the answer.
        self.flat, self.start = flat, np.concatenate([[0], np.cumsum(size)])
        self.asks = [len(q) for *_, q, _ in told]
        self.answers = [len(w) - len(a) for _, w, _, a in told]
        n_items, wide = len(told), max(1, len(told))
        key, tf = np.unique(flat * np.int64(wide) + np.repeat(np.arange(n_items), size), return_counts=True)
        term, item = key // wide, key % wide
        df = np.bincount(term, minlength=len(self.term))
        count, mean = n_items, size.sum() / wide
        if total is not None:
            count, held, mean = total
            df = np.fromiter((held[t] for t in self.term), np.int64, len(self.term))
        weight = np.log(1 + (count - df[term] + 0.5) / (df[term] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / mean)) if n_items else np.zeros(0)
        share = weight / np.bincount(item, weight, wide)[item]
        order = np.argsort(item, kind="stable")
        cut = np.searchsorted(item[order], np.arange(n_items + 1))
        self.least = np.ones(wide)
        for d, (_, w, q, a) in enumerate(told):
            at = order[cut[d] : cut[d + 1]]
            of = dict(zip(term[at].tolist(), share[at].tolist()))
            gone = lambda part, least: sum(sorted((of[self.term[t]] for t in set(part)), reverse=True)[: _lost(part, least)])  # noqa: E731, B023
            self.least[d] = 1 - max(gone(w, MIN_OVERLAP), gone(q, MIN_OVERLAP) + gone(a, MIN_ANSWER)) - 1e-9
        #: An item of which next to nothing need be there is retrieved wherever one of its terms is.
        gain = share / np.maximum(self.least[item], 1e-6)
        strides = np.array([stride_of(n) for n in size.tolist()], np.int64)
        self.classes = [_Class(int(k), len(self.term), n_items, term[use], item[use], gain[use]) for k in np.unique(strides) for use in (strides[item] == k,)]

    def wand(self, c: _Class, terms: list[int]) -> list[tuple[int, float]]:
        """Every item of a class whose gains for the distinct ``terms`` reach 1, with its share of its own score."""
        # Views give plain numbers, which suit steps of one posting at a time.
        items, gains, cut, top, nos, mosts, cuts = (x.data for x in (c.item, c.gain, c.cut, c.best, c.block_no, c.block_max, c.block_cut))
        found = []
        cursors = [[items[cut[t]], cut[t], t, top[t]] for t in terms if cut[t] < cut[t + 1]]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for p, x in enumerate(cursors):
                bound += x[3]
                if bound >= 1:
                    pivot = p
                    break
            if pivot is None:
                break
            d = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == d:
                pivot += 1
            block, most = d // BLOCK, 0.0
            for x in cursors[: pivot + 1]:
                end = cuts[x[2] + 1]
                k = bisect_left(nos, block, cuts[x[2]], end)
                if k < end and nos[k] == block:
                    most += mosts[k]
            if most >= 1:
                if cursors[0][0] == d:
                    score = sum(gains[x[1]] for x in sorted(cursors[: pivot + 1], key=lambda x: x[2]))
                    if score >= 1:
                        found.append((d, score * max(float(self.least[d]), 1e-6)))
                    to = d + 1
                else:
                    to = d
            else:  # no item of this block can do, until another list joins in
                to = min((block + 1) * BLOCK, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 60)
            for x in cursors[: pivot + 1]:
                end = cut[x[2] + 1]
                x[1] = k = bisect_left(items, to, x[1], end)
                x[0] = items[k] if k < end else -1
            cursors = [x for x in cursors if x[0] >= 0]
        return found

    def search(self, texts: list[str | None]) -> list[dict[int, tuple]]:
        """For each text: item -> (score, overlap, question's, answer's, first word of the passage), verified ones only."""
        out: list[dict[int, tuple]] = [{} for _ in texts]
        get, tokens, sizes = self.term.get, [], []
        for text in texts:
            w = [get(x, -1) for x in words(text)]
            tokens += w
            sizes.append(len(w))
        if self.ids and tokens:
            ids, size = np.array(tokens, np.int64), np.array(sizes)
            for c in self.classes:
                self._search(c, ids, size, out)
        return out

    def _search(self, c: _Class, ids: np.ndarray, size: np.ndarray, out: list[dict]) -> None:
        n_blocks = -(-size // c.stride)
        first_block = np.concatenate([[0], np.cumsum(n_blocks)])
        start = np.concatenate([[0], np.cumsum(size)])
        doc = np.repeat(np.arange(len(size)), size)
        known = np.flatnonzero(ids >= 0)
        known = known[c.best[ids[known]] > 0]
        d = doc[known]
        block = first_block[d] + (known - start[d]) // c.stride
        wide = len(self.term)
        keys = _distinct(block * wide + ids[known])
        if not len(keys):
            return
        kb, kt = keys // wide, keys % wide
        gain = c.best[kt]
        total = first_block[-1]
        own = np.bincount(kb, gain, total)
        nxt = np.searchsorted(keys, keys + wide)
        again = keys[np.minimum(nxt, len(keys) - 1)] == keys + wide
        both = np.bincount(kb, np.where(again, gain, 0), total)
        owner = np.repeat(np.arange(len(size)), n_blocks)
        inner = np.concatenate([owner[:-1] == owner[1:], [False]])  # the next block is of the same text
        bound = own + np.where(inner, np.concatenate([own[1:], [0]]) - both, 0)
        alone = inner | (n_blocks[owner] == 1)  # a last block's window lies in the one before
        cand = np.flatnonzero(alone & (bound >= 1 - 1e-9))
        lo, hi = np.searchsorted(kb, np.arange(total)), np.searchsorted(kb, np.arange(total), "right")
        # A common term is in many blocks: windows are taken by what they add up, not by their number.
        sums = np.concatenate([[0], np.cumsum(c.block_cut[kt + 1] - c.block_cut[kt])])
        end = np.where(inner[cand], hi[np.minimum(cand + 1, len(hi) - 1)], hi[cand])
        upto, k = np.cumsum(sums[end] - sums[lo[cand]] + c.blocks), 0
        while k < len(cand):
            e = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + AT_ONCE, "right")))
            self._blocks(c, cand[k:e], inner, lo, hi, kt, owner, first_block, start, ids, size, out)
            k = e

    def _blocks(self, c, cand, inner, lo, hi, kt, owner, first_block, start, ids, size, out) -> None:
        """Bound each window by blocks of items, then search and verify those left."""
        end = np.where(inner[cand], hi[np.minimum(cand + 1, len(hi) - 1)], hi[cand])
        n = end - lo[cand]
        w = np.repeat(np.arange(len(cand)), n)
        t = kt[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[cand], n)]
        pairs = _distinct(w * len(self.term) + t)
        w, t = pairs // len(self.term), pairs % len(self.term)
        m = c.block_cut[t + 1] - c.block_cut[t]
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(c.block_cut[t], m)
        bound = np.bincount(np.repeat(w, m) * c.blocks + c.block_no[at], c.block_max[at], len(cand) * c.blocks)
        left = np.flatnonzero((bound.reshape(-1, c.blocks) >= 1 - 1e-9).any(1))
        a, b = np.searchsorted(w, left), np.searchsorted(w, left, "right")
        for i, x, y in zip(left, a, b):
            got = self.wand(c, t[x:y].tolist())
            if not got:
                continue
            o = owner[cand[i]]
            s = int((cand[i] - first_block[o]) * c.stride)
            here = ids[start[o] + s : start[o] + min(size[o], s + 2 * c.stride)].tolist()
            seen = shingles(here)
            for item, score in got:
                own = self.flat[self.start[item] : self.start[item + 1]].tolist()
                whole, q, r = (self._share(p, seen, here) for p in (own, own[: self.asks[item]], own[self.answers[item] :]))
                if whole >= MIN_OVERLAP or (q >= MIN_OVERLAP and r >= MIN_ANSWER):
                    new = (score, whole, q, r, s)
                    if item not in out[o] or new[1] > out[o][item][1]:
                        out[o][item] = new

    @staticmethod
    def _share(part: list[int], seen: set[tuple], here: list[int]) -> float:
        """The share of a part's shingles in the passage; a part of fewer words than a shingle is looked for as it is."""
        k = len(part)
        if k < SHINGLE:
            return float(any(here[i : i + k] == part for i in range(len(here) - k + 1)))
        own = shingles(part)
        return len(own & seen) / len(own)


def _parted(items: DataFrame) -> tuple[int, float, DataFrame]:
    """Statistics of all ``items(item_id, text, shard)``: their number and mean length, and ``term, df, shards`` for each term."""

    def held(batches):
        for b in batches:
            rows = [(k, len(w), sorted(set(w))) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (w := words(t))]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.list_(pa.string())))], names=["shard", "n", "terms"])

    bags = stored(items.select("shard", "text").mapInArrow(held, "shard int, n long, terms array<string>"), "item-terms")
    n, length = bags.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = bags.select("shard", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.collect_set("shard").alias("shards"))
    return n, (length or 0) / max(1, n), stored(df, "item-df")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Which rows of ``docs(doc_id, text)`` hold which of ``items(item_id, text)``.

    Returns ``doc_id, item_id, bm25_share, overlap, question_overlap,
    answer_overlap`` (doubles) and ``word_start`` (long: where the best passage
    begins), a row per document and item. A null or empty text holds nothing, an
    item without a word is held by nothing, equal items are each reported,
    repeated rows are reported each, and other columns are ignored. The items are
    the small side: their size is summed first, and beyond INDEX_BYTES they are
    indexed in several parts, each searched by every passage; weights are those
    of all items and windows go by an item's own length, so the parts do not
    change the result. A very long text is searched whole, window by window.
    """
    spark = docs.sparkSession
    items = items.select("item_id", "text").where("text is not null")
    volume = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(volume // INDEX_BYTES) + 1
    schema = "doc_id long, item_id long, bm25_share double, overlap double, question_overlap double, answer_overlap double, word_start long"
    out, total = None, None
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))
    if shards > 1:
        n, mean, df = _parted(items)
    for k in range(shards):
        part = items.where(F.col("shard") == k)
        if shards > 1:
            total = n, {r.term: r.df for r in df.where(F.array_contains("shards", k)).select("term", "df").collect()}, mean
        held = spark.sparkContext.broadcast(Index(sorted((r.item_id, r.text) for r in part.collect()), total))  # INDEX_BYTES of text, about

        def run(batches, held=held):
            index = held.value
            for b in sliced(batches, SLICE):
                rows = []
                for doc_id, got in zip(b.column(1).to_pylist(), index.search(b.column(0).to_pylist())):
                    rows += [(doc_id, index.ids[item], *map(float, x[:4]), x[4]) for item, x in sorted(got.items())]
                cols = list(zip(*rows)) or [()] * 7
                kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in schema.split(", ")])

        found = docs.select("text", "doc_id").mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold an item; columns of any name and type, and rows without doc_id, stay. All rows of a doc_id go with one of them."""
    # Written first, so that Spark knows how few they are before it chooses how to leave them out.
    leaks = stored(contaminated(docs, items).select(F.col("doc_id").alias("__id")).distinct(), "leaks")
    names = docs.columns
    docs = docs.toDF(*(f"k{i}" for i in range(len(names))))  # no name can clash
    return docs.join(leaks, F.col(f"k{names.index('doc_id')}") == F.col("__id"), "left_anti").toDF(*names)


def rounded(found: DataFrame) -> DataFrame:
    """The same with six decimals, as sums of doubles depend on their order."""
    shares = ("bm25_share", "overlap", "question_overlap", "answer_overlap")
    return found.select("doc_id", "item_id", *(F.round(c, 6).alias(c) for c in shares), "word_start")


def sql() -> str:
    """The same without an index: every window against every item."""
    tokens = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
    grams = f"CASE WHEN len({{0}}) < {SHINGLE} THEN [array_to_string({{0}}, ' ')] ELSE list_distinct(list_transform(range(1, len({{0}}) - {SHINGLE} + 2), lambda i: array_to_string({{0}}[i : i + {SHINGLE - 1}], ' '))) END"
    # A part shorter than a shingle is looked for as it is, between blanks.
    overlap = f"CASE WHEN len({{w}}) < {SHINGLE} THEN CAST(contains(' ' || array_to_string(r.here, ' ') || ' ', ' ' || array_to_string({{w}}, ' ') || ' ') AS DOUBLE) ELSE len(list_intersect({grams.format('{w}')}, r.seen)) / CAST(len({grams.format('{w}')}) AS DOUBLE) END"
    # The least score follows from how many words can be missing, which no document's text decides; a lower one retrieves the same verified rows.
    return rf"""
WITH items AS (
  SELECT item_id, {tokens.format("text")} AS w, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: {tokens.format("s")}), lambda p: len(p) > 0) AS parts
  FROM benchmark WHERE len({tokens.format("coalesce(text, '')")}) > 0
), split AS (
  SELECT item_id, w, CASE WHEN len(parts) > 1 THEN len(w) - len(parts[-1]) ELSE len(w) - greatest(1, len(w) // 4) END AS cut FROM items
), told AS (
  SELECT item_id, w, CASE WHEN cut > 0 THEN w[1:cut] ELSE w END AS q, CASE WHEN cut > 0 THEN w[cut + 1:] ELSE w END AS a,
         CAST({STRIDE} * pow(4, greatest(0, ceil(log2(len(w) / {STRIDE}.0) / 2))) AS BIGINT) AS stride FROM split
), sizes AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM items),
tf AS (SELECT item_id, t, count(*) AS f FROM (SELECT item_id, unnest(w) AS t FROM items) GROUP BY item_id, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
impact AS (SELECT item_id, t, ln(1 + (n - df + 0.5) / (df + 0.5)) * f * ({K1} + 1) / (f + {K1} * (1 - {B} + {B} * len(w) / mean)) AS x FROM tf JOIN df USING (t) JOIN items USING (item_id), sizes),
shares AS (SELECT item_id, t, x / sum(x) OVER (PARTITION BY item_id) AS share FROM impact),
docs AS (SELECT doc_id, {tokens.format("text")} AS w FROM documents WHERE text IS NOT NULL),
windows AS (
  SELECT doc_id, stride, k, w[k * stride + 1 : least(len(w), (k + 2) * stride)] AS here, k * stride AS word_start
  FROM (SELECT doc_id, w, stride, unnest(range(0, greatest(1, CAST(ceil(len(w) / stride) AS BIGINT) - 1))) AS k FROM docs, (SELECT DISTINCT stride FROM told) WHERE len(w) > 0)
), terms AS (SELECT doc_id, stride, k, unnest(list_distinct(here)) AS t FROM windows),
retrieved AS (SELECT doc_id, terms.stride, k, item_id, sum(share) AS score FROM terms JOIN shares USING (t) JOIN told USING (item_id) WHERE told.stride = terms.stride GROUP BY doc_id, terms.stride, k, item_id HAVING sum(share) >= 0.05),
r AS (SELECT *, {grams.format("here")} AS seen FROM retrieved JOIN windows USING (doc_id, stride, k)),
verified AS (SELECT r.doc_id, r.item_id, r.word_start, score, {overlap.format(w="t.w")} AS o, {overlap.format(w="t.q")} AS oq, {overlap.format(w="t.a")} AS oa FROM r JOIN told t ON r.item_id = t.item_id)
SELECT doc_id, item_id, round(score, 6) AS bm25_share, round(o, 6) AS overlap, round(oq, 6) AS question_overlap, round(oa, 6) AS answer_overlap, word_start
FROM verified WHERE o >= {MIN_OVERLAP} OR (oq >= {MIN_OVERLAP} AND oa >= {MIN_ANSWER}) QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY o DESC, word_start) = 1
"""
