"""Phrase collocations by suffix sorting.

Every word of a text begins a suffix of its piece, cut off after ``longest``
words. Suffixes are shuffled by language and first word, sorted in reverse
lexicographic order, and one stack of open prefixes counts all phrases in a
pass: a phrase is done when a suffix comes that does not begin with it. The
parts of a phrase are phrases themselves, so scores are a join of the counts.

Three things keep this bounded. A suffix ends before a word that is too rare
for any phrase, and before one that follows too rarely on the word before;
bitmaps of fixed size say which words and which pairs may not be. What ends
with its first word is not a suffix any more: words are counted before. Equal
suffixes are counted where they are read. And the words of all languages are
dealt by ranges of suffixes that a sample has balanced: a range is cut between
first words, but within one whose suffixes fill several ranges, and the counts
of the prefixes that reach over a cut are added up.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .words import PIECES, words

#: Longest phrase in words, fewest occurrences, and the share of a phrase's occurrences in percent from which a longer phrase replaces it.
LONGEST, LEAST, COVERED = 5, 100, 100
#: Phrases of a language that are returned.
TOP = 2000
#: Suffixes picked by hash to balance ranges, at most, and bytes kept of each; suffixes of a range, about.
SAMPLE, SAMPLE_BYTES, A_RANGE = 20_000, 96, 1_000_000
#: Bytes of texts whose suffixes are held at once.
WINDOW = 1 << 20
#: Bits of the bitmap of frequent words, at least and at most: 32 MB.
BITS = (1 << 20, 1 << 28)
#: Pairs of words that a task gathers before it counts them.
PAIRS = 1 << 22

GAP = b"\x00"


def _escaped(text: pa.Array) -> pa.Array:
    """Words without the byte that parts them in a key, and the one that escapes it."""
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    if not (data <= 1).any():
        return text
    return pa.array([x.replace("\x01", "\x01\x02").replace("\x00", "\x01\x01") for x in text.to_pylist()], pa.string())


def _unescaped(key: bytes) -> str:
    return key.replace(b"\x01\x01", b"\x00").replace(b"\x01\x02", b"\x01").decode()


def _langs(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    """The language of each row as a number, and their names; null is ``und``."""
    found = pc.fill_null(column.cast(pa.string()), "und").dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_pylist()


def _bit(lang: str, word: str, bits: int) -> int:
    return xxhash.xxh64_intdigest(f"{lang}\x00{word}".encode()) & (bits - 1)


def _coded(w, lang: np.ndarray, names: list[str]):
    """Codes of a (language, word) each, and what they stand for: names' numbers and distinct words."""
    coded = w.text.dictionary_encode()
    n = max(1, len(coded.dictionary))
    both = lang[w.row].astype(np.int64) * n + coded.indices.to_numpy()
    kinds, code = np.unique(both, return_inverse=True)
    return code, kinds // n, coded.dictionary.take(pa.array(kinds % n))


def _suffixes(code: np.ndarray, piece: np.ndarray, longest: int, goes_on: np.ndarray | None = None) -> np.ndarray:
    """For each word the codes of its suffix, -1 behind its end; a suffix ends behind a word that does not go on."""
    n = len(code)
    out = np.full((n, longest), -1, np.int32)
    alive = np.ones(n, bool)
    out[:, 0] = code
    for k in range(1, min(longest, n)):
        alive = alive[:-1] & (piece[k:] == piece[: n - k])
        if goes_on is not None:
            alive &= goes_on[k - 1 : n - 1]
        at = np.flatnonzero(alive)
        out[at, k] = code[at + k]
    return out


def _words_counted(longest: int, sample: int):
    """``lang, word, n``, and suffixes of small hash as ``lang, suffix, hash``."""

    def count(batches):
        for b in batches:
            lang, names = _langs(b.column(1))
            for w in words(b, PIECES, longest - 1, WINDOW):
                code, which, text = _coded(w, lang, names)
                own = len(code) - w.ahead
                n = np.bincount(code[:own], minlength=len(which))
                here = n > 0
                if not own:
                    continue
                nulls = pa.nulls(int(here.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in which[here]], pa.string()), text.filter(pa.array(here)), pa.array(n[here]), nulls], names=["lang", "word", "n", "h"])
                # Each different suffix is as likely as another: the smallest hashes of what it holds, not of where it stands.
                suffix = _suffixes(code, w.piece, longest)[:own]
                mixed = np.zeros(own, np.uint64)
                of_code = np.array([xxhash.xxh64_intdigest(t) for t in (f"{names[k]}\x00{x}" for k, x in zip(which, text.to_pylist()))], np.uint64)
                for k in range(longest):
                    mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ np.where(suffix[:, k] < 0, np.uint64(k), of_code[suffix[:, k]])
                mixed ^= mixed >> np.uint64(29)
                mixed *= np.uint64(0xBF58476D1CE4E5B9)
                mixed = (mixed ^ (mixed >> np.uint64(32))) >> np.uint64(1)
                least = np.argpartition(mixed, min(sample, own) - 1)[:sample] if own > sample else np.arange(own)
                rows = {(int(mixed[i]), names[which[suffix[i, 0]]], " ".join(text[int(c)].as_py() for c in suffix[i] if c >= 0)) for i in least}
                if rows:
                    h, ln, text_of = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(ln, pa.string()), pa.array(text_of, pa.string()), pa.nulls(len(rows), pa.int64()), pa.array(h, pa.int64())], names=["lang", "word", "n", "h"])

    return count


def bitmap_of(frequent: DataFrame) -> np.ndarray:
    """Bits of the words of ``frequent(lang, word)``, sixteen for each, BITS at most; built in tasks, a row for 32,768 bits."""
    bits = min(max(1 << (16 * frequent.count()).bit_length(), BITS[0]), BITS[1])

    def place(batches):
        for b in batches:
            at = [_bit(x, w, bits) for x, w in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], names=["at"])

    at = frequent.select("lang", "word").mapInArrow(place, "at long")
    rows = at.groupBy(F.expr("at div 32768").alias("k")).agg(F.bitmap_construct_agg(F.expr("at % 32768")).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r.k * 4096 : (r.k + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)[: len(out) - r.k * 4096]
    return out


def _hashes(lang: list[str], word: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{x}\x00{w}") for x, w in zip(lang, word)], np.uint64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of two words that follow each other, by their hashes, among 1 << 28."""
    mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed >> np.uint64(36)


def _frequent(at: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which places of a bitmap are set; places beyond its end fold back into it."""
    at = at & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1) == 1


def _known(names: list[str], which: np.ndarray, text: list[str], bitmap: np.ndarray) -> np.ndarray:
    """Which of the words may be frequent."""
    bits = len(bitmap) * 8
    return _frequent(np.array([_bit(names[k], x, bits) for k, x in zip(which, text)], np.uint64), bitmap)


def _pairs_counted(held, blocks: int):
    """Pairs of neighbours that may both be frequent, as ``k, at, n``: for a block of 65,536 places, those met and how often."""

    def out(met: list[np.ndarray]):
        place, n = np.unique(np.concatenate(met), return_counts=True)
        edge = np.flatnonzero(np.append(True, place[1:] >> 16 != place[:-1] >> 16))
        ends = np.append(edge, len(place)).astype(np.int32)
        low, n = place.astype(np.uint16), n.astype(np.uint8 if n.max() < 256 else np.uint32)
        width = n.dtype.itemsize
        binary = lambda x, w: pa.BinaryArray.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(ends * np.int32(w)), pa.py_buffer(x)])
        return pa.RecordBatch.from_arrays([pa.array((place[edge] >> 16).astype(np.int32)), binary(low, 2), binary(n, width)], names=["k", "at", "n"])

    def count(batches):
        bitmap, met, size = held.value, [], 0
        for b in batches:
            lang, names = _langs(b.column(1))
            for w in words(b, PIECES, 1, WINDOW):
                code, which, text = _coded(w, lang, names)
                text = text.to_pylist()
                ok, h = _known(names, which, text, bitmap), _hashes([names[k] for k in which], text)
                both = ok[code[:-1]] & ok[code[1:]] & (w.piece[1:] == w.piece[:-1])
                both[len(code) - w.ahead :] = False
                first = np.flatnonzero(both)
                met.append((_pair(h[code[first]], h[code[first + 1]]) % np.uint64(blocks << 16)).astype(np.uint32))
                size += len(first)
                if size >= PAIRS:
                    yield out(met)
                    met, size = [], 0
        if size:
            yield out(met)

    return count


def _pairs_summed(least: int):
    """Bits of a block's places with ``least`` occurrences, and how many these have; rows of a block follow each other."""

    def out(k: int, total: np.ndarray):
        often = total >= least
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(often, bitorder="little").tobytes()], pa.binary()), pa.array([int(total[often].sum())], pa.int64())], names=["k", "bits", "n"])

    def add(batches):
        now, total = None, None
        for b in batches:
            for k, at, n in zip(*(c.to_pylist() for c in b.columns)):
                if k != now:
                    if total is not None:
                        yield out(now, total)
                    now, total = k, np.zeros(1 << 16, np.int64)
                at = np.frombuffer(at, np.uint16)
                total[at] += np.frombuffer(n, np.uint8 if len(n) == len(at) else np.uint32)
        if total is not None:
            yield out(now, total)

    return add


def pairs_of(texts: DataFrame, held, total: int, least: int) -> tuple[np.ndarray, int]:
    """A bitmap of the pairs of neighbours that may have ``least`` occurrences, and how many occurrences these have about.

    Occurrences are counted by a hash of the pair, with a place for every four
    to eight of ``total`` words, 1 << 28 at most: pairs that share a place are
    added up, so that no frequent one is missed.
    """
    blocks = min(max(1 << (total >> 19).bit_length(), 4), 1 << 12)
    parts = min(blocks, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = texts.mapInArrow(_pairs_counted(held, blocks), "k int, at binary, n binary").repartition(parts, "k").sortWithinPartitions("k")
    rows = dealt.mapInArrow(_pairs_summed(least), "k int, bits binary, n long").collect()  # 8 KB a block
    bitmap = np.zeros(blocks << 13, np.uint8)
    for r in rows:
        bitmap[r.k << 13 : (r.k + 1) << 13] = np.frombuffer(bytes(r.bits), np.uint8)
    return bitmap, sum(r.n for r in rows)


def ranges_of(sample: list[tuple[str, str]], bitmap: np.ndarray, pairs: np.ndarray, n: int, longest: int) -> list[bytes]:
    """Keys at which ``n`` ranges begin: the quantiles of a sample, put back to the beginning of their first word where the range before does not begin within it."""
    keys = []
    for lang, text in sample:
        w = text.split(" ")[:longest]
        ok, h = _known([lang], np.zeros(len(w), int), w, bitmap), _hashes([lang] * len(w), w)
        goes_on = ok[:-1] & ok[1:] & _frequent(_pair(h[:-1], h[1:]), pairs)
        kept = w[: int(np.append(goes_on, False).argmin()) + 1]
        if len(kept) > 1:
            keys.append(GAP.join(x.encode() for x in _escaped(pa.array([lang, *kept], pa.string())).to_pylist()))
    keys.sort()
    cuts: list[bytes] = []
    for k in range(1, n):
        if not keys:
            break
        key = keys[k * len(keys) // n]
        first = GAP.join(key.split(GAP)[:2])
        cut = first if not cuts or cuts[-1] < first else key[:SAMPLE_BYTES]
        if not cuts or cut > cuts[-1]:
            cuts.append(cut)
    return cuts


def _emitted(held, pairs, cuts, longest: int):
    """``part, key, n``: different suffixes of a window, of two words at least, with the range that each lies in."""

    def emit(batches):
        bitmap, often, at_cut = held.value, pairs.value, cuts.value
        for b in batches:
            lang, names = _langs(b.column(1))
            safe = _escaped(pa.array(names, pa.string())).to_pylist()
            for w in words(b, PIECES, longest - 1, WINDOW):
                code, which, text = _coded(w, lang, names)
                told = text.to_pylist()
                ok, h = _known(names, which, told, bitmap), _hashes([names[k] for k in which], told)
                goes_on = ok[code[:-1]] & ok[code[1:]]
                at = np.flatnonzero(goes_on)
                goes_on[at] = _frequent(_pair(h[code[at]], h[code[at + 1]]), often)
                suffix = _suffixes(code, w.piece, longest, goes_on)
                suffix = suffix[: len(code) - w.ahead]
                suffix = suffix[suffix[:, 1] >= 0]
                if not len(suffix):
                    continue
                suffix, n = _different(suffix, len(which))
                text = _escaped(text)
                columns = [pa.array([safe[k] for k in which], pa.string()).take(pa.array(suffix[:, 0]))]
                for k in range(longest):
                    at = suffix[:, k]
                    columns.append(text.take(pa.array(at, mask=at < 0)))
                key = pc.binary_join_element_wise(*columns, "\x00", null_handling="skip").cast(pa.binary())
                begins = [GAP.join((safe[k].encode(), x.encode())) for k, x in zip(which, text.to_pylist())]
                part = _part(key, suffix[:, 0], begins, at_cut)
                yield pa.RecordBatch.from_arrays([pa.array(part), key, pa.array(n)], names=["part", "key", "n"])

    return emit


def _different(rows: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Different rows and how often each stands there, by first two words; where hashes of the others meet, a row may come twice."""
    bits = np.uint64(max(1, codes.bit_length()))
    rest = np.zeros(len(rows), np.uint64)
    for k in range(2, rows.shape[1]):
        rest = (rest ^ (rows[:, k] + 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        rest ^= rest >> np.uint64(31)
    key = rows[:, 0].astype(np.uint64) << (np.uint64(64) - bits) | rest >> (np.uint64(2) * bits)
    if rows.shape[1] > 1:
        key |= (rows[:, 1] + 1).astype(np.uint64) << (np.uint64(64) - np.uint64(2) * bits)
    rows = rows[np.argsort(key)]
    new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
    at = np.flatnonzero(new)
    return rows[at], np.diff(np.append(at, len(rows)))


def _part(key: pa.Array, first: np.ndarray, begins: list[bytes], cuts: list[bytes]) -> np.ndarray:
    """The range of each key, whose first word is ``begins[first]``: one look tells for all keys of a word unless a cut lies within."""
    low = np.array([bisect.bisect_right(cuts, x) for x in begins], np.int32)
    high = np.array([bisect.bisect_right(cuts, x + GAP + b"\xff") for x in begins], np.int32)
    part = low[first]
    for i in np.flatnonzero((low != high)[first]):
        part[i] = bisect.bisect_right(cuts, key[i].as_py())
    return part


class Stack:
    """Open prefixes of sorted suffixes, a batch at a time: what comes in is one batch of keys in descending order, what goes out are the prefixes that are done.

    ``edge`` marks prefixes of the first and last suffix of a range, which may go on in the next one.
    """

    def __init__(self, longest: int, least: int):
        self.longest, self.least = longest, least
        self.key: bytes | None = None
        self.ends: np.ndarray | None = None
        self.open: list[tuple[int, bool]] = []  # count and edge of the last suffix's prefixes, shortest first
        self.out: list[tuple[bytes, int]] = []

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            n, edge = self.open.pop()
            if edge or n >= self.least:
                self.out.append((self.key[: self.ends[len(self.open)]], n))

    def finish(self) -> None:
        """The range is over: all that is open is at its edge."""
        self.open = [(n, True) for n, _ in self.open]
        self._close(0)
        self.key = None

    def push(self, keys: pa.Array, n: np.ndarray) -> None:
        """Suffixes of one range, in descending order."""
        began = self.key is None
        offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
        data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        if not began:  # the last suffix once more, counting nothing
            data = np.concatenate([np.frombuffer(self.key, np.uint8), data])
            offsets = np.concatenate([[0], offsets + len(self.key)])
            n = np.concatenate([[0], n])
        rows, longest = len(offsets) - 1, self.longest
        # Where the words of each suffix end; the first part of a key is its language.
        gaps = np.flatnonzero(data == 0)
        of = np.searchsorted(offsets, gaps, "right") - 1
        size = np.diff(offsets)
        many = np.bincount(of, minlength=rows)
        ends = np.full((rows, longest), -1, np.int64)
        nth = np.arange(len(gaps)) - np.repeat(np.cumsum(many) - many, many)
        inner = nth > 0
        ends[of[inner], nth[inner] - 1] = gaps[inner] - offsets[of[inner]]
        ends[np.arange(rows), many - 1] = size
        # Bytes that a suffix has in common with the one before.
        shared = np.zeros(rows, np.int64)
        least = np.minimum(size[1:], size[:-1])
        alive, j = np.flatnonzero(least > 0), 0
        while len(alive) and j < 64:
            same = data[offsets[alive + 1] + j] == data[offsets[alive] + j]
            alive = alive[same]
            shared[alive + 1] = j + 1
            j += 1
            alive = alive[least[alive] > j]
        for i in alive:  # long ones
            a, b = data[offsets[i] : offsets[i] + least[i]], data[offsets[i + 1] : offsets[i + 1] + least[i]]
            differ = np.flatnonzero(a != b)
            shared[i + 1] = differ[0] if len(differ) else least[i]
        # A word is the same where it ends within that, at the same place.
        common = np.zeros(rows, np.int64)
        going = np.ones(rows - 1, bool)
        for k in range(longest):
            going = going & (ends[1:, k] >= 0) & (ends[1:, k] == ends[:-1, k]) & (ends[1:, k] <= shared[1:])
            common[1:] += going
        depth = many
        buf = data.tobytes()
        last = [(0, began)] * int(depth[-1])
        done: list[tuple[bytes, int]] = []
        for k in range(longest):
            at = np.flatnonzero(depth > k)
            if not len(at):
                break
            begin = common[at] <= k
            begin[0] = True
            heads = np.flatnonzero(begin)
            sums = np.add.reduceat(n[at], heads)
            edge = np.zeros(len(heads), bool)
            if at[0] == 0:
                if began:
                    edge[0] = True
                elif k < len(self.open):
                    sums[0] += self.open[k][0]
                    edge[0] = self.open[k][1]
            tail = depth[-1] > k  # the last group stays open
            told = np.flatnonzero((sums >= self.least) | edge)
            for g in told:
                if tail and g == len(heads) - 1:
                    continue
                i = at[heads[g]]
                done.append((buf[offsets[i] : offsets[i] + ends[i, k]], int(sums[g])))
            if tail:
                last[k] = (int(sums[-1]), bool(edge[-1]))
        self.out += done
        self.key, self.ends, self.open = buf[offsets[-2] : offsets[-1]], ends[-1], last

    def take(self) -> list[tuple[bytes, int]]:
        out, self.out = self.out, []
        return out


def _stacked(longest: int, least: int):
    def run(batches):
        stack, part = Stack(longest, least), None

        def told():
            if out := stack.take():
                pieces = [[_unescaped(x) for x in key.split(GAP)] for key, _ in out]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pieces], pa.string()), pa.array([" ".join(p[1:]) for p in pieces], pa.string()), pa.array([len(p) - 1 for p in pieces], pa.int32()), pa.array([n for _, n in out], pa.int64())], names=["lang", "phrase", "size", "f"])

        for b in batches:
            parts, n = b.column(0).to_numpy(), b.column(2).to_numpy()
            heads = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else []
            for i, at in enumerate(heads):
                end = heads[i + 1] if i + 1 < len(heads) else len(parts)
                if parts[at] != part:
                    if part is not None:
                        stack.finish()
                    part = parts[at]
                stack.push(b.column(1).slice(at, end - at), n[at:end])
            yield from told()
        if part is not None:
            stack.finish()
            yield from told()

    return run


def phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, a_range: int = A_RANGE) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, f`` of all phrases of up to ``longest`` words with ``least`` occurrences, and ``lang, n``, all occurrences of words."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"))
    seen = texts.mapInArrow(_words_counted(longest, 64), "lang string, word string, n long, h long")
    # One pass counts words and picks the sample: hashes of suffixes are rows of their own.
    seen = stored(seen.groupBy("lang", "word", "h").agg(F.sum("n").alias("n")), "words")
    counts = seen.where("h is null")
    total = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = counts.where(F.col("n") >= least)
    single = frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), F.col("n").alias("f"))
    if longest < 2:
        return single, total
    bitmap = bitmap_of(frequent)
    sc = spark.sparkContext
    held = sc.broadcast(bitmap)
    pairs, many = pairs_of(texts, held, frequent.agg(F.sum("n")).first()[0] or 0, least)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-many // a_range))
    picked = seen.where("h is not null").orderBy("h").limit(max(SAMPLE, 20 * ranges)).select("lang", F.substring("word", 1, 16 * SAMPLE_BYTES).alias("word")).collect()
    cuts = ranges_of([(r.lang, r.word) for r in picked], bitmap, pairs, ranges, longest)
    suffixes = texts.mapInArrow(_emitted(held, sc.broadcast(pairs), sc.broadcast(cuts), longest), "part int, key binary, n long")
    dealt = suffixes.repartition(ranges, "part").sortWithinPartitions(F.desc("key"))  # ranges follow each other by key
    found = dealt.mapInArrow(_stacked(longest, least), "lang string, phrase string, size int, f long")
    # What reaches over a cut has several counts. Words were counted at first: here only those that begin a frequent pair are met.
    found = found.where("size > 1").groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return found.unionByName(single), total


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP, a_range: int = A_RANGE) -> DataFrame:
    """The phrases of each language of ``docs(text, lang)`` whose words hold together best.

    Returns ``lang, rank, phrase, a, l, r, n, score``: a phrase of 2 to
    ``longest`` words occurs a times, ``least`` at least; of its cuts into two
    parts, which occur l and r times, the one with the lowest score floor(1000
    * a * n / (l * r)) counts, ties to the shortest first part; n is the
    language's word occurrences. A phrase that lies within a longer one with
    ``covered`` percent of its occurrences is left out. The first ``top`` of a
    language by score, a and phrase are returned.

    Words are what blanks and tabs part, in pieces that punctuation and line
    ends part, lower-cased (A-Z only). A null language is ``und``; null and
    empty texts hold no words; repeated rows count each; other columns are
    ignored; an empty table gives no rows. Products are exact up to 38 digits.
    """
    found, total = phrases(docs, longest, least, a_range)
    found = stored(found, "phrases")
    some = found.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("w"))
    # A candidate that a longer phrase covers is a row of the longer one's inner phrases.
    inner = some.where("size > 2").select("lang", "size", "w", F.col("a").alias("longer"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"))
    inner = inner.select("lang", "longer", "k", "w", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("i"))
    inner = inner.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("k")), " ").alias("phrase")).agg(F.max("longer").alias("longer"))
    some = some.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < F.lit(covered) * F.col("a"), F.lit(True)))
    cut = some.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    part = lambda name, n: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    cut = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(F.broadcast(total) if total.count() <= 10_000 else total, "lang")
    wide = "cast({} as decimal(38, 0))".format
    cut = cut.withColumn("score", F.expr(f"{wide(f'1000 * {wide("a")} * {wide("n")}')} div {wide(f'{wide("l")} * {wide("r")}')}"))
    best = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "n", "b.l", "b.r", "b.score")
    # The first of each hash group, then of a language: no group is more than a task's share of rows and the first of the others.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    dealt = best.withColumn("__g", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__g").orderBy(*order))).where(F.col("rank") <= top)
    placed = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return placed.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = """
with pieces as (
  select doc, lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece
  from (select row_number() over () as doc, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents)
), worded as (
  select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces
), counted as (
  select lang, w, len(w) as size, count(*) as c from worded where len(w) > 0 group by all
), starts as (
  select lang, w, size, c, unnest(range(1, size + 1)) as i from counted
), grams as (
  select lang, w, c, i, unnest(range(1, least(5, size - i + 1) + 1)) as k from starts
), f as (
  select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, k, sum(c)::bigint as f from grams group by all having sum(c) >= 100
), total as (
  select lang, sum(size * c)::bigint as n from counted group by lang
), candidates as (
  select lang, phrase, k as size, f as a, string_split(phrase, ' ') as w from f where k >= 2
), inner_phrases as (
  select lang, a as longer, w, size, m, unnest(range(1, size - m + 2)) as i from (select *, unnest(range(2, size)) as m from candidates)
), covered as (
  select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(longer) as longer from inner_phrases group by all
), kept as (
  select c.* from candidates c left join covered v using (lang, phrase) where v.longer is null or 100 * v.longer < 100 * c.a
), cuts as (
  select lang, phrase, a, k, array_to_string(w[1:k], ' ') as l_part, array_to_string(w[k + 1:size], ' ') as r_part from (select *, unnest(range(1, size)) as k from kept)
), scored as (
  select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r, t.n, (1000::hugeint * c.a * t.n // (x.f::hugeint * y.f))::bigint as score
  from cuts c join f x on x.lang = c.lang and x.phrase = c.l_part join f y on y.lang = c.lang and y.phrase = c.r_part join total t on t.lang = c.lang
), best as (
  select *, row_number() over (partition by lang, phrase order by score, k) as place from scored
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from best where place = 1
)
select lang, rank::bigint as rank, phrase, a, l, r, n, score from ranked where rank <= 2000
"""
