"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two fingerprints within four differing bits
differ in at most four bytes, so they share at least four positional bytes: that
is the guaranteed minimum. Whatever four positions they share, one of twenty
fixed position triples lies inside (a covering of all four-subsets of eight
positions), so every distinct fingerprint is dealt to the lists of its bytes at
those twenty triples; a list of more than HOT is dealt again by one byte more,
which a pair needs anyway. A list is then an inverted index of its own: it
posts its members under their byte at each other position. A member's postings
are tallied, what it shares fewer than four positional bytes with is dropped,
and only the rest is verified by bits.

A list is searched breadth-first, so it yields one link for each member at most.
"""

from __future__ import annotations

from functools import partial
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from .common import components, sliced, stored

SHINGLE, SEED, MAX_BITS, MIN_BYTES = 4, 42, 4, 4
#: Members of a list from which it is dealt by one byte more; members up to which all its pairs are tallied at once.
HOT, FEW = 4096, 8


def position_triples() -> list[tuple[int, int, int]]:
    """Twenty triples such that every four of eight byte positions contain one.

    The complement of Turan's construction: positions fall into classes of
    3, 3 and 2; a triple is taken if it lies in a class, or has two
    positions in one class and one in the next.
    """
    cls = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for t in combinations(range(8), 3):
        c = sorted(cls[p] for p in t)
        if c[0] == c[2] or c in ([0, 0, 1], [1, 1, 2], [0, 2, 2]):
            out.append(t)
    assert all(any(set(t) <= set(q) for t in out) for q in combinations(range(8), MIN_BYTES))
    return out


TRIPLES = position_triples()
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes | None) -> list[int]:
    """XXH64 of each word shingle; bytes.lower and bytes.split know exactly A-Z and the six ASCII white spaces."""
    words = (text or b"").lower().split()
    if not words:
        return []
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return [digest(flat, SEED)]
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    return [digest(flat[s:e], SEED) for s, e in zip([0, *(e + 1 for e in ends)], ends[SHINGLE - 1 :])]


def fingerprints(texts: list[bytes | None], block: int = 1 << 19) -> np.ndarray:
    """A fingerprint per text, as int64. Bits are counted in byte lanes of 255 rows at most, for many texts at once."""
    out, held, sizes, at = np.zeros(len(texts), np.uint64), [], [], []

    def flush() -> None:
        if not sizes:
            return
        h = np.array(held, np.uint64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        cuts = [np.arange(s, s + n, 255) for s, n in zip(starts, sizes)]
        first = np.concatenate([[0], np.cumsum([len(c) for c in cuts])[:-1]])
        cuts = np.concatenate(cuts)
        bits = np.empty((len(sizes), 8, 8), np.uint8)  # text, byte, bit
        n = np.array(sizes)
        for b in range(8):
            lanes = np.add.reduceat((h >> np.uint64(b)) & LANES, cuts)
            counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first)
            bits[:, :, b] = counts * 2 > n[:, None]
        out[at] = np.packbits(bits, axis=2, bitorder="little").reshape(-1, 8).copy().view("<u8").ravel()
        held.clear(), sizes.clear(), at.clear()

    for i, text in enumerate(texts):
        if h := shingle_hashes(text):
            held.extend(h)
            sizes.append(len(h))
            at.append(i)
            if len(held) >= block:
                flush()
    flush()
    return out.view(np.int64)


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, said, fp`` (longs) for each row of ``docs``; ``said`` is a hash of the text."""

    def run(batches):
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(fingerprints(b.column(0).to_pylist()))], names=["doc_id", "said", "fp"])

    return docs.select(F.col("text").cast("binary").alias("text"), "doc_id", F.xxhash64("text").alias("said")).mapInArrow(run, "doc_id long, said long, fp long")


def _bits(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b).view(np.uint64)) <= MAX_BITS


def _small(fp: np.ndarray, starts: np.ndarray, ends: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (as index pairs) in lists of FEW members at most, for all lists at once."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    row = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends)]) if len(starts) else left[0]
    end_of = np.repeat(ends, ends - starts)
    octets = fp.view(np.uint8).reshape(-1, 8)
    for d in range(1, FEW):
        i = row[row + d < end_of]
        tally = (octets[i] == octets[i + d]).sum(1)
        kept = i[tally >= MIN_BYTES]
        found = kept[_bits(fp[kept], fp[kept + d])]
        told += (len(i), len(i) - len(kept), len(kept))
        left.append(found), right.append(found + d)
    return np.concatenate(left), np.concatenate(right)


def _list(fp: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Enough links (as index pairs) in one list to join all of its members that reach each other."""
    octets = fp.view(np.uint8).reshape(-1, 8)
    alike = (octets == octets[0]).all(0)
    shared = int(alike.sum())  # positional bytes that every pair of this list shares
    postings = []
    for p in np.flatnonzero(~alike):
        order = np.argsort(octets[:, p], kind="stable")
        postings.append((p, order, np.searchsorted(octets[order, p], np.arange(257))))
    left, right = [], []
    alive, first, rest = np.ones(len(fp), bool), 0, np.arange(len(fp))

    def partners(i):
        nonlocal rest
        if shared >= MIN_BYTES:  # every member has the minimum
            if 2 * alive.sum() < len(rest):
                rest = rest[alive[rest]]
            kept = rest[alive[rest]]
            met = len(kept)
        else:
            lists = [order[cut[v] : cut[v + 1]] for p, order, cut in postings for v in (int(octets[i, p]),)]
            met = np.concatenate(lists) if lists else rest[:0]
            met = met[alive[met]]
            if shared + 1 >= MIN_BYTES:
                kept = np.unique(met)
            else:
                each, tally = np.unique(met, return_counts=True)
                kept = each[tally + shared >= MIN_BYTES]
            met = int(alive.sum())
        told[:] += (met, met - len(kept), len(kept))
        return kept[_bits(fp[kept], fp[i])]

    while first < len(fp):
        if alive[first]:
            alive[first] = False
            front = [first]
            while front:
                i = front.pop()
                got = partners(i)
                alive[got] = False
                left.append(np.full(len(got), i)), right.append(got)
                front.extend(got.tolist())
        first += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _search(batches, tallies=None):
    """Lists arrive sorted by key; a list that a batch cuts is carried on to the next."""
    key = fp = rep = np.zeros(0, np.int64)
    told = np.zeros(3, np.int64)

    def take(last: bool):
        nonlocal key, fp, rep
        bounds = np.flatnonzero(np.diff(key)) + 1
        upto = len(key) if last else (bounds[-1] if len(bounds) else 0)
        starts, ends = np.concatenate([[0], bounds]), np.concatenate([bounds, [len(key)]])
        use = (ends - starts > 1) & (ends <= upto)
        few = use & (ends - starts <= FEW)
        pairs = [_small(fp, starts[few], ends[few], told)]
        for s, e in zip(starts[use & ~few], ends[use & ~few]):
            i, j = _list(fp[s:e], told)
            pairs.append((i + s, j + s))
        i, j = (np.concatenate(x) for x in zip(*pairs))
        out = pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], names=["a", "b"])
        key, fp, rep = key[upto:], fp[upto:], rep[upto:]
        return out

    held, size = [], 0
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        size += b.num_rows
        if size >= max(1 << 18, len(key)):
            key, fp, rep = (np.concatenate([old, *new]) for old, new in zip((key, fp, rep), zip(*held)))
            held, size = [], 0
            yield take(False)
    if held:
        key, fp, rep = (np.concatenate([old, *new]) for old, new in zip((key, fp, rep), zip(*held)))
    if len(key):
        yield take(True)
    if tallies:
        for n, counter in zip(told, tallies):
            counter.add(int(n))


def _byte(p: int):
    return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))


#: Bits of the five parts that four bytes are cut into: the first bit of each, and how many.
PARTS = ((0, 7), (7, 7), (14, 6), (20, 6), (26, 6))
#: The four positions outside a triple and one more, by triple and position.
OTHERS = [[[q for q in range(8) if q not in (*t, p)][:4] for p in range(8)] for t in TRIPLES]


def _rest():
    """The bits of the four bytes that members of a list dealt by four positions need not share, as its ``key`` tells."""
    triple, p = F.expr("cast(shiftright(key, 24) & 31 as int)"), F.expr("cast(shiftright(key, 37) as int)")
    at = F.element_at(F.element_at(F.lit(OTHERS), triple + 1), p)
    octets = F.array(*(_byte(q) for q in range(8)))
    return F.aggregate(at, F.lit(0).cast("long"), lambda x, q: x * 256 + F.element_at(octets, q + 1))


def _part(k: int):
    first, bits = PARTS[k]
    value = F.shiftright("rest", first).bitwiseAND(F.lit((1 << bits) - 1))
    return (F.lit(k + 1) * 128 + value) * F.lit(1 << 44) + F.col("key")


def links(distinct: DataFrame, tallies=None, hot: int = HOT) -> DataFrame:
    """``a, b``: enough links between ``distinct(fp, rep)`` to join all that lie within four bits, through chains.

    ``tallies``, three accumulators, are told how many pairs were met, were dropped by their count, and were verified.
    """
    keys = [F.lit(n) * (1 << 24) + _byte(p) * 65536 + _byte(q) * 256 + _byte(r) for n, (p, q, r) in enumerate(TRIPLES)]
    posted = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp", "rep")
    long = stored(posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key"), "hot-lists")
    # A pair of a long list shares one byte more, at one of the five positions outside the triple.
    more = [F.when(F.shiftright("key", 24).isin([n for n, t in enumerate(TRIPLES) if p not in t]), ((F.lit(p + 1) * 256 + _byte(p)) * (1 << 29) + F.col("key"))) for p in range(8)]
    again = posted.join(long, "key", "left_semi").select(F.explode(F.array(*more)).alias("key"), "fp", "rep").where("key is not null")
    dealt = posted.join(long, "key", "left_anti")
    # Members of a list that is long still share four bytes. Of five parts of the other four bytes, four bits that differ leave one alike.
    longer = stored(again.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key"), "hot-lists")
    if not longer.isEmpty():
        parts = again.join(longer, "key", "left_semi").withColumn("rest", _rest()).select(F.explode(F.array(*(_part(k) for k in range(len(PARTS))))).alias("key"), "fp", "rep")
        again = again.join(longer, "key", "left_anti").unionByName(parts)
    dealt = dealt.unionByName(again)
    return dealt.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(partial(_search, tallies=tallies), "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every row of ``docs(doc_id, text, ...)``.

    Returns ``doc_id, said`` (a hash of the text), ``fp`` (long),
    ``fingerprint`` (16 lower-case hex digits) and ``component_id`` (smallest
    doc_id reachable over links of four bits or fewer). Null and empty texts
    have fingerprint zero and link like any other; very long texts are read
    whole; repeated rows each get their row; rows of one doc_id with several
    texts link each by its own text; a row without doc_id gets its group's
    component but never names one; other columns are ignored.
    """
    fps = stored(with_fingerprints(docs), "fp")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fp-distinct")
    parts = components(links(distinct.where("rep is not null")), "fp-links")
    of = distinct.join(parts, distinct.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(of, "fp", "left").select("doc_id", "said", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without near-duplicates: of each component the document with the smallest doc_id stays, with all its columns.

    Of rows that repeat its doc_id one stays: of those in the component, that
    with the smallest hash of its text, and of these the least by its columns,
    of which those that hold a map, which has no order, go by their JSON text. Rows without doc_id can't be told apart by it, take
    no part and stay. Columns of any name and type come along.
    """
    names, kinds = docs.columns, [f.dataType for f in docs.schema.fields]
    # Under other names, so that none can clash with what is added.
    docs = docs.toDF(*(f"k{i}" for i in range(len(names))))
    key, said = F.col(f"k{names.index('doc_id')}"), F.xxhash64(f"k{names.index('text')}")
    own, mine = docs.where(key.isNotNull()), F.col("doc_id") == F.col("component_id")
    state = near_duplicates(own.select(key.alias("doc_id"), F.col(f"k{names.index('text')}").alias("text"))).groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("__n"), F.min(F.when(mine, F.col("said"))).alias("__said"))
    # Most rows are neither copies nor repeated, so what is known of the others is the small side, which Spark measures.
    odd = stored(state.where("__n > 1 or __said is null"), "fp-odd")
    single = own.join(odd.select("__id"), key == F.col("__id"), "left_anti")
    firsts = odd.where("__n > 1 and __said is not null")
    again = own.join(firsts, (key == F.col("__id")) & (said == F.col("__said")))
    order = [F.to_json(F.struct(F.array_sort(F.map_entries(c)))) if isinstance(t, MapType) else (F.to_json(F.struct(c)) if _holds_map(t) else F.col(c)) for c, t in zip(docs.columns, kinds)]
    one = again.groupBy("__id").agg(F.min_by(F.struct(*docs.columns), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))).alias("__row")).select("__row.*")
    return single.unionAll(one).unionAll(docs.where(key.isNull())).toDF(*names)


def _holds_map(kind) -> bool:
    """Whether a value of this type can hold a map, which has no order."""
    return isinstance(kind, (ArrayType, StructType, MapType)) and "map<" in kind.simpleString()
