"""Spelling variants: a trie self-join of the vocabulary with active-node sets.

The active nodes of a trie node are those that one edit at most tells from it.
A child's come from its parent's: along the same letter an active node's own
child stays active, and the node that is the parent itself spends its one edit
as a letter left out, put in or replaced. Two words are near when one ends at a
node that is active where the other ends.

The trie is dealt by prefix. A pair that first differs behind the prefix lies
in one part, whose root starts with itself as its only equal. A pair that
differs before agrees from there on to its end, as long as words have twice as
many letters as the prefix, and so lies in one part of the trie of reversed
words. A part of too many words is dealt again, a letter deeper; what differs
at that very letter has spent its edit there and meets by the rest.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .words import words

#: Fewest code points and occurrences of a word; one occurrence in so many is misspelt; a form is so many times as frequent.
SHORTEST, LEAST, MISSPELT, TIMES = 6, 5, 199, 5
#: Words of a part of the trie, at most.
PART = 20_000
#: Runs of more bytes are hashed one by one.
LONG = 64

CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, np.uint32(0xEDB88320) ^ (CRC >> 1), CRC >> 1).astype(np.uint32)


def crc32(text: pa.Array, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of each string behind what ``begun`` is the CRC-32 of; letter by letter for all strings at once."""
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    at, state = offsets[:-1][order], ~begun[order]
    left = np.searchsorted(-size[order], -np.arange(LONG), "left") if len(order) and size[order[0]] <= LONG else np.array([np.count_nonzero((size > j)) for j in range(LONG)])
    for j, n in enumerate(left):
        if not n:
            break
        state[:n] = CRC[(state[:n] ^ data[at[:n] + j]) & 255] ^ (state[:n] >> 8)
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(data[offsets[i] : offsets[i + 1]], int(begun[i]))
    return out


def _counted(shortest: int, misspelt: int):
    def count(batches):
        for b in batches:
            begun = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in b.column(1).to_pylist()], np.uint32)
            for w in words(b, None):
                keep = pc.utf8_length(w.text).to_numpy(zero_copy_only=False) >= shortest
                if w.ahead:
                    keep[-w.ahead :] = False
                text = w.text.filter(pa.array(keep))
                if not len(text):
                    continue
                h = crc32(text, begun[w.row[keep]])
                hit = h % misspelt == 0
                found = Counter()
                for i in np.flatnonzero(hit):
                    run = text[i].as_py()
                    k = int(h[i]) % len(run)
                    if len(run) > shortest:
                        found[run[:k] + run[k + 1 :]] += 1
                counts = text.filter(pa.array(~hit)).value_counts()
                yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["word", "n"])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    return count


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, misspelt: int = MISSPELT) -> DataFrame:
    """``word, n`` of whole texts; runs are counted where they are read, and summed by word."""
    runs = docs.select(F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(_counted(shortest, misspelt), "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def trie_pairs(strings: list[str], depth: int) -> list[tuple[int, int]]:
    """Pairs of different sorted ``strings`` that share ``depth`` letters and are one edit apart, both ways round."""
    # A node is its children by letter, and the number of the string that ends there.
    root: dict = {}
    for k, s in enumerate(strings):
        node = root
        for c in s[depth:]:
            node = node.setdefault(c, {})
        node[""] = k
    below = lambda node: [x for c, x in node.items() if c]
    out, todo = [], [(root, below(root))]
    while todo:
        node, active = todo.pop()  # active: what is one edit away
        if (k := node.get("")) is not None:
            out += [(k, j) for x in active if (j := x.get("")) is not None]
        for c, child in node.items():
            if not c:
                continue
            near = {id(x): x for x in below(child)}  # a letter more
            near[id(node)] = node  # a letter less
            for other, x in node.items():  # another letter
                if other and other != c:
                    near[id(x)] = x
            for x in active:  # the edit was before
                if (y := x.get(c)) is not None:
                    near[id(y)] = y
            near.pop(id(child), None)
            todo.append((child, list(near.values())))
    return out


def _walked(prefix: int):
    def walk(batches):
        key, group = None, []

        def pairs():
            back, depth = key[0], len(key[1])
            found = trie_pairs([s for s, _ in group], depth)
            spelt = [s[::-1] if back else s for s, _ in group]
            if back:  # the others lie in a part of the words as they are
                found = [(i, j) for i, j in found if spelt[i][:prefix] != spelt[j][:prefix]]
            for at in range(0, len(found), 50_000):
                some = found[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([spelt[i] for i, _ in some], pa.string()), pa.array([spelt[j] for _, j in some], pa.string()), pa.array([group[j][1] for _, j in some], pa.int64())], names=["word", "near", "near_n"])

        for b in batches:
            for back, part, s, n in zip(*(c.to_pylist() for c in b.columns)):
                if (back, part) != key:
                    if len(group) > 1:
                        yield from pairs()
                    key, group = (back, part), []
                group.append((s, n))
        if len(group) > 1:
            yield from pairs()

    return walk


def near_words(vocabulary: DataFrame, shortest: int = SHORTEST, most: int = PART) -> DataFrame:
    """``word, near, near_n``: each pair of different words of ``vocabulary(word, n)`` that one edit tells apart, both ways round. Words have ``shortest`` code points at least."""
    prefix = shortest // 2
    ways = F.array(F.struct(F.lit(False).alias("back"), F.col("word").alias("s")), F.struct(F.lit(True).alias("back"), F.reverse("word").alias("s")))
    rows = vocabulary.select("n", F.explode(ways).alias("w")).select("w.back", "w.s", "n")
    depth, parts, met = prefix, [], []
    while True:
        rows = rows.withColumn("part", F.substring("s", 1, depth))
        hot = stored(rows.groupBy("back", "part").agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") > most).drop("__c"), "hot-parts")
        if hot.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(hot, ["back", "part"], "left_anti"))
        rows = stored(rows.join(hot, ["back", "part"], "left_semi"), "hot-words")
        met.append(_at_letter(rows, depth, prefix))
        rows = rows.where(F.length("s") > depth).drop("part")
        depth += 1
    tries = parts[0]
    for more in parts[1:]:
        tries = tries.unionByName(more)
    spread = tries.select("back", "part", "s", "n").repartition("back", "part").sortWithinPartitions("back", "part", "s")
    found = spread.mapInArrow(_walked(prefix), "word string, near string, near_n long")
    for more in met:
        found = found.unionAll(more)
    return found


def _at_letter(rows: DataFrame, depth: int, prefix: int) -> DataFrame:
    """Pairs of a part that first differ at the letter behind ``depth``: they are equal behind it, or one is equal to what the other has behind it. No rest has more words than there are letters."""
    rest = lambda skip: F.expr(f"substring(s, {depth + 1 + skip})")
    letter = F.substring("s", depth + 1, 1)
    whole = rows.select("back", "part", "s", "n", rest(0).alias("rest"), F.lit("").alias("c"))
    cut = rows.where(F.length("s") > depth).select("back", "part", "s", "n", rest(1).alias("rest"), letter.alias("c"))
    one = whole.unionAll(cut)
    two = one.select("back", "part", "rest", F.col("s").alias("t"), F.col("n").alias("m"), F.col("c").alias("d"))
    apart = F.substring("s", 1, depth + 1) != F.substring("t", 1, depth + 1)
    both = one.join(two, ["back", "part", "rest"]).where(((F.col("c") != "") | (F.col("d") != "")) & apart)
    spelt = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c))
    both = both.select("back", spelt("s").alias("word"), spelt("t").alias("near"), F.col("m").alias("near_n"))
    return both.where(~F.col("back") | (F.substring("word", 1, prefix) != F.substring("near", 1, prefix))).drop("back")


def variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, misspelt: int = MISSPELT, times: int = TIMES, most: int = PART) -> DataFrame:
    """Words of ``docs(doc_id, text)`` with the more frequent words that they may be misspellings of.

    Returns ``word, form, root, n, n_near, form_n``, a row per word: the form
    is the most frequent near word (ties: smallest in code-point order) if it
    occurs ``times`` as often, else null; the root is where following forms
    ends. Runs of letters are lower-cased (A-Z only), and one occurrence in
    about ``misspelt`` is misspelt first, as the hash of doc_id and run says.

    Null and empty texts hold no words; a null doc_id hashes as the empty
    text; repeated rows count each; other columns are ignored; an empty table
    gives no rows. Texts are read whole, a window at a time.
    """
    known = stored(vocabulary(docs, shortest, least, misspelt), "vocabulary")
    near = near_words(known, shortest, most)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    told = known.join(best, "word", "left")
    form_n = -F.col("best.less")
    formed = form_n >= times * F.col("n")
    told = stored(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, form_n).alias("form_n")), "forms")
    far = stored(told.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:  # each round doubles how far a root looks; a form is times as frequent, so that few rounds reach the last
        on = far.select(F.col("word").alias("root"), F.col("root").alias("on"))
        if far.join(on, "root", "left_semi").isEmpty():
            break
        new = stored(far.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root")), "roots")
        discard(far)
        far = new
    return told.join(far, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: Bits of a CRC-32 a step: a byte is put in, then eight times the lowest bit goes out.
SQL = """
with recursive runs as (
  select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) as raw from documents
), lower_runs as (
  select coalesce(cast(doc_id as varchar), '') as id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as c
  from runs group by all having length(run) >= 6
), bytes as (
  select run, c, hex(encode(id || ':' || run)) as hexed from lower_runs
), steps as (
  select run, c, flatten(list_transform(range(0, length(hexed) // 2), lambda i: [cast('0x' || substr(hexed, 2 * i + 1, 2) as bigint), -1, -1, -1, -1, -1, -1, -1, -1])) as step from bytes
), hashed as (
  select run, c, xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, step), lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384::bigint) else a // 2 end)) as h from steps
), spelt as (
  select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, c from hashed
), vocab as (
  select word, sum(c)::bigint as n from spelt where length(word) >= 6 group by word having sum(c) >= 5
), cuts as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from vocab)
), pairs as (
  select a.word, b.word as near, b.n as near_n from cuts a join cuts b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, v.word, v.n from cuts a join vocab v on a.rest = v.word
  union select v.word, a.word, a.n from cuts a join vocab v on a.rest = v.word
), ranked as (
  select word, near, near_n, count(*) over (partition by word) as n_near, row_number() over (partition by word order by near_n desc, encode(near)) as place from pairs
), told as (
  select v.word, v.n, coalesce(r.n_near, 0)::bigint as n_near, case when r.near_n >= 5 * v.n then r.near end as form, case when r.near_n >= 5 * v.n then r.near_n end as form_n
  from vocab v left join ranked r on r.word = v.word and r.place = 1
), walk as (
  select word, word as at from told union all select w.word, t.form from walk w join told t on t.word = w.at where t.form is not null
), ends as (
  select w.word, w.at as root from walk w join told t on t.word = w.at where t.form is null
)
select t.word, t.form, e.root, t.n, t.n_near, t.form_n from told t join ends e using (word)
"""
