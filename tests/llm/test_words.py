"""Word cutting, spelling variants and collocations against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import collocation, spelling, words

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def batch(texts, ids=None):
    raw = [None if t is None else t.encode() for t in texts]
    return pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], names=["text"])


TEXTS = ["One two, THREE.", None, "", "  ", "été ÀB-naïve x’y×z", "a\x00b \x01c\tÉ", "ab " * 300, "word" * 200 + " end", "x,y;" * 200, "tail", "no stop here " * 90 + "é" * 400]


@pytest.mark.parametrize("window", [16, 64, 1 << 20])
def test_words_of_any_window(monkeypatch, window):
    monkeypatch.setattr(words, "WINDOW", window)
    for table, pattern in ((words.PIECES, re.compile(r"[^ \t.,;:!?\n\x0b\x0c\r]+")), (None, LETTERS)):
        got = defaultdict(list)
        for w in words.words(batch(TEXTS), table, 2):
            own = len(w.text) - w.ahead
            for r, t in zip(w.row[:own], w.text[:own].to_pylist()):
                got[int(r)].append(t)
        assert got == {i: found for i, t in enumerate(TEXTS) if (found := pattern.findall((t or "").translate(LOWER)))}


def test_crc_of_many():
    r = random.Random(1)
    texts = ["".join(r.choice("abcé") for _ in range(r.choice([1, 5, 9, 63, 64, 65, 300]))) for _ in range(200)]
    begun = np.array([zlib.crc32(f"{i}:".encode()) for i in range(200)], np.uint32)
    want = [zlib.crc32(f"{i}:{t}".encode()) for i, t in enumerate(texts)]
    assert spelling.crc32(pa.array(texts), begun).tolist() == want
    short = [t[:9] for t in texts]
    assert spelling.crc32(pa.array(short), begun).tolist() == [zlib.crc32(f"{i}:{t}".encode()) for i, t in enumerate(short)]
    assert spelling.crc32(pa.array([], pa.string()), begun[:0]).tolist() == []


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, misspelt, least):
    n = Counter()
    for i, t in rows:
        for raw in LETTERS.findall(t or ""):
            run = raw.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % misspelt == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 5 * n[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


@pytest.mark.parametrize("most", [20_000, 3])
def test_spelling_is_plain_edit_distance(docs_of, monkeypatch, most):
    monkeypatch.setattr(words, "WINDOW", 256)
    r = random.Random(most)
    base = ["".join(r.choice("abé") for _ in range(r.choice([5, 6, 7, 8]))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "naïveté", "naivete", "x" * 90]
    weight = [3 ** r.randrange(6) for _ in base]
    rows = [(i, " ".join(w.upper() if r.random() < 0.1 else w for w in r.choices(base, weight, k=r.choice([0, 3, 200])))) for i in range(40)]
    rows += [(None, "aaaaaa bbbbbb"), (None, "aaaaaa bbbbbb"), (3, rows[3][1]), (90, None), (91, ""), (92, "1234567 一丁丂七丄丅"), (93, " ".join(base * 30))]
    got = spelling.variants(docs_of(rows), misspelt=7, least=2, most=most).select("word", "form", "root", "n", "n_near", "form_n")
    want = plain_variants(rows, 7, 2)
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want) and sum(x[1] is not None for x in want) > 5
    assert any(x[1] and x[1] != x[2] for x in want)  # a chain


def test_spelling_of_nothing(docs_of):
    assert spelling.variants(docs_of([(1, "abcdef")]).where("false")).count() == 0
    assert spelling.variants(docs_of([(1, None), (2, ""), (3, "abc")])).count() == 0


def plain_collocations(rows, longest, least, covered, top):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (t or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(longest, len(w) - i) + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = set()
    for lang, counts in f.items():
        big = {p: a for p, a in counts.items() if a >= least}
        within = Counter()
        for p, a in big.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    within[p[i : i + k]] = max(within[p[i : i + k]], a)
        rows = []
        for p, a in big.items():
            if len(p) > 1 and not (p in within and 100 * within[p] >= covered * a):
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), " ".join(p), a, counts[p[:k]], counts[p[k:]], score))
        out |= {(lang, i + 1, x[3], *x[4:7], n[lang], x[7]) for i, x in enumerate(sorted(rows)[:top])}
    return out


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize(("window", "a_range"), [(1 << 20, 1 << 20), (64, 20)])
def test_collocations_are_plain_counts(docs_of, monkeypatch, window, a_range):
    monkeypatch.setattr(collocation, "WINDOW", window)
    r = random.Random(a_range)
    vocabulary = ["the", "a", "a\x01", "a\x00", "\x00", "\x01", "of", "Été", "|", "x" * 80, "x" * 80 + "y", *(f"w{i}" for i in range(30))]
    rows = []
    for i in range(120):
        pieces = [" ".join(r.choices(vocabulary, [9, 9, 4, 4, 2, 2, 6, 3, 2, 2, 2] + [1] * 30, k=r.choice([0, 1, 2, 5, 30]))) for _ in range(r.choice([1, 4, 9]))]
        rows.append((i, "".join(p + r.choice([".", ", ", "\n", "\x0b", "!? "]) for p in pieces), r.choice(["en", "de", None, "und", "e\x00n"])))
    rows += [(500, "the a of " * 200, "en"), (500, "the a of " * 200, "en"), (None, "same same same same same same same", "de"), (7, None, "en"), (8, "", None), (9, "once only", "fr")]
    got = collocation.collocations(docs_of(rows), least=5, covered=90, top=25, a_range=a_range)
    assert {tuple(x) for x in got.select(COLUMNS).collect()} == plain_collocations(rows, 5, 5, 90, 25)
    assert got.count() > 60


def test_collocations_of_nothing(docs_of):
    for rows in ([(1, "a b")], [(1, None, "en"), (2, "", None)]):
        assert collocation.collocations(docs_of(rows).where("doc_id > 1")).count() == 0


def test_products_beyond_64_bits(spark):
    a = spark.sql("select cast(cast(1000 * cast(9000000000000 as decimal(38, 0)) * cast(9000000000000000 as decimal(38, 0)) as decimal(38, 0)) div cast(cast(9000000000001 as decimal(38, 0)) * cast(9000000000003 as decimal(38, 0)) as decimal(38, 0)) as bigint) as s").first().s
    assert a == 1000 * 9000000000000 * 9000000000000000 // (9000000000001 * 9000000000003)


def test_a_stack_over_batches_and_ranges():
    r = random.Random(5)
    keys = sorted((b"\x00".join([b"en", *(r.choice([b"a", b"b", b"ab", b"c" * 70, b"c" * 70 + b"d"]) for _ in range(r.randrange(1, 5)))]) for _ in range(400)), reverse=True)
    want = Counter(k[:m] for k in keys for m in [i for i in range(len(k)) if k[i] == 0][1:] + [len(k)])
    for cuts in ([], [1, 2, 3, 150], [0, 399]):
        stack, at, got = collocation.Stack(5, 7), 0, Counter()
        for i in range(0, 400):
            if i in cuts and i:
                stack.finish()
            if i % 37 == 0 or i + 1 in (*cuts, 400) or i in cuts:
                stack.push(pa.array(keys[at : i + 1], pa.binary()), np.ones(i + 1 - at, np.int64)) if i + 1 > at else None
                at = i + 1
        stack.finish()
        for key, n in stack.take():
            got[key] += n
        assert {k: n for k, n in got.items() if n >= 7} == {k: n for k, n in want.items() if n >= 7}


def test_a_suffix_ends_before_a_pair_that_is_too_rare(spark, docs_of):
    r = random.Random(3)
    rows = [(i, " ".join([*r.sample([f"w{k}" for k in range(60)], 60), "new", "york", "city"]) + ".", "en") for i in range(40)]
    texts = docs_of(rows).selectExpr("cast(text as binary) text", "lang")
    words = [(f"w{k}",) for k in range(60)] + [("new",), ("york",), ("city",)]
    held = spark.sparkContext.broadcast(collocation.bitmap_of(spark.createDataFrame(words, "word string").selectExpr("'en' lang", "word")))
    pairs, many = collocation.pairs_of(texts, held, 1 << 24, 40)
    assert many == 80
    sc = spark.sparkContext
    got = texts.mapInArrow(collocation._emitted(held, sc.broadcast(pairs), sc.broadcast([]), 5), "part int, key binary, n long").groupBy("key").sum("n").collect()
    assert {(bytes(x[0]), x[1]) for x in got} == {(b"en\x00new\x00york\x00city", 40), (b"en\x00york\x00city", 40)}
