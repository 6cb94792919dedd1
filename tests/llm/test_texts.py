"""Packing, licences, classifiers and decontamination."""

import random
import tracemalloc

import duckdb
import numpy as np
import pytest

from strandline.llm import decontaminate, language, licenses, packing, quality
from strandline.llm.bigru import BiGRU
from strandline.llm.boosting import Boosted

LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def plain_pack(lengths, sizes, cost):
    """Best-fit decreasing, a piece at a time; a length that needs new bins opens as many of one size as it fills."""
    rate = min(cost(s) / s for s in sizes)
    bins, left = [], sum(lengths)
    pending = []  # opened and not yet used
    todo = sorted(lengths, reverse=True)
    for k, n in enumerate(todo):
        more = sum(1 for x in todo[k:] if x == n)
        fits = [b for b in bins if b[0] - b[1] >= n and b[1]]
        if fits:
            b = min(fits, key=lambda b: b[0] - b[1])
        else:
            if not pending or pending[0][2] != n:
                size = min((s for s in sizes if s >= n), key=lambda s: (cost(s) - rate * min(s - n, left - n), s))
                pending = [[size, 0, n] for _ in range(max(1, more // (size // n)))]
                bins += pending
            b = pending.pop(0)
        b[1] += n
        left -= n
    return sorted((min(s for s in sizes if s >= used), used) for _, used, _ in bins if used)


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_plain_best_fit(seed):
    r = random.Random(seed)
    sizes = (16, 32, 64)
    cost = lambda s: 4 + s + s * s / 200
    lengths = [min(64, int(r.lognormvariate(2.3, 0.9)) + 1) for _ in range(r.choice([1, 40, 300]))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan, final = packing.Packer(sizes, cost).pack(histogram)
    got = sorted((min(s for s in sizes if s >= used), int(used)) for _, n, used in final for _ in range(n))
    assert got == plain_pack(lengths, sizes, cost)


def test_pieces_lie_side_by_side(docs_of):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 30, 63, 64, 65, 200]))) for i in range(150)] + [(7, None), (None, "a b"), (8, "a b"), (8, "a b")]
    got = packing.pack(docs_of(rows), (16, 32, 64), lambda s: 4 + s).toPandas()
    want = sorted(len((t or "").split()) + 1 for _, t in rows)
    assert sorted(got.groupby([got.doc_id.fillna(-1)]).length.sum())[-3:] and got.length.sum() == sum(want)
    for _, b in got.sort_values("bin_offset").groupby("bin_id"):
        assert b.bin_offset.tolist() == [0, *np.cumsum(b.length)[:-1]] and b.bin_size.nunique() == 1
        used = b.length.sum()
        assert used <= b.bin_size.iloc[0] and all(s < used for s in (16, 32, 64) if s < b.bin_size.iloc[0])
    assert packing.pack(docs_of(rows).where("false")).count() == 0


def test_licences(docs_of):
    whole = "\n".join(licenses.TEXTS[k] + "." for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    three = whole + "\n" + licenses.TEXTS["bsd-endorse"] + "."
    mit = licenses.TEXTS["mit-grant"] + ":\n\n" + licenses.TEXTS["mit-notice"] + "."
    rows = [(1, "Text. Released under the MIT License. More."), (2, whole), (3, three), (4, mit.upper()), (5, licenses.TEXTS["mit-notice"]), (6, "no licence mentioned"), (7, None), (8, ""), (9, "licensed under cc BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.")]
    got = {r.doc_id: (r.n_sentences, r.licences) for r in licenses.scan(docs_of(rows)).collect()}
    assert got == {1: (1, "MIT"), 2: (3, "BSD-2-Clause"), 3: (4, "BSD-3-Clause"), 4: (2, "MIT"), 5: (1, ""), 6: (0, ""), 7: (0, ""), 8: (0, ""), 9: (2, "Apache-2.0,CC-BY-NC-4.0")}
    documents = docs_of(rows).toPandas()  # noqa: F841  read by name
    assert {r[0]: (r[1], r[3]) for r in duckdb.sql(licenses.sql()).fetchall()} == got
    assert licenses.scan(docs_of(rows).where("false")).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
ISC = """Copyright (c) 2020, Someone
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
ENDORSE = """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
GPL2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version."""
WRAPPED = [(APACHE, "Apache-2.0"), (MIT, "MIT"), (ISC, "ISC"), (BSD, "BSD-2-Clause"), (BSD + ENDORSE, "BSD-3-Clause"), (GPL3, "GPL-3.0"), (GPL2, "GPL-2.0")]


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * ", "; ", "! ", ";; "])
def test_wrapped_licences(mark):
    know = licenses.Recogniser()
    for text, name in WRAPPED:
        for end in ("\n", "\r\n"):
            assert know.licences(know.sequence(end.join((mark + x) for x in text.split("\n")).encode())) == [name]


DISCLAIMED = """

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
NOTICES = [("SPDX-License-Identifier: MIT", "MIT"), ("SPDX-License-Identifier:Apache-2.0", "Apache-2.0"), ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("This code is licensed under the MIT license.", "MIT"), ("This library is free software: you can redistribute it and/or modify\nit under the terms of the GNU Lesser General Public License as published\nby the Free Software Foundation, either version 3 of the License, or (at\nyour option) any later version.", "LGPL-3.0")]


NAMED = BSD + """

3. Neither the name of the Example University, Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
LGPL21 = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
#: What round 2 named wrongly or not at all.
MISSED = [
    (NAMED, "BSD-3-Clause"), (NAMED.replace("1. R", "(1) R").replace("2. R", "(2) R").replace("3. N", "(3) N"), "BSD-3-Clause"), (BSD.replace("1. R", "a) R").replace("2. R", "b) R"), "BSD-2-Clause"),
    (BSD + "\n3. The name of the author may not be used to endorse or promote products\n   derived from this software without specific prior written permission.", "BSD-3-Clause"),
    ("MIT License", "MIT"), ("The MIT License", "MIT"), ("License: MIT", "MIT"), ("This code is licensed under GPLv3.", "GPL-3.0"), ("Our widget server is released under the terms of the Apache License, Version 2.0 (see LICENSE).", "Apache-2.0"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT"), ("SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND BSD-3-Clause", "BSD-3-Clause,GPL-2.0"), ("SPDX-License-Identifier: LGPL-2.1-only", "LGPL-2.1"),
    (LGPL21, "LGPL-2.1"), (ZLIB, "Zlib"), ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "GPL-3.0"), ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "EPL-2.0"),
    ("Driving without a license", ""), ("the licence", ""), ("they work under the mit of glass", ""), ("mit", ""), ("Neither the name of the wind nor the names of its storms may be used to promote rain.", ""),
]


def test_what_was_missed_is_named_alike_in_sql(docs_of):
    rows = [(k, f"Some prose.\n\n{t}\n\nmore") for k, (t, _) in enumerate(MISSED)] + [(100 + k, t) for k, (t, _) in enumerate(MISSED)]
    found = licenses.scan(docs_of(rows)).collect()
    assert {r.doc_id: r.licences for r in found} == {k + more: name for k, (_, name) in enumerate(MISSED) for more in (0, 100)}
    documents = docs_of(rows).toPandas()  # noqa: F841  read by name
    assert {r[0]: r[1:] for r in duckdb.sql(licenses.sql()).fetchall()} == {r.doc_id: (r.n_sentences, r.sentence_ids, r.licences) for r in found}


def test_wrapped_and_tagged_licences_in_documents_and_sql(docs_of):
    """Whole files with marks, repeated rows, very long texts, and what is none; alike in SQL."""
    texts = [(t, n) for t, n in [*WRAPPED, *NOTICES, (MIT + DISCLAIMED, "MIT")]]
    rows, want = [], {}
    for k, (mark, end) in enumerate([("", "\n"), ("# ", "\n"), ("// ", "\r\n"), (" * ", "\n"), ("; ", "\n")]):
        for j, (t, n) in enumerate(texts):
            body = end.join(mark + x for x in t.split("\n"))
            rows.append((100 * k + j, f"Some prose here. More of it.{end}{end}{body}{end}{end}def main(): pass"))
            want[100 * k + j] = n
    rows += [(900, "word and word. " * 200_000 + "\n" + MIT), (901, "SPDX-License-Identifier:\n\nMIT"), (902, "permission is hereby granted"), (0, rows[0][1]), (903, "licensed\nunder\nthe\nmit\nlicense")]
    want |= {900: "MIT", 901: "", 902: "", 903: "MIT"}
    found = licenses.scan(docs_of(rows)).collect()
    assert len(found) == len(rows) and {r.doc_id: r.licences for r in found} == want
    assert next(r for r in found if r.doc_id == len(texts) - 1).n_sentences == 5  # the heading is one
    documents = docs_of([r for r in rows if r[0] not in (0, 900)]).toPandas()  # noqa: F841  read by name
    told = {r[0]: r[1:] for r in duckdb.sql(licenses.sql()).fetchall()}
    assert told == {r.doc_id: (r.n_sentences, r.sentence_ids, r.licences) for r in found if r.doc_id in told} and len(told) == len(rows) - 3


def test_a_blank_line_ends_a_sentence_and_a_line_stands_alone():
    know = licenses.Recogniser()
    told = lambda text: know.licences(know.sequence(text))
    assert told(b"Released under\n\nthe MIT License") == [] and told(b"Released under\nthe MIT License") == ["MIT"]
    assert told(b"Released under the MIT License\nand more text\nReleased under the ISC License") == ["ISC", "MIT"]


def test_gradient_of_the_network():
    net = BiGRU(["a", "b", "c"], hidden=3, seed=1)
    net.p = {k: w.astype(np.float64) for k, w in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 101, (4, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grad = net.gradient(x, y)
    assert set(grad) == set(net.p)
    for k in net.p:
        for at in list(zip(*np.nonzero(np.abs(grad[k]) > 1e-4)))[:6]:
            old = net.p[k][at]
            net.p[k][at] = old + 1e-4
            up = net.gradient(x, y)[0]
            net.p[k][at] = old - 1e-4
            down = net.gradient(x, y)[0]
            net.p[k][at] = old
            assert abs((up - down) / 2e-4 - grad[k][at]) < 1e-4


def plainly_pooled(net, text):
    """A text read byte by byte in both directions, every byte labelled."""
    n, p, told = net.h, net.p, []
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for d, order in ((0, text), (1, text[::-1])):
        h, states = np.zeros(n), []
        for byte in order:
            a, g = p["wx"][d][:, byte] + p["b"][d][:, 0], p["u"][d] @ h
            z, r = sigmoid(a[:n] + g[:n]), sigmoid(a[n : 2 * n] + g[n : 2 * n])
            c = np.tanh(a[2 * n :] + r * g[2 * n :])
            h = z * h + (1 - z) * c
            states.append(h)
        told.append(states if d == 0 else states[::-1])
    total = np.zeros(len(net.classes))
    for f, b in zip(*told):
        e = np.exp(p["v"][0] @ f + p["v"][1] @ b + p["c"][:, 0])
        total += e / e.sum()
    return total


@pytest.mark.parametrize(("lanes", "held"), [(256, 1 << 20), (3, 40), (1, 7), (2, 5000)])
def test_every_byte_of_a_text_is_labelled_with_the_state_carried(lanes, held):
    net = BiGRU(["a", "b", ""], hidden=4, seed=2)
    net.p["b"] += np.random.default_rng(1).normal(0, 1, net.p["b"].shape).astype(np.float32)
    texts = [t.encode() for t in ("ab cd 12, x", "", "a", "Привет, мир 7 日本語", "x" * 100, "mm nn " * 30, "12 34 !")]
    if held > 100:
        texts.append(b" ".join(str(i * 7919).encode() + b" word" for i in range(9000))[:100_000])
    got = net.pooled(texts, lanes, held)
    assert got.shape == (len(texts), 3) and np.allclose(got.sum(1), [len(t) for t in texts], rtol=1e-4)
    assert np.allclose(got, [plainly_pooled(net, t) for t in texts], rtol=2e-3, atol=1e-3)
    assert not len(net.pooled([])) and not net.pooled([b"", b""]).any()


def syllables(r, of, n):
    return " ".join("".join(r.choice(of) for _ in range(3)) for _ in range(n))


KA, SCH = ("ka", "ro", "mi"), ("sch", "ein", "ü")


def test_languages_are_told_apart_and_odd_texts_are_und(docs_of):
    r = random.Random(0)
    rows = [(i, syllables(r, KA if i % 2 else SCH, 30), "x" if i % 2 else "y") for i in range(120)]
    odd = [(200, None), (201, ""), (202, "12 34 €€ ?"), (None, "karomi"), (5, rows[5][1], "x")]
    got = language.identify(docs_of(rows + odd)).collect()
    assert len(got) == 125 and all(0 <= x.score <= 1 for x in got)
    told = [x for x in got if x.held_out and x.doc_id < 120]
    assert told and all(x.lang_pred == ("x" if x.doc_id % 2 else "y") for x in told)
    assert {x.lang_pred for x in got if x.doc_id in (200, 201, 202)} == {"und"}
    assert {x.lang_pred for x in language.identify(docs_of([(1, "text")])).collect()} == {"und"}
    assert language.identify(docs_of(rows).where("false")).count() == 0


def test_what_is_no_language_is_rejected_and_the_rest_stays(docs_of):
    r = random.Random(3)
    rows = [(i, syllables(r, KA if i % 2 else SCH, 60), "x" if i % 2 else "y") for i in range(120)]
    junk = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789+/=") for _ in range(2000))
    foreign = "Широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства. " * 20
    odd = [(300, junk), (301, foreign), (302, None), (303, "12 34"), (304, "q"), (None, rows[3][1]), (305, rows[7][1]), (3, rows[3][1], "x")]
    kept = language.determined(docs_of(rows + odd))
    got = {(x.doc_id, x.lang) for x in kept.collect()}
    assert kept.columns == docs_of(rows).columns and kept.count() == 124
    assert {i for i, _ in got} == set(range(120)) | {304, None, 305} and (305, "x") in got  # a null lang is filled in
    unlabelled = docs_of([(i, t) for i, t, _ in rows] + odd)
    assert language.determined(unlabelled.withColumn("lang", language.F.lit(None).cast("string"))).count() == 128  # nothing learnt, nothing rejected
    assert language.determined(docs_of(rows).where("false")).count() == 0


def test_a_language_of_long_texts_only_is_learnt(docs_of):
    r = random.Random(2)
    rows = [(i, syllables(r, SCH, 40), "x") for i in range(60)] + [(100 + i, syllables(r, KA, 9000), "y") for i in range(12)]
    got = language.identify(docs_of(rows + [(200, syllables(r, KA, 40))])).collect()
    assert all(x.lang_pred == ("x" if x.doc_id < 100 else "y") for x in got)


def test_the_sample_is_of_different_texts_and_of_every_language(docs_of):
    r = random.Random(4)
    rows = [(i, "the same text", "a") for i in range(500)] + [(1000 + i, syllables(r, KA, 5), "a") for i in range(80)] + [(2000 + i, f"t{i}", f"l{i}") for i in range(600)]
    got = language.sampled(docs_of(rows + [(1, "", "a"), (2, None, "a"), (3, "no label")]), 50).collect()
    assert len(got) == len({(x.text, x.lang) for x in got}) == 650 and sum(x.lang == "a" for x in got) == 50


@pytest.mark.parametrize("n", [1, 15, 16, 17, 500])
def test_windows_are_of_one_length(n):
    text = bytes(range(65, 65 + 26))[:n] * (1 + n // 26)
    for length in language.LENGTHS:
        got = language.windows_of(text[:n], length)
        assert len(got) == language.WINDOWS and {len(w) for w in got} == {length}


def test_fit_takes_the_best_split_there_is():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = ((x[:, 1] > 6) | (x[:, 2] < 3)).astype(float)
    m = Boosted(trees=1, depth=2, bins=48).fit(x, y)
    p = np.full(300, y.mean())
    g, h = p - y, p * (1 - p)

    def best(rows):
        gain = lambda k: g[k].sum() ** 2 / (h[k].sum() + m.l2)
        found = []
        for j in range(3):
            for v in np.unique(x[rows, j]):
                left, right = rows & (x[:, j] <= v), rows & (x[:, j] > v)
                if h[left].sum() >= m.least and h[right].sum() >= m.least:
                    found.append((gain(left) + gain(right) - gain(rows), -j, -v))
        return max(found, default=(0, 0, 0))

    walk, whole = {0: np.ones(300, bool)}, []
    for node in range(3):
        rows = walk[node]
        j, v = m.column[0, node], m.upto[0, node]
        got = rows & (x[:, j] <= v), rows & (x[:, j] > v)
        top = best(rows)[0]
        if np.isfinite(v):
            gain = lambda k: g[k].sum() ** 2 / (h[k].sum() + m.l2)
            assert abs(gain(got[0]) + gain(got[1]) - gain(rows) - top) < 1e-9
        else:
            assert top < 1e-6
        walk[2 * node + 1], walk[2 * node + 2] = got
        whole += got if node else ()
    for leaf, rows in enumerate(whole):
        assert abs(m.adds[0, leaf] + m.rate * g[rows].sum() / (h[rows].sum() + m.l2)) < 1e-9


def test_trees_fit_and_flat_walk_is_the_plain_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = Boosted(trees=30).fit(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) >= 0.5) == (y[2000:] == 1)).mean() > 0.95

    def plain(row):
        raw = m.start
        for c, u, a in zip(m.column, m.upto, m.adds):
            node = 0
            while node < len(c):
                node = 2 * node + 1 + int(row[c[node]] > u[node])
            raw += a[node - len(c)]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose(m.score(x[:50]), [plain(r) for r in x[:50]])


def test_quality(spark, docs_of, prose):
    rows = [(i, prose(i) if i % 2 else "buy$$$ now!!! " * 20) for i in range(300)] + [(900, None), (901, ""), (5, prose(5)), (None, "x")]
    labels = spark.createDataFrame([(i, i % 2, 9) for i in range(250)] + [(3, None, 0), (None, 1, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs_of(rows), labels).collect()
    assert len(got) == 304 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.held_out and r.doc_id < 300)
    assert {r.score for r in quality.classify(docs_of(rows), labels.where("false")).collect()} == {0.5}
    long = [(1001, prose(7, 40_000)), (1002, "buy$$$ now!!! " * 300_000), (1003, None)]
    scores = {r.doc_id: r.score for r in quality.classify(docs_of(rows + long), labels).collect() if r.doc_id and r.doc_id > 1000}
    assert scores[1001] > 0.3 > scores[1002] and 0 <= scores[1003] <= 1
    assert quality.classify(docs_of(rows).where("false"), labels).count() == 0


def items_of(prose, n=40):
    return [(i, prose(1000 + i, 3 + i % 4)) for i in range(n)]


def test_wand_finds_all_that_brute_force_finds(prose):
    r = random.Random(5)
    index = decontaminate.Index(items_of(prose) + [(99, ""), (98, None), (97, prose(5, 90)), (96, prose(6, 15))])
    assert [c.stride for c in index.classes] == [64, 256, 1024]
    for c in index.classes:
        for _ in range(60):
            terms = sorted(r.sample(range(len(index.term)), r.randrange(1, 60)))
            gains = r.choice([1.0, 3.0, 9.0])  # what reaches the threshold is rare as it is
            c.gain, c.best, c.block_max = c.gain * gains, c.best * gains, c.block_max * gains
            plain = {}
            for t in terms:
                for k in range(c.cut[t], c.cut[t + 1]):
                    plain[c.item[k]] = plain.get(c.item[k], 0) + c.gain[k]
            assert {d for d, _ in index.wand(c, terms)} == {d for d, x in plain.items() if x >= 1}
            c.gain, c.best, c.block_max = c.gain / gains, c.best / gains, c.block_max / gains


def test_whatever_can_be_verified_is_retrieved(prose):
    """Question whole and half of a long answer; or a fifth of the shingles gone, the rarest words with them."""
    r = random.Random(12)
    items = [(i, prose(1000 + i, 1).replace(".", "?") + " " + " ".join(prose(2000 + i, 5).replace(".", "").split())) for i in range(30)]
    items += [(100 + i, f"Who {i}? " + prose(3000 + i, 6).replace(".", "")) for i in range(30)] + items_of(prose)
    index = decontaminate.Index(items)
    texts, want = [], []
    for _ in range(400):
        i, text = r.choice(items)
        q, a = decontaminate.question_and_answer(text)
        w = q + a
        cut = r.randrange(len(a))
        said = r.choice([q + a[: len(a) - cut], q + a[cut:], w[r.randrange(9) :], w[: len(w) - r.randrange(9)], [x if r.random() > 0.04 else "changed" for x in w]])
        passage = decontaminate.words(prose(r.randrange(99), 3)) + said + decontaminate.words(prose(r.randrange(99), 3))
        seen, share = decontaminate.shingles(passage), lambda p, seen, passage: decontaminate.Index._share(p, seen, passage)
        if share(w, seen, passage) >= 0.8 or (share(q, seen, passage) >= 0.8 and share(a, seen, passage) >= 0.5):
            texts.append(" ".join(passage))
            want.append(i)
    assert len(want) > 150
    for i, got in zip(want, index.search(texts)):
        assert i in {index.ids[d] for d in got}


def test_long_items_do_not_change_how_short_ones_are_found(spark, docs_of, prose):
    short, long = items_of(prose, 8), [(50, prose(70, 300))]
    rows = [(i, prose(i, 30) + " " + t + " " + prose(200 + i, 40)) for i, t in short] + [(20, prose(300, 10) + prose(70, 300)), (21, " ".join(prose(k, 40) for k in range(400, 600)) + short[3][1])]
    docs = docs_of(rows)
    alone, both = (spark.createDataFrame(x, "item_id long, text string") for x in (short, short + long))
    got = [{(r.doc_id, r.item_id): r.word_start for r in decontaminate.contaminated(docs, t).collect()} for t in (alone, both)]
    assert set(got[0]) == {(i, i) for i, _ in short} | {(21, 3)} and got[1].items() - got[0].items() == {((20, 50), 0)} and got[0].items() <= got[1].items()


def test_search_is_exhaustive_search(prose):
    r = random.Random(6)
    items = items_of(prose)
    index = decontaminate.Index(items)
    texts = []
    for _ in range(60):
        parts = [prose(r.randrange(500), r.randrange(1, 30))] + [r.choice(items)[1] for _ in range(r.randrange(3))]
        r.shuffle(parts)
        texts.append(" ".join(parts).upper() if r.random() < 0.3 else " ".join(parts))
    flat = lambda t: f" {' '.join(decontaminate.words(t))} "
    for text, got in zip(texts, index.search(texts)):
        assert {index.ids[d] for d in got} == {i for i, t in items if flat(t) in flat(text)}


def test_contaminated_and_odd_rows(spark, docs_of, prose):
    items = spark.createDataFrame([(1, prose(50, 5)), (2, prose(50, 5)), (3, "Short one here"), (4, ""), (5, None)], "item_id long, text string")
    leak = prose(60, 30) + "\n" + prose(50, 5) + " " + prose(61, 3)
    edited = prose(50, 5).replace(prose(50, 5).split()[12], "changed", 1)
    rows = [(1, leak), (2, prose(62, 40)), (3, None), (4, ""), (5, "And a short one here indeed"), (6, "w " * 20 + edited), (7, leak), (None, leak)]
    got = sorted((r.doc_id or -1, r.item_id) for r in decontaminate.contaminated(docs_of(rows), items).collect())
    assert got == [(-1, 1), (-1, 2), (1, 1), (1, 2), (5, 3), (6, 1), (6, 2), (7, 1), (7, 2)]
    kept = decontaminate.without_leaks(docs_of(rows), items)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 3, 4] and kept.columns == docs_of(rows).columns
    assert decontaminate.contaminated(docs_of(rows), items.where("false")).count() == 0 and decontaminate.contaminated(docs_of(rows).where("false"), items).count() == 0


def test_decontamination_matches_sql(spark, docs_of, prose):
    r = random.Random(8)
    items = [(i, prose(2000 + i, 2 + i % 5)) for i in range(25)] + [(90, "Two words"), (91, "One. Two. three"), (92, "..."), (93, None)]
    texts = []
    for _ in range(50):
        parts = [prose(r.randrange(99), r.randrange(1, 20)) for _ in range(3)] + ([r.choice(items[:27])[1]] if r.random() < 0.7 else [])
        r.shuffle(parts)
        words = " ".join(parts).split(" ")
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = "changed"
        texts.append(r.choice([" ", "\n"]).join(words))
    rows = list(enumerate([*texts, "", None]))
    found = decontaminate.rounded(decontaminate.contaminated(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")))
    documents, benchmark = docs_of(rows).toPandas(), spark.createDataFrame(items, "item_id long, text string").toPandas()  # noqa: F841  read by name
    want = sorted(duckdb.sql(decontaminate.sql()).fetchall())
    assert len(want) > 10 and [tuple(map(float, x)) for x in sorted(map(tuple, found.collect()))] == [tuple(map(float, x)) for x in want]


def test_many_items_are_searched_in_parts(spark, docs_of, prose, monkeypatch):
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 600)
    items = spark.createDataFrame(items_of(prose, 12), "item_id long, text string")
    got = decontaminate.contaminated(docs_of([(1, prose(1000, 3)), (2, prose(1011, 6))]), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 0), (2, 11)]


def test_parts_do_not_change_the_result(spark, docs_of, prose, monkeypatch):
    r = random.Random(9)
    rows = [(i, prose(3000 + i, 2 + i % 9)) for i in range(30)] + [(40, ""), (41, "..."), (42, prose(3001, 3))]
    texts = []
    for _ in range(40):
        words = " ".join([prose(r.randrange(99), 20), r.choice(rows[:30])[1], prose(r.randrange(99), r.randrange(1, 20))]).split(" ")
        for _ in range(r.randrange(6)):
            words[r.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    docs, items = docs_of(list(enumerate(texts))), spark.createDataFrame(rows, "item_id long, text string")
    want = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 900)
    assert len(want) > 10 and sorted(map(tuple, decontaminate.contaminated(docs, items).collect())) == want


def test_a_search_holds_little_whatever_its_windows_meet():
    r = random.Random(4)
    common = [f"w{i}" for i in range(150)]
    items = [(i, " ".join([*r.sample(common, 15), *(f"own{i}x{k}" for k in range(25))])) for i in range(3000)]
    text = " ".join([*r.choices(common, k=4000), items[7][1]])
    index = decontaminate.Index(items)
    tracemalloc.start()
    got = index.search([text])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0].keys() == {7} and most < 25 << 20, most


def test_short_texts_are_read_once_each_way(monkeypatch):
    net, read, scan = BiGRU(["a", "b", ""], hidden=2), [], BiGRU._scan
    monkeypatch.setattr(BiGRU, "_scan", lambda self, xs, *rest: read.append(sum(x.size for x in xs)) or scan(self, xs, *rest))
    r = random.Random(2)
    texts = [bytes(r.choices(b"abcdef ", k=r.randrange(1, 1500))) for _ in range(1500)]
    got = net.pooled(texts)
    assert np.allclose(got.sum(1), list(map(len, texts)), rtol=1e-4) and sum(read) < 2.2 * sum(map(len, texts))
