"""Licence recognition by sentence rules.

Texts fall into sentences, each is normalised (A-Z lowered, runs of other
characters than a-z and 0-9 become one blank) and looked up among known licence
sentences. A line break ends a sentence, but lines up to a stop or a blank line
are also looked up joined, as wrapped texts have them; comment marks are other
characters and fall away. What is left of a document is the sequence of their identifiers, and
a licence is found where one of its rules, an ordered list of identifiers,
stands in that sequence without a gap.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: What notices call a licence, behind "licensed under", as ``plain`` leaves it.
NAMES = {
    "MIT": ("mit", "mit expat", "expat", "mit x11"),
    "Apache-2.0": ("apache 2 0", "apache 2", "apache license 2 0", "apache license 2", "apache software license 2 0"),
    "GPL-2.0": ("gpl 2", "gpl 2 0", "gnu gpl 2", "gnu general public license 2", "gnu general public license 2 0"),
    "GPL-3.0": ("gpl 3", "gpl 3 0", "gnu gpl 3", "gnu general public license 3", "gnu general public license 3 0"),
    "LGPL-2.1": ("lgpl 2 1", "gnu lgpl 2 1", "gnu lesser general public license 2 1"),
    "LGPL-3.0": ("lgpl 3", "lgpl 3 0", "gnu lgpl 3", "gnu lesser general public license 3", "gnu lesser general public license 3 0"),
    "AGPL-3.0": ("agpl 3", "agpl 3 0", "gnu agpl 3", "gnu affero general public license 3", "gnu affero general public license 3 0"),
    "MPL-2.0": ("mpl 2 0", "mozilla public license 2 0"),
    "EPL-2.0": ("epl 2 0", "eclipse public license 2 0"),
    "BSL-1.0": ("boost software license 1 0", "boost software 1 0"),
    "BSD-2-Clause": ("bsd 2 clause", "2 clause bsd", "simplified bsd"),
    "BSD-3-Clause": ("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd"),
    "ISC": ("isc",),
    "Zlib": ("zlib", "zlib libpng"),
    "PostgreSQL": ("postgresql",),
    "Unlicense": ("unlicense",),
    "CC0-1.0": ("cc0", "cc0 1 0", "creative commons zero 1 0 universal"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international"),
}
#: A tag names a licence by its identifier; these may go on.
TAG, FAMILIES = "spdx license identifier {}", ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
#: Sentences of whole licence texts and headers, as their publishers word them.
TEXTS = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mit-as-is": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-no-event": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-as-is": "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "isc-no-event": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-licensed": "Licensed under the Apache License, Version 2.0 (the License)",
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "gpl-free": "This program is free software",
    "gpl-terms-3": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-terms-2": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-version-2": "either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-fitness": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program",
    "lgpl-terms-3": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-terms-3": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "lgpl-terms-2": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl-version-2.1": "either version 2.1 of the License, or (at your option) any later version",
    "lgpl-terms-2.1": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib-origin": "The origin of this software must not be misrepresented",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    "zlib-notice": "This notice may not be removed or altered from any source distribution",
    "postgresql-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "unlicense-domain": "This is free and unencumbered software released into the public domain",
}
#: Ordered rules over the sentences above; every short notice is a rule of its own.
RULES = (
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-comply", "apache-obtain", "apache-as-is")),
    ("GPL-3.0", ("gpl-free", "gpl-terms-3")),
    ("GPL-2.0", ("gpl-free", "gpl-terms-2", "gpl-version-2")),
    ("LGPL-3.0", ("gpl-free", "lgpl-terms-3")),
    ("LGPL-2.1", ("gpl-free", "lgpl-terms-2", "lgpl-version-2.1")),
    ("LGPL-2.1", ("gpl-free", "lgpl-terms-2.1")),
    ("Zlib", ("zlib-grant",)),
    ("PostgreSQL", ("postgresql-grant",)),
    ("BSL-1.0", ("boost-grant",)),
    ("AGPL-3.0", ("gpl-free", "agpl-terms-3")),
    ("MPL-2.0", ("mpl-subject",)),
    ("Unlicense", ("unlicense-domain",)),
)

STOP = re.compile(rb"([.;:!?][ \t-\r]+|\n)")
#: Taken out of the lower-cased text first, each in all places: comment marks that would be read as stops, the stop of what a holder is called, and the colon behind a tag.
BEFORE = ((r"(?m)^[ \t]*[;!]+[ \t]+", ""), (r"\b(inc|ltd|corp|llc|co)\.[ \t]+", r"\1 "), (r"(spdx-license-identifier|license|licence):[ \t]*", r"\1 "))
OTHER = re.compile(rb"[^a-z0-9]+")
#: How a normalised sentence that is not known as it is becomes a template's: list marks go, any holder and any subject count, a heading and a notice say the same, versions and families are written in one way.
PLAIN = (
    ("^(?:[0-9]{1,2}|[a-z]|ii|iii|iv) ((?:redistributions|neither|the names?|altered|the origin|this notice) .*)$", r"\1"),
    ("^(?:neither the names? of .{1,200} nor (?:the )?names? of .{1,100}|the names? of .{1,200}) (?:may|must) (?:not )?be used to endorse or promote products derived from this software.*$", "{endorse}"),
    ("^.{1,60} is free software$", "this program is free software"),
    (" (?:version|v) ?([0-9])", r" \1"),
    ("gplv([0-9])", r"gpl \1"),
    (" or (?:any )?later", " later"),
    (" (?:[0-9]{1,2} )?(?:january|february|june|july|november) [0-9]{4}$", ""),
    (r"^.{0,200}\b(?:licensed|released|distributed|available|published|provided) under (?:a |the )?(?:terms of )?(?:a |the )?(.*)$", r"licensed under \1"),
    ("^(?:license|licence) (.*)$", r"licensed under \1"),
    ("^(?:the )?((?:gnu|apache|mozilla|eclipse|boost|creative) .{1,80})$", r"licensed under \1"),
    ("^(?:the )?(.{1,40}) (?:license|licence)$", r"licensed under \1"),
    ("^licensed under licensed under (.*)$", r"licensed under \1"),
    ("^(licensed under .*?)(?: (?:see|which|as published|a copy|for details|only|later) ?.*)?$", r"\1"),
    ("^(licensed under .*) (?:license|licence)$", r"\1"),
)
#: Without one of these no template makes a sentence a known one.
CUE = re.compile("^(?:[0-9]{1,2}|[a-z]|ii|iii|iv) |endorse|free software|under |licen|^(?:the )?(?:gnu|apache|mozilla|eclipse|boost|creative) ")
#: Letters that a holder adds to a sentence, at most.
GAP = 300
#: What parts an expression of identifiers.
EXPRESSION = re.compile(" (?:or|and|with) ")


def normalise(sentence: bytes) -> str:
    return OTHER.sub(b" ", sentence.lower()).strip().decode()


def _plain() -> list[tuple[str, str]]:
    return [(p, to.replace("{endorse}", normalise(TEXTS["bsd-endorse"].encode()))) for p, to in PLAIN]


def _notices() -> list[tuple[str, str]]:
    """(licence, sentence) of all that name a licence: notices and tags."""
    named = [(licence, f"licensed under {name}") for licence, names in NAMES.items() for name in names]
    tag = lambda licence: TAG.format(normalise(licence.encode()))
    return named + [(licence, tag(licence) + more) for licence in NAMES for more in (("", " only", " later") if licence in FAMILIES else ("",))]


def sentence_table() -> dict[str, int]:
    """Identifier of each known normalised sentence."""
    ids = {normalise(v.encode()): n for n, v in enumerate(TEXTS.values(), 1)}
    for _, sentence in _notices():
        ids.setdefault(sentence, len(ids) + 1)
    return ids


def rule_table() -> list[tuple[str, tuple[int, ...]]]:
    """(licence, identifiers) of every rule, whole texts first."""
    ids = sentence_table()
    named = {k: ids[normalise(v.encode())] for k, v in TEXTS.items()}
    rules = [(licence, tuple(named[k] for k in keys)) for licence, keys in RULES]
    return rules + [(licence, (ids[sentence],)) for licence, sentence in _notices()]


class Recogniser:
    def __init__(self):
        self.ids = sentence_table()
        self.first: dict[int, list[tuple[str, tuple[int, ...]]]] = {}
        for licence, rule in rule_table():
            self.first.setdefault(rule[0], []).append((licence, rule))
        self.longest = max(map(len, self.ids)) + GAP
        self.plain = [(re.compile(p), to) for p, to in _plain()]
        self.before = [(re.compile(p.encode()), to.encode()) for p, to in BEFORE]
        words = {s.split(" ", 1)[0].encode() for s in self.ids} | {b"license", b"licence", b"neither", b"gnu", b"apache", b"mozilla", b"eclipse", b"boost", b"creative"}
        #: A sentence begins so, behind a list mark, or holds one of the words that templates are told by, so that most sentences are never normalised.
        self.starts = re.compile(rb"[^a-z0-9]*(?:(?:[0-9]{1,2}|[a-z]|ii|iii|iv)[^a-z0-9]+)?(?:%s)(?![a-z0-9])|(?:.*[^a-z0-9])?under(?![a-z0-9])|.*(?:free[^a-z0-9]+software|licen[sc]e[^a-z0-9]*$)" % b"|".join(sorted(words)))
        self.tag = TAG.format("")

    def known(self, sentence: str) -> list[int]:
        """Identifiers that a normalised sentence stands for: one, or those of a tag's expression."""
        if k := self.ids.get(sentence):
            return [k]
        if len(sentence) > self.longest or not CUE.search(sentence):
            return []
        for p, to in self.plain:
            sentence = p.sub(to, sentence)
        if sentence.startswith(self.tag):
            return [k for part in EXPRESSION.split(sentence[len(self.tag) :]) if (k := self.ids.get(self.tag + part))]
        k = self.ids.get(sentence)
        return [k] if k else []

    def sequence(self, text: bytes) -> list[int]:
        """Identifiers in order; of the known sentences that begin at one line, the one over most lines."""
        text = text.lower()
        for p, to in self.before:
            text = p.sub(to, text)
        parts = STOP.split(text)
        out, upto = [], 0
        for i in range(0, len(parts), 2):
            if i >= upto and self.starts.match(parts[i]):
                j, joined, found = i, normalise(parts[i]), None
                while joined:
                    if k := self.known(joined):
                        found, upto = k, j + 2
                    if j + 2 >= len(parts) or parts[j + 1] != b"\n" or len(joined) > self.longest:
                        break
                    j += 2
                    if not (line := normalise(parts[j])):
                        break
                    joined += " " + line
                if found:
                    out += found
        return out

    def licences(self, seq: list[int]) -> list[str]:
        """Names by the rules that fit; where several begin at one sentence, the longest."""
        found = set()
        for i, k in enumerate(seq):
            fits = [(len(rule), name) for name, rule in self.first.get(k, ()) if tuple(seq[i : i + len(rule)]) == rule]
            found |= {name for n, name in fits if n == max(fits)[0]}
        return sorted(found)


def scan(docs: DataFrame) -> DataFrame:
    """Licences in every whole text of ``docs(doc_id, text)``.

    Returns ``doc_id, n_sentences`` (int, known licence sentences), ``sentence_ids``
    (their identifiers in order, with commas) and ``licences`` (found names, sorted,
    with commas), a row per row; a null or empty text and one without a known
    sentence has 0 and empty strings. Repeated rows are scanned each; other
    columns are ignored.
    """

    def run(batches):
        know = Recogniser()
        for b in sliced(batches):
            seqs = [know.sequence(t) if t else [] for t in b.column(0).to_pylist()]
            cols = [b.column(1), pa.array([len(s) for s in seqs], pa.int32()), pa.array([",".join(map(str, s)) for s in seqs]), pa.array([",".join(know.licences(s)) for s in seqs])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_sentences", "sentence_ids", "licences"])

    return docs.select(F.col("text").cast("binary").alias("text"), "doc_id").mapInArrow(run, "doc_id long, n_sentences int, sentence_ids string, licences string")


def _replaced(text: str, steps) -> str:
    """DuckDB text that replaces step by step."""
    for p, to in steps:
        text = f"regexp_replace({text}, '{p}', '{to}', 'g')"
    return text


def sql() -> str:
    known = ", ".join(f"({k}, '{s}')" for s, k in sentence_table().items())
    told = lambda ids: f",{','.join(map(str, ids))}," if ids else ""
    longer = lambda ids: next((r for _, r in rule_table() if len(r) > len(ids) and r[: len(ids)] == ids), ())
    rules = ", ".join(f"('{name}', '{told(rule)}', '{told(longer(rule))}')" for name, rule in rule_table())
    longest, tag = max(map(len, sentence_table())) + GAP, TAG.format("")
    return rf"""
WITH known(id, sentence) AS (VALUES {known}), rules(licence, rule, longer) AS (VALUES {rules}),
lowered AS (
  SELECT doc_id, {_replaced("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", BEFORE)} AS t FROM documents
), stops AS (
  SELECT doc_id, unnest(string_split(regexp_replace(t, '[.;:!?][ \t-\r]+', chr(2), 'g'), chr(2))) AS s,
         generate_subscripts(string_split(regexp_replace(t, '[.;:!?][ \t-\r]+', chr(2), 'g'), chr(2)), 1) AS a FROM lowered
), lines AS (
  SELECT doc_id, a, unnest(string_split(s, chr(10))) AS line, generate_subscripts(string_split(s, chr(10)), 1) AS b FROM stops
), n AS (
  SELECT doc_id, a, b, trim(regexp_replace(line, '[^a-z0-9]+', ' ', 'g')) AS norm FROM lines
), parted AS (
  SELECT *, count(*) FILTER (WHERE norm = '') OVER (PARTITION BY doc_id, a ORDER BY b) AS g FROM n
), joined AS (
  SELECT doc_id, a, g, list(norm ORDER BY b) AS ns FROM parted WHERE norm <> '' GROUP BY doc_id, a, g
), begun AS (
  SELECT doc_id, a, g, ns, unnest(range(1, len(ns) + 1)) AS i FROM joined
), tried AS (
  SELECT doc_id, a, g, i, unnest(range(i, least(len(ns), i + 300) + 1)) AS j, ns FROM begun
  WHERE regexp_matches(ns[i], '^(?:(?:[0-9]{{1,2}}|[a-z]|ii|iii|iv) )?(?:license|licence|neither|gnu|apache|mozilla|eclipse|boost|creative|{"|".join(sorted({x.split(" ")[0] for x in sentence_table()}))})\b|free software|(?:^| )under\b|licen[sc]e$')
), spoken AS (
  SELECT doc_id, a, g, i, j, sentence, {_replaced("sentence", _plain())} AS plain FROM (SELECT *, array_to_string(ns[i:j], ' ') AS sentence FROM tried) WHERE length(sentence) <= {longest}
), parts AS (
  SELECT doc_id, a, g, i, j, 0 AS k, sentence AS part FROM spoken WHERE sentence IN (SELECT sentence FROM known)
  UNION ALL SELECT doc_id, a, g, i, j, 0, plain FROM spoken WHERE sentence NOT IN (SELECT sentence FROM known) AND NOT starts_with(plain, '{tag}')
  UNION ALL SELECT doc_id, a, g, i, j, unnest(range(len(e))), '{tag}' || unnest(e) FROM (SELECT *, regexp_split_to_array(substr(plain, {len(tag) + 1}), ' (?:or|and|with) ') AS e FROM spoken WHERE sentence NOT IN (SELECT sentence FROM known) AND starts_with(plain, '{tag}'))
), met AS (
  SELECT doc_id, a, g, i, j, list(id ORDER BY k) AS ids FROM parts JOIN known ON sentence = part GROUP BY doc_id, a, g, i, j QUALIFY row_number() OVER (PARTITION BY doc_id, a, g, i ORDER BY j DESC) = 1
), walked AS (
  SELECT doc_id, a, g, list_sort(list([i, j])) AS spans FROM met GROUP BY doc_id, a, g
), told AS (
  SELECT m.* FROM met m JOIN (SELECT doc_id, a, g, unnest(list_filter(list_transform(range(1, len(spans) + 1), lambda x: CASE WHEN list_reduce(list_prepend(0::bigint, list_transform(spans[1:x - 1], lambda y: y[1] * 1000000 + y[2])), lambda e, y: CASE WHEN y // 1000000 > e THEN y % 1000000 ELSE e END) < spans[x][1] THEN spans[x][1] END), lambda x: x IS NOT NULL)) AS i FROM walked) w
  ON m.doc_id = w.doc_id AND m.a = w.a AND m.g = w.g AND m.i = w.i
), seq AS (
  SELECT doc_id, sum(len(ids)) AS n, string_agg(array_to_string(ids, ','), ',' ORDER BY a, g, i) AS ids FROM told GROUP BY doc_id
), found AS (
  SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM seq JOIN rules ON contains(CASE WHEN longer = '' THEN ',' || ids || ',' ELSE replace(',' || ids || ',', longer, ',') END, rule) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licences, '') AS licences
FROM documents d LEFT JOIN seq USING (doc_id) LEFT JOIN found USING (doc_id)
"""
