"""Tokens, document text, abstracts from inverted indexes, and BM25."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B, FLOOR = 1.5, 0.75, 0.25


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def query_tokens(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def document_text(title: Column, abstract: Column) -> Column:
    return F.trim(F.concat_ws(" ", title, F.coalesce(abstract, F.lit(""))))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value made once a row: within lambdas Spark would make it for each use anew."""
    return F.element_at(F.transform(F.array(value), then), 1)


def inverted_index(words: Column) -> Column:
    """Each different word of a list and the places where it stands, from 0; null of null."""

    def runs(ordered: Column) -> Column:
        first = F.zip_with(ordered, F.concat(F.array(F.lit(None).cast("struct<w:string,at:int>")), F.slice(ordered, F.lit(1), F.size(ordered) - 1)), lambda x, y: y.isNull() | (x["w"] != y["w"]))
        starts = F.array_compact(F.transform(first, lambda new, i: F.when(new, i + 1)))
        return _let(starts, lambda a: F.map_from_arrays(F.transform(a, lambda i: F.get(ordered, i - 1)["w"]), F.zip_with(a, F.concat(F.slice(a, F.lit(2), F.size(a)), F.array(F.size(ordered) + 1)), lambda i, j: F.transform(F.slice(ordered, i, j - i), lambda x: x["at"]))))

    return F.when(words.isNotNull(), _let(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("at")))), lambda o: F.when(F.size(o) > 0, runs(o)).otherwise(F.create_map().cast("map<string,array<int>>"))))


def abstract_from_index(index: Column) -> Column:
    """Words put at their positions; gaps keep their blanks, and of words at one position the later entry stays."""
    entry = F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))))
    sorted_ = F.sort_array(F.transform(F.flatten(entry), lambda x, i: F.struct(x["p"].alias("p"), i.alias("i"), x["w"].alias("w"))))
    # Neighbours meet by zipping a list with itself, one further.
    lasts = lambda placed: F.array_compact(F.zip_with(placed, F.slice(placed, F.lit(2), F.size(placed)), lambda x, y: F.when(y.isNull() | (y["p"] != x["p"]), x)))
    before = lambda last: F.concat(F.array(F.lit(None).cast("struct<p:int,i:int,w:string>")), last)
    spaced = lambda last: F.zip_with(last, before(last), lambda x, y: F.concat(F.repeat(F.lit(" "), x["p"] - F.coalesce(y["p"], F.lit(0))), x["w"]))
    return F.coalesce(F.trim(F.array_join(_let(_let(sorted_, lasts), spaced), "")), F.lit(""))


def abstract(plain: Column, index: Column) -> Column:
    return F.coalesce(F.when(plain != "", plain), abstract_from_index(index))


@dataclass(frozen=True)
class Bm25:
    """A query with the corpus statistics it needs; ``score`` is a plain projection over token arrays."""

    terms: list[str]  # with repeats
    idf: dict[str, float]
    mean_size: float

    def score(self, doc: Column) -> Column:
        total = F.lit(0.0)
        length = K1 * (1 - B + B * F.size(doc) / F.lit(self.mean_size or 1.0))
        for t in dict.fromkeys(self.terms):
            if t in self.idf:
                f = F.size(F.filter(doc, lambda x: x == F.lit(t)))  # noqa: B023  the lambda is run at once
                total = total + F.lit(self.idf[t] * self.terms.count(t)) * f * (K1 + 1) / (f + length)
        return total


def bm25(corpus: DataFrame, doc: str, query: str) -> Bm25:
    """Statistics of ``corpus`` (token arrays in column ``doc``) for ``query``.

    The inverse document frequency is ln(N-n+0.5)-ln(n+0.5); where negative,
    a quarter of its mean over the whole vocabulary. One pass counts documents,
    sizes and the documents of each query term, without a shuffle of words; the
    vocabulary is only counted where a term stands in more than half of all.
    What reaches the driver is a row of sums.
    """
    terms = query_tokens(query)
    asked = list(dict.fromkeys(terms))
    n, mean, *held = corpus.agg(F.count(F.lit(1)), F.avg(F.size(doc)), *(F.count_if(F.array_contains(doc, t)) for t in asked)).first()
    idf = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in zip(asked, held) if k}
    if any(x < 0 for x in idf.values()):
        df = corpus.select(F.explode(F.array_distinct(doc)).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
        average = df.agg(F.avg(F.log(n - F.col("n") + 0.5) - F.log(F.col("n") + 0.5))).first()[0]
        idf = {t: x if x >= 0 else FLOOR * average for t, x in idf.items()}
    return Bm25(terms, idf, float(mean or 0))
