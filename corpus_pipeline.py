"""The corpus pipeline: language ID, near-duplicates, repeated spans, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; its result is written as Parquet and read again. All but the last return
the columns of ``documents``. Whatever the stage: an empty table gives an empty
one, other columns, of any name and type, come along as they are, and of rows without doc_id or with a
repeated one each docstring says what becomes.
"""

from __future__ import annotations

from strandline.llm import decontaminate, language, packing, simhash, substring
from strandline.llm.common import quoted, scratch, stored, table


def known_language(spark, docs, sf_dir):
    """Documents in a language that was learnt.

    Those without a letter go, and longer ones that are mostly no learnt
    language; a null ``lang`` becomes the one told. Where no row is labelled
    all stay. Rows with a null or repeated doc_id are told each by its text.
    """
    return language.determined(docs)


def first_copies(spark, docs, sf_dir):
    """One document of each near-duplicate group: that with the smallest doc_id, once. Rows without doc_id stay; null and empty texts are copies of each other."""
    return simhash.keep_first(docs)


def without_repeats(spark, docs, sf_dir):
    """Texts without spans that repeat an earlier document's or their own; every row stays. Texts of rows without doc_id, and null ones, stay as they are."""
    return substring.without_repeats(docs).select([quoted(c) for c in docs.columns])


def without_leaks(spark, docs, sf_dir):
    """Documents that hold no benchmark item; all rows of a doc_id go together. Rows without doc_id, and with a null or empty text, stay."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark, docs, sf_dir):
    """Where each piece of each document goes, of every row, null and empty texts among them."""
    return packing.pack(docs)


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", first_copies),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", without_leaks),
    ("best-fit packing", packed),
]

#: Learnt labels, 64-bit word hashes and best-fit have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage wrote on its way goes once its result is written
            docs = keep(stored(stage(spark, docs, sf_dir), name.replace(" ", "-")))
    return STAGES[-1][1](spark, docs, sf_dir)
