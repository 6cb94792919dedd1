"""The queries of this package and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from . import chat, collocation, decontaminate, embedding, language, licenses, mixing, packing, quality, simhash, spelling, substring, warc
from .common import table


def op1_substring(spark, sf_dir):
    return substring.without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_sentences", "n_removed")


def op2_embedding(spark, sf_dir):
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_chat(spark, sf_dir):
    rows = chat.with_probe(spark, table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.format_records(chat.as_records(rows), arranged=True), arranged=True)


def op5_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op8_warc(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages")).drop("record_id")


def op9_decontaminate(spark, sf_dir):
    return decontaminate.rounded(decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op11_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).taken().drop("source")


def op13_collocation(spark, sf_dir):
    return collocation.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring": op1_substring,
    "op2_embedding": op2_embedding,
    "op3_packing": op3_packing,
    "op4_chat": op4_chat,
    "op5_licenses": op5_licenses,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_warc": op8_warc,
    "op9_decontaminate": op9_decontaminate,
    "op10_simhash": op10_simhash,
    "op11_spelling": op11_spelling,
    "op12_mixing": op12_mixing,
    "op13_collocation": op13_collocation,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring": substring.SQL,
    "op2_embedding": embedding.SQL,
    "op4_chat": chat.SQL,
    "op5_licenses": licenses.sql(),
    "op8_warc": warc.SQL,
    "op9_decontaminate": decontaminate.sql(),
    "op11_spelling": spelling.SQL,
    "op13_collocation": collocation.SQL,
}
