"""Identifiers of works as column expressions; every function takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the two sources' identifier formats.
WORK_PREFIX = "https://openalex.org/"
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "doi:")
KNOWN_PREFIXES = ("DOI", "ARXIV", "CORPUSID", "MAG", "PMID", "PMCID", "URL")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def without_prefix(c: Column, prefix: str) -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def work_id(c: Column) -> Column:
    """Short form of a work id; upper case when it begins with W."""
    short = without_prefix(F.trim(c), WORK_PREFIX)
    return F.when(F.lower(F.substr(short, F.lit(1), F.lit(1))) == "w", F.upper(short)).otherwise(short)


def doi(c: Column) -> Column:
    """Bare lower-case DOI, or null; each prefix is taken off once, one after another."""
    value = F.lower(F.trim(c))
    for prefix in DOI_PREFIXES:
        value = without_prefix(value, prefix)
    return blank_to_null(value)


def work_doi(own: Column, external_ids: Column) -> Column:
    return doi(F.coalesce(blank_to_null(own), external_ids["doi"]))


def dedupe_key(own_doi: Column, external_ids: Column, own_id: Column) -> Column:
    """``doi:``, else ``arxiv:``, else ``id:``: what two records of one work agree on."""
    return F.coalesce(
        F.concat(F.lit("doi:"), work_doi(own_doi, external_ids)),
        F.concat(F.lit("arxiv:"), F.lower(blank_to_null(external_ids["arxiv"]))),
        F.concat(F.lit("id:"), own_id),
    )


def neighbour_reference(c: Column) -> Column:
    """The prefixed form the second source looks a paper up by."""
    value = F.trim(c)
    head, rest = F.upper(F.substring_index(value, ":", 1)), F.substr(value, F.instr(value, ":") + 1)
    prefixed = (F.instr(value, ":") > 0) & (rest != "") & head.isin(*KNOWN_PREFIXES)
    url = F.startswith(value, F.lit("https://doi.org/")) | F.startswith(value, F.lit("http://doi.org/"))
    return (
        F.when(prefixed, F.concat(head, F.lit(":"), rest))
        .when(url, F.concat(F.lit("DOI:"), F.substr(value, F.instr(value, "doi.org/") + 8)))
        .when(F.startswith(value, F.lit("10.")), F.concat(F.lit("DOI:"), value))
        .otherwise(value)
    )


def seed_reference(own_doi: Column, external_ids: Column) -> Column:
    """``DOI:x``, else ``ARXIV:x``, else null."""
    return F.coalesce(F.concat(F.lit("DOI:"), work_doi(own_doi, external_ids)), F.concat(F.lit("ARXIV:"), blank_to_null(external_ids["arxiv"])))
