"""Labels, sentences and display numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import blank_to_null

#: The display vocabulary.
INTENT_WORDS = {"background": "background", "methodology": "its method", "result": "its result"}
HOP_COLOURS = {0: "#f2a900", 1: "#2a9d8f", 2: "#8ecae6"}
OTHER_COLOUR, SEED_COLOUR, SEED_BORDER, BORDER = "#cbd5e1", "#f2a900", "#7c4a03", "#334155"
ROLE_COLOURS = {"ancestor": "#2a9d8f", "descendant": "#8ecae6", "contemporary": "#c8b6e2"}
ROLE_LABELS = {"ancestor": "Where the idea came from", "descendant": "What it grew into", "contemporary": "Parallel work"}
HOP_LABELS = {0: "Seed", 1: "1 hop away", 2: "2 hops away"}
SEED_LABEL = "Seed paper"
VIA, BECAUSE = ('Two hops from the seed via "', '": ', "; ", "."), ("Reached ", " hop(s) from the seed during traversal, but the connecting paper(s) didn't make the relevance cutoff, so the direct path isn't shown.")
CITED_FOR, INFLUENTIAL = "cited for ", "flagged as an influential citation"
SEED_TEXT = "This is the seed paper the whole tree is built from."
BUILT_ON = "The seed paper cites this one directly - it's part of what the seed built on."
GREW_OUT = "This paper cites the seed directly - it's part of what grew out of the seed."
ABSTRACT_CHARS, TITLE_CHARS, ABOUT_AUTHORS = 320, 42, 4


def lookup(c: Column, table: dict, default: Column) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(default)


def last_word(c: Column) -> Column:
    return F.element_at(F.split(F.trim(c), r"\s+"), -1)


def short_label(title: Column, authors: Column, year: Column) -> Column:
    """``Lastname et al. 2019`` where there are authors and a year, else the title, cut."""
    first = F.get(authors, F.lit(0))
    name = F.when(F.trim(first) != "", last_word(first)).otherwise(first)
    label = F.concat(name, F.when(F.size(authors) > 1, " et al.").otherwise(""), F.lit(" "), year.cast("string"))
    cut = F.when(F.length(title) > TITLE_CHARS, F.concat(F.substr(title, F.lit(1), F.lit(TITLE_CHARS - 1)), F.lit("…"))).otherwise(title)
    return F.when((F.size(authors) > 0) & year.isNotNull() & (year != 0), label).otherwise(cut)


def cut_abstract(c: Column) -> Column:
    """One line; beyond ABSTRACT_CHARS cut before the word that doesn't fit."""
    flat = F.regexp_replace(F.trim(c), "\n", " ")
    head = F.regexp_replace(F.substr(flat, F.lit(1), F.lit(ABSTRACT_CHARS)), " [^ ]*$", "")
    return F.when(F.length(flat) > ABSTRACT_CHARS, F.concat(head, F.lit("…"))).otherwise(flat)


def description(title: Column, authors: Column, year: Column, cited: Column, abstract: Column) -> Column:
    """A paper as a prompt shows it: a head line, and the cut abstract below it if there is one."""
    who = F.concat(F.coalesce(last_word(F.get(authors, F.lit(0))), F.lit("unknown")), F.when(F.size(authors) > 1, " et al.").otherwise(""))
    head = F.concat(title, F.lit(" ("), who, F.lit(", "), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(", "), cited.cast("string"), F.lit(" citations)"))
    short = cut_abstract(abstract)
    return F.when(short != "", F.concat(head, F.lit("\n"), short)).otherwise(head)


def joined(items: Column) -> Column:
    """``a``, ``a and b``, ``a, b and c``."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(items, -1)))


def intent_clause(intents: Column, influential: Column) -> Column:
    """What a citation was for; empty where nothing was looked up."""
    words = F.transform(intents, lambda x: lookup(x, INTENT_WORDS, x))
    cited = F.when(F.size(intents) > 0, F.concat(F.lit(CITED_FOR), joined(words)))
    flag = F.when(influential, INFLUENTIAL)
    return F.array_join(F.array_compact(F.array(cited, flag)), "; ")


def direct_text(seed_is_source: Column, intents: Column, influential: Column) -> Column:
    base = F.when(seed_is_source, BUILT_ON).otherwise(GREW_OUT)
    clause = intent_clause(intents, influential)
    capital = F.concat(F.upper(F.substr(clause, F.lit(1), F.lit(1))), F.lower(F.substr(clause, F.lit(2))))
    return F.when(clause != "", F.concat(base, F.lit(" ("), capital, F.lit(".)"))).otherwise(base)


def edge_phrase(forward: Column, title_a: Column, title_b: Column) -> Column:
    """``"A" cites "B"``; ``forward`` says that A is the one that cites."""
    a, b = F.when(forward, title_a).otherwise(title_b), F.when(forward, title_b).otherwise(title_a)
    return F.concat(F.lit('"'), a, F.lit('" cites "'), b, F.lit('"'))


def bridge_text(bridge: Column, leg1: Column, leg2: Column) -> Column:
    parts = [F.lit(x) for x in VIA]
    return F.concat(parts[0], bridge, parts[1], leg1, parts[2], leg2, parts[3])


def fallback_text(hop: Column) -> Column:
    return F.concat(F.lit(BECAUSE[0]), hop.cast("string"), F.lit(BECAUSE[1]))


def node_size(cited: Column) -> Column:
    return 14 + F.sqrt(F.least(cited, F.lit(5000)).cast("double"))


def cluster_size(n: Column) -> Column:
    return 26 + F.pow(F.least(n, F.lit(40)).cast("double"), F.lit(0.6)) * 6


def hop_colour(hop: Column) -> Column:
    return lookup(hop, HOP_COLOURS, F.lit(OTHER_COLOUR))


def role_colour(role: Column) -> Column:
    return lookup(role, ROLE_COLOURS, F.lit(OTHER_COLOUR))


def role_label(role: Column) -> Column:
    return lookup(role, ROLE_LABELS, role)


def script_safe(json: Column) -> Column:
    """JSON that can stand inside a script element."""
    return F.replace(json, F.lit("</"), F.lit("<\\/"))


def author_line(authors: Column) -> Column:
    return F.concat(F.array_join(F.slice(authors, 1, ABOUT_AUTHORS), ", "), F.when(F.size(authors) > ABOUT_AUTHORS, ", et al.").otherwise(""))


def clean_text(c: Column) -> Column:
    """Trimmed and non-empty, or null."""
    return blank_to_null(F.trim(c.cast("string")))


def whole_number(c: Column) -> Column:
    """An integer, also as text; anything else, ``3.0`` and booleans among it, is null. Beyond 18 digits it is the largest or smallest there is."""
    text = F.trim(c.cast("string"))
    digits = F.regexp_replace(text, "^[+-]?0*", "")
    most = F.when(F.startswith(text, F.lit("-")), -(1 << 62)).otherwise(1 << 62)
    value = F.when(F.length(digits) > 18, most).otherwise(F.regexp_replace(text, r"^\+", "").try_cast("long"))
    return F.when(text.rlike("^[+-]?[0-9]+$"), value)


def importance(c: Column) -> Column:
    """1 to 5; what can't be read, and 0, is 3."""
    n = whole_number(c)
    return F.least(F.lit(5), F.greatest(F.lit(1), F.coalesce(F.when(n != 0, n), F.lit(3)))).cast("int")


def valid_year(c: Column) -> Column:
    n = whole_number(c)
    return F.when(n.between(1500, 2100), n.cast("int"))


def valid_role(c: Column) -> Column:
    role = F.lower(F.trim(c))
    return F.when(role.isin(*ROLE_LABELS), role).otherwise("contemporary")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
