import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table; columns whose names clash with what operators make come along."""

    def make(rows):
        rows = [(i, t, lang, "s", len(t or ""), 1, 2, "x", 3.0) for i, t, lang in ((*r, None)[:3] for r in rows)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, component_id int, fingerprint string, first double")

    return make


WORDS = "the of stone river walks under bright morning seven clouds over quiet harbour while old songs drift between narrow streets and lamps".split()


@pytest.fixture(scope="session")
def prose():
    """Different prose for each number: sentences of six words."""
    import random

    def make(seed, sentences=8):
        r = random.Random(seed)
        return " ".join(" ".join(r.choice(WORDS) + str(r.randrange(99)) for _ in range(6)).capitalize() + "." for _ in range(sentences))

    return make
