import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = DOCS + ", kept boolean, row string, found int, ids string, n_words string, sig string, label int"

FRAME = "the and to of in that was for with his her they this have from".split()


def prose(rng, n, vocabulary=None):
    words = vocabulary or FRAME + ["".join(rng.choice(["ta", "re", "lo", "mi", "ne", "so"]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def messy():
    """Rows with nulls everywhere, empty, blank and very long texts, repeated rows and near copies."""
    rng = random.Random(5)
    base = prose(rng, 300)
    near = base.split(" ")
    near[150] = "changed"
    rows = [(i, prose(rng, rng.randint(5, 250)), "en", "s", 0) for i in range(1, 40)]
    rows += [(40, None, "en", None, None), (41, "", None, "s", 0), (42, " \t\n\x0b ", "de", "s", 0), (None, base, None, None, None)]
    rows += [(50, base, "en", "s", 1), (51, base.upper(), "en", "s", 1), (52, " ".join(near), "fr", "s", 1), (50, base, "en", "s", 1)]
    rows += [(60, "one two", "en", "s", 1), (61, "One  two", "en", "s", 1), (62, "one", "en", "s", 1)]
    rows += [(70, "x" * 50_000, "en", "s", 1), (71, prose(rng, 20_000), "en", "s", 1), (72, "日本語 ▁ é \U0001f600  two", "ja", "s", 1)]
    return rows


@pytest.fixture
def documents(spark, messy):
    return spark.createDataFrame(messy, DOCS)


@pytest.fixture
def extra(spark, messy):
    """The same with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, True, "r", 1, "i", "w", "s", 7) for r in messy], EXTRA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(1, 40)] + [(None, 1, 0), (5, None, None), (900, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
