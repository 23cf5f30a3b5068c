import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds a documents table from (doc_id, text) pairs, with a column whose names clash with the operators' own."""

    def build(rows, source="src0", extra=True):
        df = spark.createDataFrame([(i, t, "en", source, None if t is None else len(t)) for i, t in rows], DOCS)
        return df.selectExpr("*", "'x' as name", "7 as row_id", "'y' as blocks", "1.5 as length", "'z' as kept") if extra else df

    return build


@pytest.fixture
def words():
    """A maker of invented words, the same for one seed."""

    def make(seed, n, size=6):
        rng = random.Random(seed)
        return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, size))) for _ in range(n)]

    return make
