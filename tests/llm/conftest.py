import random

import pytest


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs():
    """Documents with nulls, blanks, short and long texts, copies, shared passages, repeated rows and ids."""
    rng = random.Random(3)
    passage, other = prose(rng, 45), prose(rng, 30)
    rows = [(1, None), (2, ""), (3, "  \t\n "), (4, "one two"), (5, "Éa ñ 中文 \U0001f600 mixed UPPER case-words x"), (6, passage), (7, f"before it {passage} after it"), (7, f"before it {passage} after it"), (None, f"no id {passage}")]
    rows += [(100 + i, prose(rng, 60)) for i in range(20)]
    rows += [(200 + i, f"{prose(rng, 10)} {other}\n{prose(rng, 10)}") for i in range(8)]
    rows += [(300 + i, "same same " * 40) for i in range(3)] + [(400, " ".join(["x"] * 50)), (401, " ".join(["x"] * 50))]
    long = prose(rng, 6000)
    rows += [(500, long), (501, long + " end"), (502, f"lead\x0bin {long}")]
    return rows


@pytest.fixture
def docs_df(spark, odd_docs):
    """With columns whose names clash with the operators' outputs."""
    rows = [(i, t, "en", "s", len(t or ""), "x", 1.5) for i, t in odd_docs]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, Score string, n_words double").repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
