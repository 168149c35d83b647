import pytest

from logspark.llm.common import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sc(spark):
    """The session with this package on its workers."""
    ship(spark)
    return spark


@pytest.fixture(scope="session")
def docs_of(sc):
    """Documents from (doc_id, text) or (doc_id, text, source)."""
    def make(rows):
        return sc.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None) for r in rows], DOCS)
    return make


#: Nulls, empty and long texts, repeated rows, repeated ids, odd characters.
LONG = " ".join(f"word{i % 997} next{i % 13}" for i in range(30_000))
ODD = [
    (1, None, "a"), (2, "", "a"), (3, "   \n \t ", None), (4, LONG, "b"), (5, "same words here and there again", "a"),
    (5, "same words here and there again", "a"), (6, "same words here and there again", "b"), (7, "x" * 200_000, "b"),
    (8, "1" * 50_000, None), (9, "émigré Ünïcode 😀 \x00 \x1f 日本語 <|endoftext|>", "a"), (None, "no id has this text at all", "a"),
    (10, "\n\n\nline\n\n", "c"), (5, "other text under a repeated id", "c"),
]


@pytest.fixture(scope="session")
def odd(sc):
    """ODD with extra columns whose names the operators use inside."""
    rows = [(i, t, "en", s, 0, -1, "k", 0.5, True, 7, "id", 1) for i, t, s in ODD]
    return sc.createDataFrame(rows, DOCS + ", id long, key string, weight double, kept boolean, copies int, _id string, h int")
