import pytest

from clientela.llm.shared import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def docs(spark):
    """Documents of given texts, with further columns of clashing names."""

    def make(texts, start=1, ids=None):
        ids = ids or range(start, start + len(texts))
        rows = [(i, t, None, "s", 1, 2) for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, u long")

    return make
