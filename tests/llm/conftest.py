import pytest


@pytest.fixture(scope="session")
def documents(spark):
    def build(*texts, ids=None, **extra):
        rows = [(i if ids is None else ids[i], t, "en", "s", 0) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return build
