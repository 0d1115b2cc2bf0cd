import pytest


@pytest.fixture()
def documents(spark):
    """A frame of (doc_id, text, lang, source, n_chars) from (doc_id, text) pairs."""

    def make(rows, lang="en", source="s"):
        rows = [(*r, lang, source, len(r[1] or "")) if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
