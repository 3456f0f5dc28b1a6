import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs_of(spark):
    """Documents table from (doc_id, text[, lang]) rows."""

    def make(rows, lang="en"):
        full = [(r[0], r[1], r[2] if len(r) > 2 else lang, "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
