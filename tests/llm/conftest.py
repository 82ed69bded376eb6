import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents of (id, text) or (id, text, lang, source) rows, with columns whose names clash with results."""

    def make(rows, clash=True):
        full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "a")), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", "1 AS n_words", "'x' AS kept_text", "2 AS slot", "3 AS score", "'y' AS language", "4 AS block", "5 AS key") if clash else df

    return make
