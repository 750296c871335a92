import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    def make(texts, **columns):
        """A documents table: texts, or (doc_id, text) pairs; other columns by name as lists."""
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        lang, source = columns.get("lang", ["en"] * len(rows)), columns.get("source", ["s"] * len(rows))
        return spark.createDataFrame([(i, t, a, s, None if t is None else len(t)) for (i, t), a, s in zip(rows, lang, source)], KIND)

    return make
