import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds a documents table from texts, or (id, text) or (id, text, source) tuples."""

    def build(*rows):
        full = []
        for n, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (n, r)
            full.append((r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")))
        return spark.createDataFrame(full, DOCS)

    return build
