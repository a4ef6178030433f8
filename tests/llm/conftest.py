import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark string, h string, id string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of ``(doc_id, text[, source])`` rows with extra columns whose names operators use inside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "m", "h", "i") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
