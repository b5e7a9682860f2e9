import pytest

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """A table of documents from texts, or from (doc_id, text[, lang[, source]]) rows."""

    def make(rows):
        full = []
        for k, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (k, row)
            full.append((*row, *[None] * (4 - len(row)), None))
        return spark.createDataFrame(full, FIELDS)

    return make


@pytest.fixture
def rows_of():
    """Rows as dictionaries by doc_id, with a list for repeated ids."""

    def read(df):
        out = {}
        for row in df.collect():
            out.setdefault(row["doc_id"], []).append(row.asDict(recursive=True))
        return {k: v[0] if len(v) == 1 else v for k, v in out.items()}

    return read
