import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents of the given (id, text) rows; sources in turn."""

    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", f"s{n % 3}", None if t is None else len(t)) for n, (i, t) in enumerate(rows)], COLUMNS)
        if extra:  # columns whose names clash with those used inside
            for c in ("places", "key", "h", "sig", "component", "n", "rank", "bucket", "shard", "size"):
                df = df.withColumn(c, df.doc_id)
        return df

    return make
