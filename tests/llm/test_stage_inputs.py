"""Pipeline stages on nulls in every column, empty and repeated rows, clashing columns, long texts and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import quality

LONG = "word " * 60_000 + "mail a@b.cc end"
ROWS = [
    (1, "A fine text about things that matter to people who read", "en", "s0", 55), (1, "A fine text about things that matter to people who read", "en", "s0", 55),
    (None, "no id here at all, but words", "en", "s1", 10), (2, None, "en", "s0", None), (3, "", None, None, 0), (4, "   \n", "de", "s1", 4), (5, LONG, "en", None, len(LONG)), (None, None, None, None, None),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("key", "h", "row", "draw", "shard", "size", "component", "kept", "places", "sub", "bucket", "y", "score", "id", "of", "nth", "taken")


@pytest.fixture
def odd(spark, tmp_path):
    df = spark.createDataFrame(ROWS, COLUMNS)
    for c in CLASHES:
        df = df.withColumn(c, F.lit(c))
    labels = [(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (1, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return df, str(tmp_path)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, odd, name, stage):
    df, sf_dir = odd
    out = stage(spark, df, sf_dir)
    rows = out.collect()
    if name == "tokens":
        assert len(rows) == len(ROWS) and all(r.round_trip for r in rows)
        assert sorted(r.doc_id is None for r in rows) == sorted(r[0] is None for r in ROWS)
    else:
        assert out.columns == df.columns
        assert all(r[c] == c for r in rows for c in CLASHES)
    if name == "near_dedup":
        assert len(rows) == len(ROWS)  # rows repeated under one id are one node; null ids stay
    if name == "pii":
        assert [r.text for r in rows if r.doc_id == 5][0].endswith("mail <EMAIL> end") and sum(r.text is None for r in rows) == 2
    if name == "mix":
        assert all(r.text and r.text.strip() for r in rows)
    none = stage(spark, df.where("false"), sf_dir)
    assert none.count() == 0


def test_scores_of_odd_rows(spark, odd):
    df, sf_dir = odd
    machine = quality.train(df, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = quality.score(df, machine).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
