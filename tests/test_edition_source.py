"""The edition source: files that filters leave, unreadable ones, and a stream that goes on from its offset."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import editions


@pytest.fixture
def root(spark, tmp_path):
    spark.dataSource.register(editions.EditionSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for day in range(1, 6):
        for half in ("am", "pm"):
            put(tmp_path / "in", f"2026-10-0{day}", half, {"id": f"2026-10-0{day}-{half}", "stories": [1] * day})
    (tmp_path / "in" / "2026-10-01" / "notes.txt").write_text("x")
    (tmp_path / "in" / "index.json").write_text("{}")
    yield tmp_path
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def put(path, date, half, body):
    (path / date).mkdir(parents=True, exist_ok=True)
    (path / date / f"{half}.json").write_text(body if isinstance(body, str) else json.dumps(body))


def test_filters_open_only_their_files(spark, root):
    df = spark.read.format("editions").load(str(root / "in"))
    assert df.count() == 10 and df.columns == ["date", "edition", "file", "id", "body"]
    some = df.where("date >= '2026-10-03' AND date < '2026-10-05' AND edition = 'pm'")
    assert sorted(r.id for r in some.collect()) == ["2026-10-03-pm", "2026-10-04-pm"]
    assert some.rdd.getNumPartitions() == 2  # a file each, and no others
    assert df.where(F.col("date").isin("2026-10-02", "2027-01-01")).rdd.getNumPartitions() == 2
    # A file that can't be opened, beside those that are asked for.
    put(root / "in", "2026-11-01", "am", "{not json")
    put(root / "in", "2026-11-01", "pm", "[1]")
    late = df.where("date = '2026-11-01'").orderBy("edition").collect()
    assert [(r.edition, r.id, r.body) for r in late] == [("am", None, None), ("pm", None, None)]
    assert df.where("id LIKE '%05-am' AND date > '2026-10-01'").count() == 1
    assert spark.read.format("editions").load(str(root / "none")).count() == 0


def test_a_reader_answers_what_it_can():
    reader = editions.EditionReader("/nowhere")
    kept = [editions.EqualTo(("date",), "2026-10-01"), editions.In(("edition",), ("am",))]
    left = [editions.EqualTo(("id",), "x"), editions.EqualTo(("body", "date"), "x")]
    assert list(reader.pushFilters(kept + left)) == left
    assert reader._wanted("date", "2026-10-01") and not reader._wanted("date", "2026-10-02") and not reader._wanted("edition", "pm")


def test_a_stream_goes_on_from_its_offset(spark, root):
    out, checkpoint = str(root / "out"), str(root / "cp")

    def run():
        stream = spark.readStream.format("editions").load(str(root / "in")).select("file", "id")
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.file for r in spark.read.parquet(out).collect())

    first = run()
    assert len(first) == 10 and len(set(first)) == 10
    put(root / "in", "2026-10-06", "am", {"id": "new"})
    put(root / "in", "2026-10-06", "pm", {"id": "newer"})
    assert run() == first + ["2026-10-06/am.json", "2026-10-06/pm.json"]
    assert run() == first + ["2026-10-06/am.json", "2026-10-06/pm.json"]
