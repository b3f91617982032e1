"""Archive editions by a reviewed map, challenge pages by header, and exports that are replaced as a whole."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import archive
from tallyloom.sinks import writers
from tallyloom.sinks.journal import Journal
from tallyloom.sources import readers

ARCHIVE = """## 2026-01-02 저녁
- [속보] 금리가 3~5% 올랐다. 다음 문장 확인: 한국은행.
    이어지는 줄
- 웹툰 산업이 커졌다
### 관찰
- 지켜볼 것
## 2026-01-03 오전
- 금리가 또 올랐다. 끝. 확인: A, B.
# 끝
- 밖
"""


def parsed(spark, tmp_path):
    (tmp_path / "a.md").write_text(ARCHIVE)
    found = readers.archive(readers.numbered_lines(spark, str(tmp_path / "a.md"))).where("kind = 'record'")
    return found.select(F.concat_ws("-", "date", "edition").alias("slot"), "text", "line_start", "line_end")


def test_editions_from_the_reviewed_map(spark, tmp_path):
    records = parsed(spark, tmp_path)
    assigned = spark.createDataFrame([("2026-01-02-pm", 1, "rates"), ("2026-01-02-pm", 2, "comics"), ("2026-01-03-am", 1, "rates")], "slot string, ordinal int, issue_key string")
    issues = spark.createDataFrame([("rates", "i1", "금리", "경제", "c1"), ("comics", "i2", "웹툰", "웹툰 산업", "c2")], "issue_key string, issue_id string, issue_title string, category string, context string")
    assert archive.unassigned(records, assigned, issues).count() == 0
    made = archive.stories(records, assigned, issues)
    got = {(r.slot, r.id): r for r in made.collect()}
    one, two, three = got["2026-01-02-pm", "archive-01"], got["2026-01-02-pm", "archive-02"], got["2026-01-03-am", "archive-01"]
    assert one.title == "금리가 3~5% 올랐다" and one.emphasis == ["3~5%"] and one.previous is None and one.topic_key == "2026-01-02-pm-archive-01"
    assert [(r.archive.line_start, r.archive.line_end) for r in (one, two, three)] == [(2, 3), (4, 4), (8, 8)]
    assert (two.category, two.archive.names, two.timeline.issue_title, two.previous) == ("웹툰 산업", [], "웹툰", None)
    assert three.archive.names == ["A, B"] and tuple(three.previous) == ("2026-01-02-pm", "archive-01", one.title) and three.summary == ["금리가 또 올랐다. 끝."]
    assert three.published_at is None and three.archive.verification == archive.VERIFICATION
    e = {r.slot: r for r in archive.editions(made).collect()}
    assert e["2026-01-02-pm"].themes == ["경제", "웹툰 산업"] and e["2026-01-02-pm"].n_stories == 2 and e["2026-01-02-pm"].id == "2026-01-02-pm-archive"
    assert e["2026-01-02-pm"].overview[1].endswith("웹툰 산업 기록: 웹툰 산업이 커졌다") and "웹툰" not in e["2026-01-03-am"].overview[1]
    assert archive.editions(made.where("false")).count() == 0


def test_the_map_must_cover_every_record(spark, tmp_path):
    records = parsed(spark, tmp_path)
    assigned = spark.createDataFrame([("2026-01-02-pm", 1, "rates"), ("2026-01-02-pm", 1, "rates"), ("2026-01-03-am", 1, "lost"), ("2026-01-04-am", 1, "rates")], "slot string, ordinal int, issue_key string")
    issues = spark.createDataFrame([("rates",)], "issue_key string")
    got = {tuple(r) for r in archive.unassigned(records, assigned, issues).collect()}
    assert got == {("2026-01-02-pm", 1, "twice"), ("2026-01-02-pm", 2, "unclassified"), ("2026-01-03-am", 1, "unknown issue"), ("2026-01-04-am", 1, "no record")}
    same = spark.createDataFrame([(ARCHIVE,), (ARCHIVE + " ",), (None,)], "t string").select(archive.same_source(F.col("t"), hashlib.sha256(ARCHIVE.encode()).hexdigest()).alias("s"))
    assert [r.s for r in same.collect()] == [True, False, False]


def test_challenge_by_title_or_header(spark):
    df = spark.createDataFrame([("<title>Just a moment...</title>", None), ("<title>Post</title>", "Challenge"), ("<title>Post</title>", "none"), (None, None), (None, "challenge")], "p string, h string")
    assert [r.c for r in df.select(readers.is_challenge(F.col("p"), F.col("h")).alias("c")).collect()] == [True, True, False, False, True]
    assert [r.c for r in df.select(readers.is_challenge(F.col("p")).alias("c")).collect()] == [True, False, False, False, False]


def test_an_export_is_replaced_as_a_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    outputs = lambda n: {name: spark.range(n).withColumn("name", F.lit(name)) for name in ("posts", "checks", "report", "table")}
    sizes = lambda: [writers.current_output(spark, path, name, "id long, name string").count() for name in outputs(0)]
    assert sizes() == [0, 0, 0, 0]
    writers.replace_outputs(spark, path, "0001", outputs(2))
    assert sizes() == [2, 2, 2, 2]
    whole = Journal.finish
    monkeypatch.setattr(Journal, "finish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        writers.replace_outputs(spark, path, "0002", outputs(5))
    monkeypatch.setattr(Journal, "finish", whole)
    assert sizes() == [2, 2, 2, 2]  # three or four new ones may be in place, but none is seen
    writers.replace_outputs(spark, path, "0003", outputs(1))
    assert sizes() == [1, 1, 1, 1]
