"""Gates on good rows, normalisation on hand-made posts, journals, trees and plans."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import gates, observations, ordering, publication, rules, timeline
from tallyloom.sinks import writers
from tallyloom.sources import readers



def window():
    return F.expr("TIMESTAMP_NTZ'2026-10-11 21:00:00'"), F.expr("TIMESTAMP_NTZ'2026-10-12 21:00:00'")


POST = "id string, url string, status string, title string, observed_at timestamp_ntz, listed_at timestamp_ntz, rows_given boolean, all_selected boolean, expected int, evidence_at timestamp_ntz, sources array<struct<id:string,title:string>>, sources_expanded boolean, sources_expected int, media array<struct<type:string,url:string,complete:boolean,width:int,height:int>>"
COMMENT = "id string, cid string, n long, at timestamp_ntz, pos int"
T0 = datetime(2026, 10, 12, 12)


def post(i, **other):
    row = {"id": f"aagag-{i}", "url": f"https://aagag.com/issue/?idx={i}", "status": "observed", "title": "t", "observed_at": T0, "listed_at": T0, "rows_given": True, "all_selected": True, "expected": 1, "evidence_at": None, "sources": [("s", "t")], "sources_expanded": True, "sources_expected": 1, "media": [("image", "u", True, 2, 2)]}
    return tuple((row | other).values())


def test_normalised_posts(spark):
    posts = [
        post(1), post(2, expected=2), post(3, status="failed", evidence_at=T0, expected=5), post(4, title="비키니"), post(5, status="outside_window", listed_at=datetime(2026, 10, 1), id="5"), post(6, rows_given=False, expected=0), post(7, media=[("image", "u", False, 2, 2)]), post(8),
    ]
    comments = [("aagag-1", "a", 11, T0, 1), ("aagag-1", "a", 11, T0, 2), ("aagag-2", "a", 12, T0, 1), ("aagag-3", "a", 30, T0, 1), ("aagag-4", "a", 11, T0, 1), ("5", "a", 50, T0, 1), ("aagag-7", "a", 11, T0, 1), ("aagag-8", "a", 11, T0, 1), ("aagag-8", "a", 12, T0, 2)]
    got = {r.id: r for r in observations.normalise(spark.createDataFrame(posts, POST), spark.createDataFrame(comments, COMMENT), *window()).collect()}
    one = got["aagag-1"]
    assert (one.k_count, one.duplicate_rows, one.qualified, one.basis, one.candidate, one.held, one.inspection_complete, one.n_within) == (11, 1, True, "exact_native_total", True, False, True, 1)
    assert (got["aagag-2"].k_count, got["aagag-2"].known_minimum, got["aagag-2"].basis, got["aagag-2"].hold_reasons) == (None, 12, "observed_lower_bound", ["native_comment_total_unverified"])
    assert (got["aagag-3"].qualified, got["aagag-3"].candidate, got["aagag-3"].inspection_complete) == (True, True, False)
    assert not got["aagag-4"].candidate and got["aagag-4"].exclusions[0].code == "sexual_title"
    out = got["5"]
    assert out.outside and out.inspection_complete and out.observed_k is None and out.qualified is None and not out.candidate and out.n_before is None
    assert got["aagag-6"].qualified is None and got["aagag-6"].n_conflicts == 1 and not got["aagag-6"].comments_complete
    assert got["aagag-7"].candidate and not got["aagag-7"].media_complete and not got["aagag-7"].inspection_complete
    assert got["aagag-8"].n_conflicts == 1 and got["aagag-8"].qualified is None and got["aagag-8"].observed_k == 12
    assert observations.normalise(spark.createDataFrame([], POST), spark.createDataFrame([], COMMENT), *window()).count() == 0


def test_null_is_never_valid(spark):
    """Every gate breaks on rows of nulls, and on none at all it is silent."""
    check = "id string, channel string, status string, count long, checked_at timestamp_ntz, source string, note string"
    broken = {r.rule for r in rules.violations(spark.createDataFrame([("k",) + (None,) * 7], "k string, " + check), "k", gates.check_record(window()[1])).collect()}
    assert broken >= {"id", "channel", "status", "time", "source", "note"}
    good = [("k", "check-1", "news", "empty", 0, T0, "site", "seen")]
    assert rules.violations(spark.createDataFrame(good, "k string, " + check), "k", gates.check_record(window()[1])).count() == 0
    assert rules.violations(spark.createDataFrame([], "k string, " + check), "k", gates.check_record(window()[1])).count() == 0


def test_own_urls_and_strings(spark):
    rows = [("https://aagag.com/issue/?idx=5_2", "aagag-5"), ("https://aagag.com/issue/?idx=6", "aagag-5"), ("https://u@aagag.com/issue/?idx=5", "aagag-5"), (None, "aagag-5")]
    got = spark.createDataFrame(rows, "u string, i string").select(observations.own_url(F.col("u"), F.col("i")).isNotNull().alias("x")).collect()
    assert [r.x for r in got] == [True, False, False, False]
    values = [('"a"', ["a"]), ('["a",1,"1",null]', ["a", "1"]), ("null", []), (None, []), ("{}", [])]
    got = spark.createDataFrame([(v,) for v, _ in values], "v string").select(publication.strings(F.col("v")).alias("x")).collect()
    assert [r.x or [] for r in got] == [w for _, w in values]


def test_journal_ignores_unfinished_batches(spark, tmp_path):
    path, df = str(tmp_path), spark.createDataFrame([(1, "a")], "id int, v string")
    writers.write_journaled(spark, path, "b1", {"items": df, "index": df})
    df.write.parquet(f"{path}/data/items/batch=b2")  # an attempt that was lost before its manifest
    assert [r.batch for r in writers.committed(spark, path).collect()] == ["b1"]
    assert writers.read_journaled(spark, path, "items").count() == 1
    writers.write_journaled(spark, path, "b2", {"items": df.union(df)})
    writers.write_journaled(spark, path, "b1", {"items": df.union(df)})  # immutable
    assert writers.read_journaled(spark, path, "items").count() == 3
    writers.write_publication(spark, [f"{path}/x", f"{path}/y"], "e1", df, df, df)
    assert writers.read_journaled(spark, f"{path}/y", "issues").count() == 1


def test_plan_is_all_or_nothing(spark):
    current = spark.createDataFrame([("a", 1), ("b", 1)], "id string, revision int")
    batch = spark.createDataFrame([("o1", "d1", "a", 2), ("o2", "d2", "c", 1)], "op string, digest string, id string, revision int")
    none = spark.createDataFrame([], "key string, rule string")
    log = lambda *rows: spark.createDataFrame(list(rows), "op string, digest string")
    run = lambda known, bad: publication.plan(current, batch, known, bad, "id", ["revision"], "op", "digest")
    after, events = run(log(("o1", "d1")), none)
    assert {(r.id, r.revision) for r in after.collect()} == {("a", 1), ("b", 1), ("c", 1)}
    assert {r.op: r.outcome for r in events.collect()} == {"o1": "replay", "o2": "new"}
    for known, bad in ((log(("o1", "other")), none), (log(), spark.createDataFrame([("c", "x")], "key string, rule string"))):
        after, _ = run(known, bad)
        assert {(r.id, r.revision) for r in after.collect()} == {("a", 1), ("b", 1)}
    row = writers.event_rows(run(log(), none)[1], "upsert", F.lit("now")).where("op = 'o1'").first()
    assert json.loads(row.superseded) == {"id": "a", "revision": 1} and json.loads(row.payload) == {"id": "a", "revision": 2} and row.command == "upsert"


def test_tree_digests(spark, tmp_path):
    for name, data in (("a/1.json", b"{}"), ("b/2.json", b"[]"), ("b/3.txt", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    tree = publication.tree_digests(spark, str(tmp_path), "*.json")
    assert sorted(r.path.rsplit("/", 1)[1] for r in tree.collect()) == ["1.json", "2.json"]
    before = publication.combined_digest(tree).first().sha256
    assert before == publication.combined_digest(publication.tree_digests(spark, str(tmp_path), "*.json").repartition(3)).first().sha256
    (tmp_path / "a/1.json").write_bytes(b"{ }")
    assert before != publication.combined_digest(publication.tree_digests(spark, str(tmp_path), "*.json")).first().sha256


def test_articles_and_comments(spark):
    page = '<meta property="og:title" content=" "><script>\nA.title = "Named \\"so\\""\nA.otime = 1791763200\nA.idx = 7\n</script>'
    r = readers.article(spark.createDataFrame([(1, page), (2, None), (3, "<p>x")], "i int, page string"), "i", "page").orderBy("i").collect()
    assert r[0].number == "7" and r[1].title is r[1].published_at is r[2].title is None
    bodies = ['{"mode":"success","total":0,"comment":[]}', '{"mode":"error"}', None]
    got = readers.reconciled(readers.comments(spark.createDataFrame(list(enumerate(bodies)), "i int, body string"), "i", "body"), "i").orderBy("i").collect()
    assert [(x.verdict, x.k_count) for x in got] == [("ok", 0), ("deleted", None), ("deleted", None)]


def test_snapshot_digest_is_order_free(spark):
    rows = [("e", i, f"v{i}") for i in range(50)]
    digest = lambda rs, n: writers.snapshot_rows(spark.createDataFrame(rs, "e string, i int, v string").repartition(n), "e", ["i", "v"], F.lit(True)).first().snapshot_sha256
    assert digest(rows, 1) == digest(rows[::-1], 4) != digest([*rows[1:], ("e", 0, "x")], 2)


def test_null_keys_find_nothing_before(spark):
    from tallyloom.operators import matching

    rows = spark.createDataFrame([(1, "a", 5), (2, None, 5)], "id int, k string, t int")
    prior = spark.createDataFrame([(7, "a", 3), (8, None, 3)], "pid int, k string, pt int")
    got = {r.id: r.prior_id for r in matching.latest_before(rows, prior, "k", "t", "pt", "pid").collect()}
    assert got == {1: 7, 2: None}


@pytest.mark.parametrize("n", (0, 3))
def test_previous_rows(spark, n):
    df = spark.createDataFrame([("a", i) for i in range(n)], "k string, i int")
    assert {r.i: r.previous_i for r in ordering.previous(df, "k", ["i"], ["i"]).collect()} == {i: i - 1 if i else None for i in range(n)}
    assert timeline.repeat_report(df.withColumnRenamed("k", "story"), "story").count() == (1 if n else 0)
