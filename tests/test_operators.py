"""Operators on small inline rows: boundaries, ties, conflicts, idempotence, no row loss."""

import datetime as dt

from pyspark.sql import functions as F

from tallyloom.operators import counting, matching, ordering, rules, state, timeline
from tallyloom.sinks import writers
from tallyloom.sources import readers
from tallyloom.streaming import streams


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_threshold_and_conflicts(spark):
    c = spark.createDataFrame([(1, 1, 10), (1, 1, 10), (2, 1, 11), (3, 1, 6), (3, 1, 7), (3, 2, 6)], "post long, cid long, k long")
    s = {r.post: r for r in counting.evidence(counting.strict_counts(c, "post", "cid", "k")).collect()}
    assert (s[1].known_count, s[1].qualified, s[1].basis) == (10, False, "exact")
    assert (s[2].known_count, s[2].qualified) == (11, True)
    assert (s[3].known_count, s[3].known_minimum, s[3].qualified, s[3].basis) == (None, 12, True, "lower_bound")


def test_unknown_is_not_false(spark):
    c = spark.createDataFrame([(1, 1, 3), (1, 1, 4)], "post long, cid long, k long")
    r = counting.evidence(counting.strict_counts(c, "post", "cid", "k")).first()
    assert (r.known_count, r.qualified, r.basis) == (None, None, "unknown")


def test_reported_total_must_agree(spark):
    c = spark.createDataFrame([(1, 1, 3, 2)], "post long, cid long, k long, total long")
    assert counting.strict_counts(c, "post", "cid", "k", "total").first().complete is False


def test_as_of_is_strict(spark):
    t = lambda h: dt.datetime(2026, 1, 1, h)
    a = spark.createDataFrame([(1, "k", t(5)), (2, "k", t(1)), (3, "z", t(5)), (4, None, t(5))], "id long, key string, t timestamp_ntz")
    p = spark.createDataFrame([(7, "k", t(1)), (8, "k", t(5)), (9, "k", t(3))], "pid long, key string, pt timestamp_ntz")
    got = {r.id: r.prior_id for r in matching.latest_before(a, p, "key", "t", "pt", "pid").collect()}
    assert got == {1: 9, 2: None, 3: None, 4: None}


def test_range_join_ends(spark):
    d = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=n)
    a = spark.createDataFrame([(1, "k", d(10))], "id long, key string, t timestamp_ntz")
    p = spark.createDataFrame([(1, "k", d(3)), (2, "k", d(10)), (3, "k", d(2)), (4, "k", d(9))], "pid long, key string, pt timestamp_ntz")
    assert {r.pid for r in matching.within_days(a, p, "key", "t", "pt", 7).collect()} == {1, 4}


def test_history_comparison_loses_no_row(spark):
    c = spark.createDataFrame([(1, ["a"], "T"), (2, ["b"], "U"), (3, [], None)], "id long, urls array<string>, title string")
    h = spark.createDataFrame([(10, ["a"], "Z"), (11, ["q"], "U")], "id long, urls array<string>, title string")
    keys = {"url": F.col("urls"), "title": F.array("title")}
    m = matching.compare_history(matching.key_rows(c, "id", keys), matching.key_rows(h, "id", keys), ["url"])
    got = {r.id: (r.n_matches, r.n_same) for r in matching.annotate(c, "id", m).collect()}
    assert got == {1: (1, 1), 2: (1, 0), 3: (0, 0)}


def test_editorial_order_is_stable(spark):
    df = spark.createDataFrame([("e", 1, 80, 80), ("e", 2, 80, 80), ("e", 3, 100, 80)], "edition string, pos long, importance int, rest int")
    df = df.withColumns({c: F.col("rest") for c in ("domestic", "reliability", "recency", "interest")})
    r = ordering.editorial_rank(df, ["edition"], "pos").withColumn("s", ordering.score({k: F.col(k) for k in ordering.WEIGHTS}).cast("double"))
    assert [(x.pos, x.rank) for x in r.orderBy("rank").collect()] == [(3, 1), (1, 2), (2, 3)]
    assert {x.pos: x.s for x in r.collect()}[3] == 87.0


def test_next_unread_wraps(spark):
    df = spark.createDataFrame([(1, i, i in (2, 3)) for i in range(1, 4)], "k long, i long, seen boolean")
    assert {r.i: r.next_unread for r in ordering.next_unread(df, "k", "i", "i", "seen").collect()} == {1: None, 2: 1, 3: 1}


def test_best_and_newer_incomplete(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, False), ("b", 1, False)], "k string, t long, ok boolean")
    r = {x.k: (x.selected.t, x.newer_incomplete, x.latest.t) for x in ordering.newer_incomplete(df, "k", ["t"], "ok").collect()}
    assert r == {"a": (1, 2, 3), "b": (1, 0, 1)}


def test_corrections_leave_entries(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "a")], "id string, fixes string")
    got = sorted((r.id, r.superseded_by or "") for r in timeline.superseded_by(df, "id", "fixes").collect())
    assert got == [("a", "b"), ("a", "c"), ("b", ""), ("c", "")]


def test_empty_page_proves_nothing(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (2, 1)], "page long, t long")
    assert {r.page: r.boundary_confirmed for r in timeline.boundary_proof(df, ["page"], "t", F.lit(5)).collect()} == {1: False, 2: True}
    c = timeline.pages_contiguous(spark.createDataFrame([("a", 1, True), ("a", 3, False)], "p string, n long, b boolean"), "p", "n", "b").first()
    assert (c.contiguous, c.boundary_confirmed) == (False, False)


def test_coverage(spark):
    f = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    r = timeline.coverage(f(1, 2, 2, 3, 4), f(1), f(2), "id").first()
    assert (r.n_listed, r.n_excluded, r.n_observed, r.n_missing, r.complete) == (4, 1, 1, 2, False)


def test_replay_and_batches(spark):
    log = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y")], "op string, h string")
    assert rows(state.operations(log, "op", "h")) == [("a", 2, False), ("b", 2, True)]
    now, new = (spark.createDataFrame([r], "id long, rev long") for r in ((1, 1), (1, 2)))
    none = spark.createDataFrame([], "rule string")
    bad = spark.createDataFrame([("r",)], "rule string")
    assert rows(state.apply_batch(now, new, none, "id", ["rev"])) == [(1, 2)]
    assert rows(state.apply_batch(now, new, bad, "id", ["rev"])) == [(1, 1)]


def test_rules_report_unknown(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id long, n long")
    assert rows(rules.violations(df, "id", {"positive": F.col("n") > 0, "small": F.col("n") < 3})) == [(1, "small"), (2, "positive"), (2, "small"), (3, "positive")]


def test_csv_guard(spark):
    df = spark.createDataFrame([("=1", [1]), ("ok", None)], "a string, b array<int>")
    assert rows(writers.csv_guarded(df).na.fill("")) == [("'=1", "[1]"), ("ok", "")]


def test_snapshot_digest_is_independent_of_order(spark):
    df = spark.createDataFrame([("e", i, f"t{i}") for i in range(20)], "e string, i long, t string")
    a, b = (writers.snapshot_rows(x, "e", ["i", "t"], F.lit(True)).first().snapshot_sha256 for x in (df, df.orderBy(F.col("i").desc()).repartition(3)))
    assert a == b


def test_editions_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id":"2026-10-01-am","date":"2026-10-01","edition":"am",\n"stories":[{"id":"s","title":"t"},{"id":"u","title":"v"}]}')
    s = readers.stories(readers.editions(spark, str(tmp_path)))
    assert [(r.edition_id, r.pos, r.id) for r in s.orderBy("pos").collect()] == [("2026-10-01-am", 0, "s"), ("2026-10-01-am", 1, "u")]


def test_agent_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"type":"turn.started"}\n{"type":"turn.completed","usage":{"a":3}}\n')
    e = readers.agent_events(spark, str(tmp_path / "log.jsonl"))
    assert readers.log_failed(e).first().failed is False
    assert readers.log_failed(e.where("type = 'turn.started'")).first().failed is True


def test_stream_windows_equal_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streams.edition_counts(stream).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.window_end, r.event_type): r.n for r in spark.table("w").collect()}
    batch = events.groupBy(F.window("ts", "12 hours", startTime="9 hours"), "event_type").agg(F.count("*").alias("n")).collect()
    last = max(r.ts for r in events.agg(F.max("ts").alias("ts")).collect())
    assert got == {(r.window.end, r.event_type): r.n for r in batch if r.window.end <= last}


def test_stream_first_seen(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.datetime(2026, 1, 1, 2)), ("a", dt.datetime(2026, 1, 1, 1)), ("b", dt.datetime(2026, 1, 1, 3))], "k string, t timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = streams.first_seen(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "t")
    q = s.writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = df.groupBy("k").agg(F.min("t").alias("first_seen"))
    assert rows(spark.table("seen")) == rows(want)
