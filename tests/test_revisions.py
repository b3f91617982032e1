"""Attempted writes against a loop, one hot key in many pieces, and rolling items as a batch and as a restarted stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import revisions
from tallyloom.streaming import streams

LOG = "n long, k string, expected long, verified long, a string, b int, ok boolean, place int, piece string"


def loop(rows):
    """What each write finds and whether it is accepted, one after the other."""
    state, out = {}, {}
    for n, k, expected, verified, a, b, ok, *_ in sorted(rows):
        r, v, fixed = state.get(k, (0, None, None))
        first = next(((x[4], x[5]) for x in sorted(rows) if x[1] == k and x[6] and x[2] == 0 and x[3] is not None), None)
        revision_ok = None if expected is None else expected == r
        time_ok = verified is not None and (v is None or verified >= v)
        accepted = bool(ok) and first is not None and (a, b) == first and revision_ok is True and time_ok
        out[n] = (r, revision_ok or False, time_ok, r == 0 or (a, b) == first, accepted)
        if accepted:
            state[k] = (r + 1, verified, (a, b))
    return out


def random_log(seed, n, keys):
    rng = random.Random(seed)
    now = {}
    rows = []
    for i in range(n):
        k = rng.choice(keys)
        r = now.get(k, 0)
        expected = rng.choice((r, r, r, r + 1, max(r - 1, 0), 0, None, -1))
        rows.append((i, k, expected, rng.choice((i, i, i - 30, i + 20, None)), rng.choice("xxxxy"), rng.choice((1, 1, 1, None)), rng.random() < 0.95, 1, "p"))
        now[k] = r + (expected == r)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_acceptance_equals_a_loop(spark, seed):
    rows = random_log(seed, 600, ["hot", "hot", "hot", "b", "c", None])
    log = spark.createDataFrame(rows, LOG).repartition(5)
    got = revisions.attempted_writes(log, "k", ["n"], "expected", "verified", ["a", "b"], F.col("ok"))
    assert got.columns[: len(log.columns)] == log.columns
    assert {r.n: (r.current_revision, bool(r.revision_ok), r.time_ok, r.identity_ok, r.accepted) for r in got.collect()} == loop(rows)
    assert revisions.attempted_writes(log.where("false"), "k", ["n"], "expected", "verified", ["a", "b"]).count() == 0


def test_a_hot_key_is_many_pieces(spark):
    """One key: its writes lie in several range partitions, and the long chain of accepted ones runs through all of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log = spark.range(20_000).selectExpr("id AS n", "'one' AS k", "CASE WHEN id % 3 = 1 THEN id ELSE id - (id + 1) DIV 3 END AS expected", "id AS verified", "'x' AS a")
        got = revisions.attempted_writes(log, "k", ["n"], "expected", "verified", ["a"])
        want = sum(1 for n in range(20_000) if n % 3 != 1)
        assert got.where("accepted").count() == want and got.agg(F.max("current_revision")).first()[0] == want
        pieces = got.select(F.spark_partition_id().alias("p")).distinct().count()
        assert pieces > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


DAY = dt.datetime(2026, 1, 1)
ITEMS = "op string, k string, at timestamp, expected long, verified long, published timestamp"


def items(seed):
    rng = random.Random(seed)
    rows, now = [], {}
    for n in range(160):
        k = rng.choice("abcdef")
        at = DAY + dt.timedelta(minutes=45 * n, seconds=rng.randrange(60), microseconds=rng.randrange(10))
        r, first, *_ = now.get(k, (0, at - dt.timedelta(hours=rng.randrange(-1, 26))))
        published = first if rng.random() < 0.8 else at
        expected, verified = rng.choice((r, r, r, r + 1, 0)), rng.choice((n, n, n, n - 9, None))
        fresh = published <= at < published + dt.timedelta(hours=24)
        if fresh and expected == r and published == first and verified is not None and verified >= now.get(k, (0, 0, 0))[-1]:
            now[k] = (r + 1, first, verified)
        rows.append((f"o{n:03}", k, at, expected, verified, published))
    return rows


def values(df):
    return sorted(map(repr, map(tuple, df.select("key", "op", "kind", "reason", "at", "revision", "first_seen", "published").collect())))


@pytest.mark.parametrize("seed", range(2))
def test_stream_restarted_in_the_middle_equals_the_batch(spark, tmp_path, seed):
    rows = items(seed)
    end = DAY + dt.timedelta(days=40)
    schema = spark.createDataFrame([], ITEMS).schema
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rng = random.Random(seed)

    def arrive(part):
        # Within an hour of each other, writes come in any order.
        part = sorted(part, key=lambda r: (r[2] - DAY) // dt.timedelta(hours=1) + rng.random())
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = streams.rolling(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "k", "op", "at", "expected", "verified", "published", lateness="2 hours")
        q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        assert q.awaitTermination(300)

    arrive(rows[:50])
    arrive(rows[50:80])
    run()
    arrive(rows[80:])
    arrive([("end", "zz", end + dt.timedelta(hours=2), 0, 1, None)])
    run()
    batch = revisions.rolling(spark.createDataFrame(rows, schema), "k", "op", "at", "expected", "verified", "published", F.lit(end))
    want = values(batch)
    assert values(spark.read.parquet(out)) == want
    kinds = {r.kind for r in batch.select("kind").distinct().collect()}
    assert kinds == {"first", "update", "refused", "expired"}
