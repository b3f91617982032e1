"""Overlaps by heavy keys and by pairs give the same counts; audits by digests the same rows as both ways of EXCEPT ALL."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import audit, matching, state


def rows(seed, n, side):
    rng = random.Random(seed)
    return [(f"{side}{i}", rng.choice(["hot", "hot", "warm", f"u{rng.randrange(40)}", None]), [rng.choice(["big", f"t{rng.randrange(30)}", ""]) for _ in range(rng.randrange(3))], rng.choice(["all", f"m{rng.randrange(9)}"])) for i in range(n)]


@pytest.mark.parametrize("heavy_from", (1, 8, 60, 10_000))
def test_counts_equal_pairs(spark, heavy_from):
    keys = {"url": F.array("url"), "title": F.col("titles"), "media": F.array("media")}
    schema = "id string, url string, titles array<string>, media string"
    c, h = (spark.createDataFrame(rows(seed, n, s), schema) for seed, n, s in ((1, 90, "c"), (2, 120, "h")))
    ck, hk = matching.key_rows(c, "id", keys), matching.key_rows(h, "id", keys)
    for identity in (["url"], ["title", "media"]):
        pairs = matching.compare_history(ck, hk, identity)
        want = {r.id: (r.n_matches, r.n_same) for r in matching.annotate(c.select("id"), "id", pairs).collect()}
        got = {r.row_id: (r.n_matches, r.n_same) for r in matching.overlap_counts(ck, hk, identity, heavy_from).collect()}
        assert got == {k: v for k, v in want.items() if v[0]}
    assert matching.overlap_counts(ck, hk.where("false"), ["url"], heavy_from).count() == 0


def test_a_hot_key_makes_no_pairs(spark):
    """3000 rows on both sides share a key: nine million pairs, which no plan node makes."""
    one = spark.range(3000).selectExpr("CAST(id AS STRING) AS row_id", "'topic' AS field", "'hot' AS value")
    got = matching.overlap_counts(one, one, ["topic"], heavy_from=100)
    assert {(r.n_matches, r.n_same) for r in got.collect()} == {(3000, 3000)}


def changed(spark, seed):
    rng = random.Random(seed)
    data = [(rng.choice([None, *range(300)]), rng.choice("abc"), rng.choice([None, 0.5, 1.5])) for _ in range(900)]
    other = [r for r in data if rng.random() > 0.01] + data[:3] + [(301, "z", None)]
    other = [(k, v, 9.0 if rng.random() < 0.005 else x) for k, v, x in other]
    schema = "k int, v string, x double"
    return spark.createDataFrame(data, schema), spark.createDataFrame(other, schema).select("x", "k", "v")


@pytest.mark.parametrize("seed", range(2))
def test_audit_equals_drift(spark, seed):
    a, b = changed(spark, seed)
    want = sorted(map(repr, map(tuple, state.drift(a, b.select(*a.columns)).collect())))
    assert want and sorted(map(repr, map(tuple, audit.drift(a, b, ["k"]).collect()))) == want
    tree = audit.digest_tree(a, ["k"])
    assert sorted(map(repr, map(tuple, audit.drift(a, b, ["k"], stored_tree=tree).collect()))) == want
    assert audit.drift(a, a.repartition(3), ["k"]).count() == 0 and audit.drift(a.where("false"), a.where("false"), ["k"]).count() == 0
    assert audit.drift(a, a.where("false"), ["k"]).count() == a.count()


def test_only_ranges_that_differ_are_read(spark):
    a = spark.range(50_000).selectExpr("id AS k", "id % 7 AS v")
    b = a.withColumn("v", F.when(F.col("k").isin(77, 4711), -1).otherwise(F.col("v")))
    tree = audit.digest_tree(a, ["k"])
    assert tree.groupBy("level").count().orderBy("level").collect()[0]["count"] == 1 and tree.count() <= 1 + 16 + 256 + 4096
    ranges = audit.differing(tree, audit.digest_tree(b, ["k"]))
    assert 1 <= ranges.count() <= 2
    assert sorted((r.k, r.v, r.side) for r in audit.drift(a, b, ["k"]).collect()) == [(77, -1, "derived"), (77, 0, "stored"), (4711, -1, "derived"), (4711, 0, "stored")]
