"""Vector operators and components against brute force: ties, repeats, unusable vectors, hot groups."""

import numpy as np
import pytest

from tallyloom.llm import annlinks, vptree
from tallyloom.llm.components import connected

NAN, INF = float("nan"), float("inf")


def table(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 12))
    x[200:260] = x[200] + rng.normal(scale=0.02, size=(60, 12))  # a hot group
    x[50] = x[51] = x[52]
    rows = [(i, x[i].astype(np.float32).tolist(), int(i % 3 if not 200 <= i < 260 else 1)) for i in range(n)]
    rows += [(1000, None, 1), (1001, [0.0] * 12, 1), (1002, [None] + [1.0] * 11, 1), (1003, [NAN] + [1.0] * 11, 1), (1020, [INF] + [1.0] * 11, 1), (1005, rows[1][1], None), (None, rows[1][1], 1), (20, rows[20][1], rows[20][2]), (1040, [], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("x", __import__("pyspark").sql.functions.lit(1)).withColumn("shard", __import__("pyspark").sql.functions.lit(2))


def usable(df):
    out = {}
    for r in df.collect():
        e = r.embedding
        if r.vec_id is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e):
            out[r.vec_id] = (np.array(e, float), r.label)
    return out


def test_vp_tree_is_exact_at_factor_one(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 150)
    df = table(spark)
    good = usable(df)
    ids = sorted(good)
    x = np.stack([good[i][0] for i in ids])
    got = {}
    for r in vptree.nearest(df, k=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in ids if i % 20 == 0}
    for q, found in got.items():
        s = np.add.accumulate(x * good[q][0], axis=1)[:, -1]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:7]
        assert sorted(found) == [(n + 1, ids[k], s[k]) for n, k in enumerate(order)]


def test_vp_tree_relaxed_recall(spark):
    df = table(spark)
    exact, loose = ({(r.query_id, r.vec_id) for r in vptree.nearest(df, k=10, factor=f).collect()} for f in (1.0, 1.3))
    assert len(exact & loose) >= 0.9 * len(exact)


@pytest.mark.parametrize("most", (1024, 2))
def test_links_equal_brute_force(spark, monkeypatch, most):
    """With all labels in one level, and with the larger ones in two."""
    for name, value in (("SHARD_ROWS", 60), ("BLOCK", 40), ("MAX_CENTRES", most)):
        monkeypatch.setattr(annlinks, name, value)
    df = table(spark)
    good = {i: v for i, v in usable(df).items() if v[1] is not None}
    ids = sorted(good)
    u = np.stack([good[i][0] / np.linalg.norm(good[i][0]) for i in ids])
    label = np.array([good[i][1] for i in ids])
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    head = annlinks.heads(len(ids), *np.nonzero(near))
    want = {i: (int(near[k].sum()), ids[head[k]]) for k, i in enumerate(ids)}
    result = annlinks.links(df)
    rows = result.collect()
    assert len(rows) == df.count()
    true = found = 0
    for r in rows:
        n, c = want.get(r.vec_id, (0, r.vec_id))
        assert r.n_links <= n
        true, found = true + n, found + r.n_links
        if r.n_links == n:
            assert r.component_id == c and r.kept == (r.vec_id is None or c == r.vec_id)
    assert found >= 0.97 * true > 0
    assert annlinks.audit(df, result) >= 0.9


def test_empty_vectors(spark):
    none = table(spark, 300).where("false")
    assert vptree.nearest(none).count() == 0 and annlinks.links(none).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(12)] + [(None, 1)]
    head = {x: x for p in e for x in p if None not in p}
    for _ in range(80):
        for a, b in e:
            if a is not None:
                head[a] = head[b] = min(head[a], head[b])
    got = {r.node: r.component for r in connected(spark.createDataFrame(e, "a long, b long")).collect()}
    linked = {x for a, b in e if a is not None and a != b for x in (a, b)}
    assert got == {x: head[x] for x in linked}


def test_leaves_bound_distances_and_clusters_meet_few_queries(spark, monkeypatch):
    """Clustered vectors in many leaves: exact results, though a query is sent to a few leaves only."""
    monkeypatch.setattr(vptree, "SHARD_ROWS", 50)
    written, sent = vptree.store.written, {}

    def watched(df, name, *rest):
        out = written(df, name, *rest)
        sent[name] = out[0].count()
        return out

    monkeypatch.setattr(vptree.store, "written", watched)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(16, 12))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    x = centre[np.arange(1600) % 16] + rng.normal(scale=0.01, size=(1600, 12))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(1600)], "vec_id long, embedding array<double>")
    got = {}
    for r in vptree.nearest(df, k=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids = np.arange(1600)
    for q in range(0, 1600, 20):
        s = np.add.accumulate(x * x[q], axis=1)[:, -1]
        order = [k for k in np.lexsort((ids, -s)) if k != q][:7]
        assert sorted(got[q]) == [(n + 1, k, s[k]) for n, k in enumerate(order)]
    assert sent["vp-first-asked"] == 80 * vptree.FIRST and sent["vp-rest-asked"] < 80 * 32 / 3

    top = vptree.Top(x[rng.choice(1600, 800, replace=False)], 20)
    d = top.distances(x)
    leaf = top.leaves(d)
    rings = {k: [(d[leaf == k][:, n].min(), d[leaf == k][:, n].max()) for n in path] for k, path in enumerate(top.paths) if (leaf == k).any()}
    bound = top.bounds(top.distances(x[:50]), rings)
    away = np.sqrt(((x[:50, None] - x[None]) ** 2).sum(2))
    assert all(bound[q, leaf[i]] <= away[q, i] + 1e-6 for q in range(50) for i in range(1600))
