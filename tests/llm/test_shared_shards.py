"""Links that not every shard of both vectors finds, and graphs of many parts."""

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import annlinks


def test_search_enters_every_part_of_a_graph():
    rng = np.random.default_rng(3)
    x = annlinks._unit(np.repeat(rng.normal(size=(20, 16)), 5, axis=0))
    group = np.arange(100) // 5
    flat = np.concatenate([np.flatnonzero(group == g) for g in group])
    q, r = annlinks.range_search(x, (np.arange(101) * 5, flat), x[::5], None, 0.93)
    assert {(g, i) for i, g in enumerate(group.tolist())} <= set(zip(q.tolist(), r.tolist()))


@pytest.mark.parametrize("lost", (True, False))
def test_link_counts_once_in_whichever_shard_finds_it(spark, monkeypatch, lost):
    """Vectors 0 to 9 are in shards 1 and 2, 10 to 29 in shard 2 twice over; the search in shard 1 may find nothing."""
    search, names = annlinks.range_search, annlinks.PLACED.fieldNames()

    def assign(key, vectors, centres):
        ids = vectors["vec_id"].to_pylist()
        homes = [[1, 2] if i < 10 else [2, 3] for i in ids]
        rows = [n for n in range(len(ids)) for _ in range(2)]
        return pa.table([pa.array([key[0].as_py()] * len(rows), pa.int64()), pa.array([key[1].as_py()] * len(rows), pa.int32()), pa.array([h for x in homes for h in x], pa.int64()), vectors["vec_id"].take(rows), vectors["x"].take(rows), pa.array([homes[n] for n in rows], pa.list_(pa.int64()))], names=names)

    def losing(x, *rest):
        q, r = search(x, *rest)
        return (q[:0], r[:0]) if lost and len(x) == 10 else (q, r)

    monkeypatch.setattr(annlinks, "_assign", assign)
    monkeypatch.setattr(annlinks, "range_search", losing)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 12))
    x[5:10], x[10:12] = x[5], x[5]
    df = spark.createDataFrame([(i, x[i].tolist(), 1) for i in range(30)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in annlinks.links(df).collect()}
    assert got == {i: (6, 5) if 5 <= i < 12 else (0, i) for i in range(30)}


@pytest.mark.parametrize("copies", (60, 120))
def test_copies_are_one_node_and_near_copies_count_by_digests(spark, monkeypatch, copies):
    """Copies and near copies of one vector over several shards: counts are those of all pairs, the rows that tasks return those of different vectors."""
    for name, value in (("SHARD_ROWS", 40), ("BLOCK", 30)):
        monkeypatch.setattr(annlinks, name, value)
    written, rows_of = annlinks.store.written, {}

    def watched(df, name, *rest):
        out = written(df, name, *rest)
        rows_of[name] = out[0].count()
        return out

    monkeypatch.setattr(annlinks.store, "written", watched)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 12))
    x[:90] = x[0] + rng.normal(scale=0.02, size=(90, 12))  # different, all near each other
    x = np.concatenate([x, np.repeat(x[:1], copies, axis=0)])
    label = [1] * 200 + [1] * (copies - 5) + [2] * 5
    df = spark.createDataFrame([(i, x[i].tolist(), label[i]) for i in range(len(x))], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(near, False)
    got = {r.vec_id: (r.n_links, r.component_id) for r in annlinks.links(df).collect()}
    head = annlinks.heads(len(x), *np.nonzero(near))
    assert got == {i: (int(near[i].sum()), int(head[i])) for i in range(len(x))}
    assert rows_of["ann-classes"] == 201 and rows_of["ann-links"] <= 201 * annlinks.OVERLAP * 8
