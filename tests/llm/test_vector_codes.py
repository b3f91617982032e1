"""Filtering Lloyd against plain loops: ties, unusable vectors, blocks, repeats, empty tables."""

import numpy as np
import pytest

from tallyloom.llm import vectorcodes

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, code string, x int, points int"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, c, "", 1, 2) for i, e, c in rows], SCHEMA)


def plain(rows, parts, entries, rounds):
    good = [(i, e, c) for i, e, c in rows if e and all(v is not None and np.isfinite(v) for v in e) and len(e) % parts == 0]
    ints = lambda e: [int(np.floor(256 * np.float64(np.float32(v)))) for v in e]
    good = sorted(((i is None, i or 0, ints(e), i, c) for i, e, c in good), key=lambda g: g[:3])
    good = [g for g in good if len(g[2]) == len(good[0][2])]
    width = len(good[0][2]) // parts
    cut = [[g[2][p * width : (p + 1) * width] for p in range(parts)] for g in good]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b))
    pick = lambda v, p: min((far(v, b), k) for k, b in enumerate(books[p]))
    for _ in range(rounds):
        chosen = [[pick(c[p], p)[1] for c in cut] for p in range(parts)]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, got in zip(cut, chosen[p]) if got == k]
                if own:
                    books[p][k] = [sum(col) // len(own) for col in zip(*own)]
    best = [[pick(c[p], p) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in b) for b in best]
    of = {}
    for g, e in zip(good, error):
        of[g[4]] = of.get(g[4], 0) + e
    digest = vectorcodes.digest(np.array(books))
    return sorted(((g[3], "".join(f"{k:02x}" for _, k in b), e, of[g[4]], digest) for g, b, e in zip(good, best, error)), key=repr)


def rows_of(seed, n=180, dim=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[60:110] = x[3]  # a hot group of equal vectors
    x[:40] = np.round(x[:40] * 2) / 256  # many ties
    out = [(i, x[i].tolist(), int(i % 3) if i % 7 else None) for i in range(n)]
    bad = [(500, None, 1), (501, [None] + [1.0] * (dim - 1), 1), (502, [NAN] * dim, 1), (503, [INF] + [0.0] * (dim - 1), 1), (504, [], 1), (505, [1.0] * (dim - 1), 1), (506, [1.0] * (2 * dim), 1)]
    return [*out, *bad, (507, [0.0] * dim, None), (None, [0.5] * dim, 2), (2, out[5][1], 1), (2, out[2][1], 1), (2, out[2][1], 1)]


@pytest.mark.parametrize("block, leaf, pairs", ((8192, 16, 1 << 18), (50, 3, 40), (7, 1, 1)))
def test_codes_equal_plain_loops(spark, monkeypatch, block, leaf, pairs):
    monkeypatch.setattr(vectorcodes, "BLOCK_ROWS", block)
    monkeypatch.setattr(vectorcodes, "PAIRS", pairs)
    monkeypatch.setattr(vectorcodes.Trees.build.__func__, "__defaults__", (leaf,))
    rows = rows_of(block)
    got = vectorcodes.errors(frame(spark, rows), parts=3, entries=20, rounds=2).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, 3, 20, 2)


def test_fewer_vectors_than_entries_and_none(spark):
    rows = rows_of(1)[:5]
    assert sorted(map(tuple, vectorcodes.errors(frame(spark, rows), parts=4).collect()), key=repr) == plain(rows, 4, 64, 2)
    assert vectorcodes.errors(frame(spark, rows).where("false")).count() == 0
    assert vectorcodes.errors(frame(spark, [(1, None, 1)])).count() == 0


def test_nodes_go_to_an_entry_as_a_whole():
    """Clusters far from each other: most points are never compared with an entry, and cached sums are those of points."""
    rng = np.random.default_rng(0)
    centre = rng.integers(-4000, 4000, (8, 8))
    x = centre[rng.integers(0, 8, 4000)] + rng.integers(-20, 20, (4000, 8))
    tree = vectorcodes.Trees.build(x, 2)
    books = centre.reshape(8, 2, 4).transpose(1, 0, 2)
    nodes, _ = tree.filtered(books)
    assert sum(int((b - a).sum()) for _, a, b, _ in nodes) > 0.9 * 2 * 4000
    n, total = tree.totals(books)
    entry, error = tree.assigned(books)
    for p in range(2):
        part = x[:, 4 * p : 4 * p + 4]
        d = ((part[:, None] - books[p]) ** 2).sum(2)
        assert (entry[:, p] == d.argmin(1)).all() and (error[:, p] == d.min(1)).all()
        for k in range(8):
            assert n[p, k] == (entry[:, p] == k).sum() and (total[p, k] == part[entry[:, p] == k].sum(0)).all()


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="is above"):
        vectorcodes.errors(frame(spark, [(1, [1e9] * 16, 1)])).count()
