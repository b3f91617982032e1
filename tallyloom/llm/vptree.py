"""Approximate nearest neighbours by vantage-point trees, one per shard, in shards by distance.

Largest inner product becomes least distance in one more dimension: with M the
largest norm, ``x' = (x, sqrt(M^2 - |x|^2))`` and ``q' = (q, 0)`` give
``|q' - x'|^2 = |q|^2 + M^2 - 2 q.x``. A tree splits a shard at the median distance
from a vantage point, and a subtree is left out where the triangle inequality puts
it further than the k-th best so far. ``factor`` relaxes that: a subtree goes when
``factor * bound`` exceeds the k-th distance, so 1 is exact search and larger values
prune more. Queries walk a tree together, a block at a time.

Shards are the leaves of one more such tree, the top, over a hashed sample of at most ``TOP_SAMPLE`` vectors (a leaf for ``SHARD_ROWS`` of
all vectors, ``TOP_LEAVES`` at most). All vectors go down it, and each leaf keeps the least and greatest distance of its vectors from every
vantage point above it. A query is answered first in the ``FIRST`` leaves that may hold its nearest; its k-th distance there then shows which
other leaves it must see, by the same inequality and ``factor``. So where vectors lie in clusters a query meets a few leaves, however many there are; where all are
as far from each other, no bound can part them and it meets most.

A pair of a part of a leaf's vectors and a part of its queries is a task of bounded size. A query's
best of every leaf are merged by rank; final scores are summed in double precision,
component by component, on the original vectors.

Defined cases. A vector that is null, zero, empty, or holds a null or a non-finite
component takes no part. A null id takes no part. Rows repeated under one id are one
vector (the least, as arrays compare). Vectors of another length than the query's
are no candidates. Fewer candidates than ``k``: all. Empty table: no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import store

SHARD_ROWS = 8192
QUERY_ROWS = 4096
LEAF = 96
TOP_LEAVES = 4096
#: Sampled vectors, and how many of them a leaf of the top has.
TOP_SAMPLE, TOP_ROWS = 1 << 16, 16
FIRST = 2
_SLACK = 1e-9

FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def usable(x: str) -> Column:
    """True for a vector that can take part."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x, dim): one usable vector an id."""
    good = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & usable("x"))
    return good.groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("dim", F.size("x"))


class Tree:
    """A vantage-point tree over rows of ``points``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 5):
        self.points, self.leaf, self.rng = points, leaf, np.random.default_rng(seed)
        self.nodes: list[tuple] = []  # (rows,) for a leaf, else (vantage, inner, outer, limits of distances)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        if len(rows) > self.leaf:
            v = rows[self.rng.integers(len(rows))]
            d = np.sqrt(((self.points[rows] - self.points[v]) ** 2).sum(1))
            order = np.argsort(d, kind="stable")
            half = len(rows) // 2
            if d[order[0]] < d[order[-1]]:
                rows, d = rows[order], d[order]
                made = (v, self._build(rows[:half]), self._build(rows[half:]), (d[0], d[half - 1], d[half], d[-1]))
                self.nodes.append(made)
                return len(self.nodes) - 1
            # All are as far from the vantage point: halves by place, which no bound can part.
            limits = (d[order[0]], d[order[-1]]) * 2
            self.nodes.append((v, self._build(rows[:half]), self._build(rows[half:]), limits))
            return len(self.nodes) - 1
        self.nodes.append((rows,))
        return len(self.nodes) - 1


def search(tree: Tree, plain: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float, top2: float):
    """(query row, point row) of all that may be among each query's k best."""
    n = len(queries)
    norm2 = (queries**2).sum(1)
    best = np.full((n, k), -np.inf)
    tau = np.full(n, np.inf)
    wide = np.hstack([queries, np.zeros((n, 1))])
    kept_q, kept_p, kept_s = [], [], []
    scale = np.sqrt(norm2 * top2) * 1e-12 + 1e-300

    def leaf(rows: np.ndarray, q: np.ndarray) -> None:
        s = queries[q] @ plain[rows].T
        s[query_ids[q][:, None] == ids[rows][None, :]] = -np.inf
        both = np.concatenate([best[q], s], axis=1)
        best[q] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        kth = best[q].min(1)
        some = kth > -np.inf
        tau[q[some]] = np.sqrt(np.maximum(norm2[q[some]] + top2 - 2 * kth[some], 0))
        a, b = np.nonzero(s >= (kth - scale[q])[:, None])
        ok = s[a, b] > -np.inf
        kept_q.append(q[a[ok]])
        kept_p.append(rows[b[ok]])
        kept_s.append(s[a[ok], b[ok]])

    def walk(at: int, q: np.ndarray) -> None:
        if not len(q):
            return
        node = tree.nodes[at]
        if len(node) == 1:
            leaf(node[0], q)
            return
        v, inner, outer, (a1, b1, a2, b2) = node
        d = np.sqrt(np.maximum(((wide[q] - tree.points[v]) ** 2).sum(1), 0))
        near = np.maximum(np.maximum(d - b1, a1 - d), 0)
        far = np.maximum(np.maximum(d - b2, a2 - d), 0)
        first = d <= (b1 + a2) / 2  # each half goes to its nearer child first
        for own, child, bound in ((first, inner, near), (~first, outer, far)):
            walk(child, q[own & (bound * factor <= tau[q] + _SLACK)])
        for own, child, bound in ((~first, inner, near), (first, outer, far)):
            walk(child, q[own & (bound * factor <= tau[q] + _SLACK)])

    walk(tree.root, np.arange(n))
    q, p, s = np.concatenate(kept_q), np.concatenate(kept_p), np.concatenate(kept_s)
    ok = s >= best.min(1)[q] - scale[q]
    return q[ok], p[ok]


def _column(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    x = batch[name]
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


class Top:
    """The tree that deals vectors of one length to leaves: vantage points and the distances at which they split."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vantage, self.split, self.child, self.paths = [], [], [], []
        self.root = self._build(sample, leaves, rng, [])
        self.vantage = np.array(self.vantage).reshape(len(self.vantage), sample.shape[1])
        self.depth = max(map(len, self.paths), default=0)

    def _build(self, rows: np.ndarray, leaves: int, rng, path: list[int]) -> int:
        """The node's number, or -1 - leaf."""
        if leaves > 1 and len(rows) >= 2 * TOP_ROWS:
            v = rows[rng.integers(len(rows))]
            d = np.sqrt(((rows - v) ** 2).sum(1))
            half = np.partition(d, len(d) // 2)[len(d) // 2]
            if (d < half).any():
                at = len(self.vantage)
                self.vantage.append(v)
                self.split.append(half)
                self.child.append(None)
                inner = self._build(rows[d < half], (leaves + 1) // 2, rng, [*path, at])
                outer = self._build(rows[d >= half], leaves // 2, rng, [*path, at])
                self.child[at] = (inner, outer)
                return at
        self.paths.append(path)
        return -len(self.paths)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """From each row (lifted) to each vantage point."""
        if not len(self.vantage):
            return np.zeros((len(x), 0))
        square = (x**2).sum(1)[:, None] + (self.vantage**2).sum(1)[None, :] - 2 * (x @ self.vantage.T)
        return np.sqrt(np.maximum(square, 0))

    def leaves(self, d: np.ndarray) -> np.ndarray:
        """The leaf of each row, by its distances."""
        at = np.full(len(d), self.root)
        while (at >= 0).any():
            for node in np.unique(at[at >= 0]):
                own = np.flatnonzero(at == node)
                inner, outer = self.child[node]
                at[own] = np.where(d[own, node] < self.split[node], inner, outer)
        return -1 - at

    def bounds(self, d: np.ndarray, rings: dict[int, list[tuple[float, float]]]) -> np.ndarray:
        """What each query is away from each leaf's vectors at least; infinite for a leaf without any."""
        out = np.full((len(d), len(self.paths)), np.inf)
        for leaf, path in enumerate(self.paths):
            if leaf in rings:
                out[:, leaf] = 0
                for node, (low, high) in zip(path, rings[leaf]):
                    out[:, leaf] = np.maximum(out[:, leaf], np.maximum(low - d[:, node], d[:, node] - high))
        return out


def nearest(df: DataFrame, k: int = 20, query_modulus: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest, ties to the smaller id. Queries: ids divisible by the modulus."""
    spark = df.sparkSession
    all_, all_path = store.written(vectors(df, id_col, vector_col), "vp-vectors")
    norm2 = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    about = all_.agg(F.count("*").alias("n"), F.max(norm2).alias("top2")).first()
    if not about.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top2 = float(about.top2) * (1 + 1e-12)

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(top2 - (x**2).sum(1), 0))[:, None]])

    # A bounded sample, to the driver: the vectors of least hash.
    sizes = {r.dim: r.n for r in all_.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    leaves = {dim: min(TOP_LEAVES, -(-n // SHARD_ROWS)) for dim, n in sizes.items()}
    sampled: dict[int, list] = {}
    if max(leaves.values()) > 1:
        wanted = min(TOP_SAMPLE, 2 * TOP_ROWS * sum(leaves.values()))
        for r in all_.orderBy(F.xxhash64(F.lit(11), "vec_id"), "vec_id").select("dim", "x").limit(wanted).collect():
            sampled.setdefault(r.dim, []).append(r.x)
    tops = {dim: Top(lifted(np.array(sampled[dim])) if dim in sampled else np.zeros((0, dim + 1)), n) for dim, n in leaves.items()}

    placed_kind = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("leaf", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("away", T.ArrayType(T.DoubleType()))])

    def by_length(batch: pa.RecordBatch):
        dims = batch["dim"].to_numpy()
        for dim in np.unique(dims):
            yield int(dim), batch.take(pa.array(np.flatnonzero(dims == dim)))

    def placed(batches):
        for batch in batches:
            for dim, part in by_length(batch):
                top = tops[dim]
                d = top.distances(lifted(_column(part, "x")))
                leaf = top.leaves(d)
                away = [d[i, top.paths[k]].tolist() for i, k in enumerate(leaf)]
                yield pa.RecordBatch.from_arrays([part["dim"], pa.array(leaf, pa.int32()), part["vec_id"], part["x"], pa.array(away, pa.list_(pa.float64()))], names=placed_kind.fieldNames())

    spread, placed_path = store.written(all_.mapInArrow(placed, placed_kind), "vp-placed")
    deepest = max(t.depth for t in tops.values())
    ring = [f(F.get("away", F.lit(i))).alias(f"{name}{i}") for i in range(deepest) for name, f in (("low", F.min), ("high", F.max))]
    stats = spread.groupBy("dim", "leaf").agg(F.count("*").alias("n"), *ring).collect()  # a row a leaf
    # Distances are rounded twice, once here and once for queries.
    rings: dict[int, dict[int, list]] = {}
    for r in stats:
        known = len(tops[r.dim].paths[r.leaf])
        rings.setdefault(r.dim, {})[r.leaf] = [(r[f"low{i}"] - 1e-6 * (1 + top2**0.5), r[f"high{i}"] + 1e-6 * (1 + top2**0.5)) for i in range(known)]
    parts = {(r.dim, r.leaf): -(-r.n // SHARD_ROWS) for r in stats}

    asked_kind = T.StructType([T.StructField(c, T.IntegerType()) for c in ("dim", "leaf", "parts")] + [T.StructField("vec_id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def routed(later: bool):
        """Queries with the leaves that they are sent to: the first ones, or what their k-th distance leaves open."""

        def go(batches):
            for batch in batches:
                for dim, part in by_length(batch):
                    x = _column(part, "x")
                    for a in range(0, len(x), 1024):
                        q = x[a : a + 1024]
                        bound = tops[dim].bounds(tops[dim].distances(np.hstack([q, np.zeros((len(q), 1))])), rings[dim])
                        order = np.argsort(bound, axis=1, kind="stable")[:, :FIRST]
                        send = np.zeros(bound.shape, dtype=bool)
                        np.put_along_axis(send, order, True, 1)
                        send &= bound < np.inf
                        if later:
                            kth = part["kth"].to_numpy(zero_copy_only=False).astype(float)[a : a + 1024]
                            tau = np.sqrt(np.maximum((q**2).sum(1) + top2 - 2 * kth, 0))
                            tau[np.isnan(kth)] = np.inf
                            send = ~send & (bound < np.inf) & (bound * factor <= tau[:, None] + _SLACK)
                        r, leaf = np.nonzero(send)
                        rows = part.take(pa.array(a + r))
                        n = [parts[dim, int(k)] for k in leaf]
                        yield pa.RecordBatch.from_arrays([rows["dim"], pa.array(leaf, pa.int32()), pa.array(n, pa.int32()), rows["vec_id"], rows["x"]], names=asked_kind.fieldNames())

        return go

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=FOUND.fieldNames())
        ids, qids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        plain, qs = (t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (left, right))
        order = np.argsort(ids)
        ids, plain = ids[order], plain[order]
        lift = np.sqrt(np.maximum(top2 - (plain**2).sum(1), 0))
        q, p = search(Tree(np.hstack([plain, lift[:, None]])), plain, ids, qs, qids, k, factor, top2)
        score = np.zeros(len(q))
        for a in range(0, len(q), 1 << 16):
            z = slice(a, a + (1 << 16))
            score[z] = np.add.accumulate(qs[q[z]] * plain[p[z]], axis=1)[:, -1]
        order = np.lexsort((ids[p], -score, q))
        q, p, score = q[order], p[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        top = place < k
        return pa.table([pa.array(qids[q[top]]), pa.array(ids[p[top]]), pa.array(score[top])], names=FOUND.fieldNames())

    def answered(queries: DataFrame, later: bool, name: str) -> tuple[DataFrame, str]:
        asked, path = store.written(queries.mapInArrow(routed(later), asked_kind), f"{name}-asked")
        leaf = ["dim", "leaf"]
        per = asked.groupBy(*leaf).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"), F.max("parts").alias("parts"))
        q = spark.read.schema(asked.schema).parquet(path).join(per.drop("parts"), leaf)
        q = q.select(*leaf, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "x")
        p = spark.read.schema(spread.schema).parquet(placed_path).join(per, leaf)
        p = p.select(*leaf, F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "x")
        task = [*leaf, "part", "block"]
        out, found_path = store.written(p.groupBy(*task).cogroup(q.groupBy(*task)).applyInArrow(run, FOUND), f"{name}-found")
        store.remove(spark, path)
        return out, found_path

    queries = all_.where(F.col("vec_id") % query_modulus == 0).select("dim", "vec_id", "x")
    found, first_path = answered(queries, False, "vp-first")
    if any(len(t.paths) > FIRST for t in tops.values()):
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        kth = found.withColumn("r", rank).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
        again = spark.read.schema(all_.schema).parquet(all_path).where(F.col("vec_id") % query_modulus == 0).select("dim", "vec_id", "x").join(kth, "vec_id", "left")
        rest, _ = answered(again, True, "vp-rest")
        found = spark.read.schema(found.schema).parquet(first_path).unionByName(rest)
    store.remove(spark, placed_path, all_path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
