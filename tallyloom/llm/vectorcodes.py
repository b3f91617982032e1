"""Vector codes: product quantisation with codebooks trained by filtering Lloyd rounds.

Components become integers (``floor(scale * x)``), so distances, sums and ties are exact and results do not
depend on how rows are dealt. Vectors are cut into equal parts; each part position has a codebook.

1. Each partition sorts its vectors, a block of at most ``BLOCK_ROWS`` at a time, into one kd-tree a part
   position: halves at the median of the widest dimension down to ``LEAF`` points. Blocks are written once,
   points in tree order; boxes and cached sums of nodes follow from them by one pass each.
2. A round sends all codebooks (parts * entries, a fixed size) to the blocks. From the roots down, a node
   keeps the entries that can be nearest to some point of its box: with z the entry nearest to the box's middle,
   another entry goes if even the box's corner that lies furthest its way is nearer to z (or as near, and z has the
   lower index). A node with one entry left gives its cached sum and count to it as a whole; leaves compare points with
   the entries left. Tasks return a row for each part and entry at most, which Spark adds up.
3. The last pass fills whole node ranges with their entry and computes each point's exact distance.

Defined cases. A vector that is null, empty, or holds a null or a non-finite component is dropped, and so is one
whose length differs from that of the first kept one (least id) or is not a multiple of ``parts``. Zero vectors are
kept. Rows repeated under one id are a row each, and entries each; entries of one id are taken in the order of their
components. A null id is kept, sorts last, and stays null. Ties go to the lower index; an entry without points stays. Fewer vectors than
entries: as many entries as vectors. Null labels are one label. Empty table: no rows. Other columns are dropped.
A component above ``LARGEST`` is an error, as sums might leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import store
from tallyloom.llm.vectext import ragged

BLOCK_ROWS = 8192
LEAF = 16
LARGEST = 1 << 24
#: Pairs of a leaf's point and an entry that are compared at once, about.
PAIRS = 1 << 18

SUMS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.LongType()))])


def whole(x: str) -> Column:
    """True for a vector without null or non-finite components."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(x) > 0) & ~bad, F.lit(False))


class Trees:
    """kd-trees over the parts of some rows, one a part position, all of one shape.

    ``points``: (parts, rows, width), in tree order; ``order``: the row of each point. Level d
    has 2**d nodes, the ranges between ``limits[d]``.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, leaf: int = LEAF):
        self.points, self.order = points, order
        self.parts, self.rows, self.width = points.shape
        self.limits = [np.array([0, self.rows])]
        while np.diff(self.limits[-1]).max() > leaf:
            a = self.limits[-1]
            self.limits.append(np.insert(a, np.arange(1, len(a)), (a[:-1] + a[1:]) // 2))
        self.sums = np.zeros((self.parts, self.rows + 1, self.width), np.int64)
        np.cumsum(points, axis=1, out=self.sums[:, 1:])

    @classmethod
    def build(cls, x: np.ndarray, parts: int, leaf: int = LEAF) -> Trees:
        """The trees of rows ``x``: level by level, each node's range is sorted along its widest dimension."""
        n = len(x)
        points = np.ascontiguousarray(x.reshape(n, parts, -1).transpose(1, 0, 2))
        order = np.tile(np.arange(n), (parts, 1))
        tree = cls(points, order, leaf)
        for limits in tree.limits[:-1]:
            node = np.repeat(np.arange(len(limits) - 1), np.diff(limits))
            low, high = np.minimum.reduceat(tree.points, limits[:-1], axis=1), np.maximum.reduceat(tree.points, limits[:-1], axis=1)
            widest = (high - low).argmax(2)
            for p in range(parts):
                along = np.take_along_axis(tree.points[p], widest[p][node][:, None], 1)[:, 0]
                by = np.lexsort((along, node))
                tree.points[p], tree.order[p] = tree.points[p][by], tree.order[p][by]
        return cls(tree.points, tree.order, leaf)

    def filtered(self, books: np.ndarray) -> tuple[list[tuple], list[tuple]]:
        """What of the trees goes to which entry of ``books`` (parts, entries, width).

        Whole nodes: (part, start, end, entry) arrays; points of leaves: (part, place, entry)."""
        entries = books.shape[1]
        index = np.arange(entries)
        nodes, leaves = [], []
        part, at = np.arange(self.parts), np.zeros(self.parts, np.int64)
        open_ = np.ones((self.parts, entries), dtype=bool)
        for depth, limits in enumerate(self.limits):
            if not len(part):
                break
            start, end = limits[at], limits[at + 1]
            low, high = np.minimum.reduceat(self.points, limits[:-1], axis=1)[part, at], np.maximum.reduceat(self.points, limits[:-1], axis=1)[part, at]
            z = books[part]  # (nodes, entries, width)
            far = ((2 * z - (low + high)[:, None]) ** 2).sum(2)
            far[~open_] = np.iinfo(np.int64).max
            best = far.argmin(1)
            zb = books[part, best][:, None]
            corner = np.where(z > zb, high[:, None], low[:, None])
            more = ((z - corner) ** 2).sum(2) - ((zb - corner) ** 2).sum(2)
            open_ &= (more < 0) | ((more == 0) & (index <= best[:, None]))
            one = open_.sum(1) == 1
            nodes.append((part[one], start[one], end[one], best[one]))
            part, at, open_ = part[~one], at[~one], open_[~one]
            if depth + 1 < len(self.limits):
                part, at, open_ = np.repeat(part, 2), np.repeat(2 * at, 2) + np.tile([0, 1], len(at)), np.repeat(open_, 2, axis=0)
            else:
                count, left = np.diff(limits)[at], open_.sum(1)
                flat = np.nonzero(open_)[1]
                first = np.cumsum(left) - left
                cut = np.searchsorted(np.cumsum(count * left), np.arange(0, int((count * left).sum()) + PAIRS, PAIRS))
                for a, b in zip(cut[:-1], cut[1:]):
                    # Each point of these leaves with each entry left to its leaf, in the order of entries.
                    node = np.repeat(np.arange(a, b), count[a:b])
                    place = ragged(limits[at[a:b]], count[a:b])
                    if not len(place):
                        continue
                    pair = np.repeat(np.arange(len(place)), left[node])
                    entry = flat[ragged(first[node], left[node])]
                    d = ((self.points[part[node], place][pair] - books[part[node][pair], entry]) ** 2).sum(1)
                    begin = np.cumsum(left[node]) - left[node]
                    near = np.flatnonzero(d == np.minimum.reduceat(d, begin)[pair])
                    near = near[np.searchsorted(pair[near], np.arange(len(place)))]
                    leaves.append((part[node], place, entry[near]))
        return nodes, leaves

    def totals(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (parts, entries) and sums (parts, entries, width): of whole nodes from the cache."""
        n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        nodes, leaves = self.filtered(books)
        for p, a, b, e in nodes:
            np.add.at(n, (p, e), b - a)
            np.add.at(total, (p, e), self.sums[p, b] - self.sums[p, a])
        for p, place, e in leaves:
            np.add.at(n, (p, e), 1)
            np.add.at(total, (p, e), self.points[p, place])
        return n, total

    def assigned(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each row's parts, (rows, parts) each."""
        entry = np.zeros((self.parts, self.rows), np.int64)
        nodes, leaves = self.filtered(books)
        for p, a, b, e in nodes:
            entry[np.repeat(p, b - a), ragged(a, b - a)] = np.repeat(e, b - a)
        for p, place, e in leaves:
            entry[p, place] = e
        part = np.arange(self.parts)[:, None]
        far = ((self.points - books[part, entry]) ** 2).sum(2)
        out, error = np.empty_like(entry), np.empty_like(far)
        out[part, self.order], error[part, self.order] = entry, far
        return out.T, error.T


def _tree_of(row: dict, parts: int) -> Trees:
    n = len(row["vec_id"])
    return Trees(np.frombuffer(row["points"], "<i4").reshape(parts, n, -1).astype(np.int64), np.frombuffer(row["places"], "<u2").reshape(parts, n).astype(np.int64))


def _blocks(df: DataFrame, scale: float, dim: int, parts: int) -> DataFrame:
    """A row a block: ids, labels, and the trees' points and order."""
    label = df.schema["label"].dataType
    kind = T.StructType([T.StructField("vec_id", T.ArrayType(T.LongType())), T.StructField("label", T.ArrayType(label)), T.StructField("points", T.BinaryType()), T.StructField("places", T.BinaryType())])

    def made(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        x = np.floor(scale * t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
        if np.abs(x).max() > LARGEST:
            raise ValueError(f"a component times {scale} is above {LARGEST}")
        tree = Trees.build(x.astype(np.int64), parts)
        lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t[c].combine_chunks()) for c in ("vec_id", "label")]
        return pa.RecordBatch.from_arrays([*lists, *(pa.array([a.tobytes()], pa.binary()) for a in (tree.points.astype("<i4"), tree.order.astype("<u2")))], names=kind.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                if held and n + part.num_rows > BLOCK_ROWS:
                    yield made(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield made(held)

    return df.mapInArrow(run, kind)


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                one = _tree_of(batch.slice(i, 1).to_pylist()[0], parts).totals(books)
                n += one[0]
                total += one[1]
        p, e = np.nonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), pa.array(total[p, e].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), lists], names=SUMS.fieldNames())

    total = F.array(*[F.sum(F.col("total")[i]) for i in range(width)])
    out = books.copy()
    # A row for each part and entry at most.
    for r in blocks.select("vec_id", "points", "places").mapInArrow(run, SUMS).groupBy("part", "entry").agg(F.sum("n").alias("n"), total.alias("total")).collect():
        out[r.part, r.entry] = [t // r.n for t in r.total]
    return out


def compress(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error), a row a kept vector; and the codebooks (parts, entries, width), None if no vector is kept."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part")
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x")).where(whole("x"))
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", rows.schema["label"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    first = rows.where(F.size("x") % parts == 0).orderBy(F.col("vec_id").asc_nulls_last(), F.transform("x", lambda v: F.floor(scale * v))).select("x").limit(1).collect()
    if not first:
        return spark.createDataFrame([], kind), None
    dim = len(first[0].x)
    rows = rows.where(F.size("x") == dim)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), F.transform("x", lambda v: F.floor(scale * v))).select("x").limit(entries).collect()
    books = np.floor(scale * np.array([r.x for r in first])).astype(np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    blocks, path = store.written(_blocks(rows, scale, dim, parts), "code-blocks")
    for _ in range(rounds):
        books = _round(blocks, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                entry, far = _tree_of(row.select(["vec_id", "points", "places"]).to_pylist()[0], parts).assigned(books)
                digits = entry.astype(np.uint8).tobytes().hex()
                code = pa.array([digits[k : k + 2 * parts] for k in range(0, len(digits), 2 * parts)], pa.string())
                yield pa.RecordBatch.from_arrays([row["vec_id"].flatten(), row["label"].flatten(), code, pa.array(far.sum(1))], names=kind.fieldNames())

    return blocks.mapInArrow(run, kind), books


def digest(books: np.ndarray) -> str:
    """The entries' decimal components by part, entry and place, comma-joined, as a lowercase hex sha256."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def errors(df: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): errors are summed over equal labels, nulls together."""
    spark = df.sparkSession
    codes, books = compress(df, **options)
    codes, _ = store.written(codes, "codes")
    # A row a label, summed before the shuffle; Spark broadcasts it only if the written table is small.
    totals, _ = store.written(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "code-errors")
    out = codes.join(totals, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit("" if books is None else digest(books)).alias("codebooks_sha256"))
