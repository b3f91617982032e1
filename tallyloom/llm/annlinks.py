"""Embedding near-dedup on a robust-pruned flat graph.

1. Per label, centres are a hashed sample of its vectors, one for ``SHARD_ROWS`` of them;
   each vector joins the shards of its ``OVERLAP`` nearest centres. A label with more than
   ``MAX_CENTRES`` centres is dealt in two levels: to the nearest of ``MAX_CENTRES`` coarse
   centres at most, and there to the nearest centres. Shards above ``BLOCK`` rows are dealt
   to blocks, and each pair of blocks is a task, so a hot shard is many tasks.
2. In each block the candidates of a vector are pruned robustly (a neighbour is
   dropped if one kept before is ``ALPHA`` times nearer to it), and the adjacency
   lists of a vector from all its shards are united.
3. In each task a range-expanding greedy search runs for all vectors at once from
   the block's medoids, a row of each further part of its graph (and from a vector's
   own node where it is in the block): the best open nodes of a beam and every node
   within the range are expanded.
4. Links found are verified by cosine in double precision. A link found in any shard
   that both vectors share counts, and counts once: in the first of their shared shards.
   Of links that another shared shard could find too, each task also returns, by vector and pair of
   shards, the exclusive or of the links' hashes. Where these agree, all shards found the same links; only for a
   vector where they don't, the partners' ids are returned by a second search, and united.
5. Tasks return counts, those digests and a local class per vector, so their rows grow with the
   vectors, not with the links; classes are joined to components. :func:`audit` measures recall against brute force.

Equal vectors of a label are one node that weighs as many: they all link with each other, and a link of the node is one of each
of them. So a group of copies, however large, costs what one vector does.

Defined cases. A vector that is null, zero, empty, holds a null or a non-finite
component, or has a null label links with nothing: 0 links, its own class. A null
id: null class, kept. Rows repeated under one id are one vector (least label, then
least array) and a row of the result each. Vectors of different length never link.
Among equally near centres or neighbours the one of the smaller id comes first. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import store
from tallyloom.llm.components import connected, heads
from tallyloom.llm.vectext import mix, ragged
from tallyloom.llm.vptree import usable

SHARD_ROWS = 512
MAX_CENTRES = 1024
SALT_ROWS = 4096
OVERLAP = 3
BLOCK = 1536
DEGREE = 24
POOL = 64
ALPHA = 1.2
BEAM = 12
MEDOIDS = 8

PLACED = T.StructType([T.StructField("label", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("shard", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("homes", T.ArrayType(T.LongType()))])
ADJACENT = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("near", T.ArrayType(T.LongType()))])
#: Of a vector with its shards in order: links within one shard, links first shared here, digests for the first and second, first and third, second and third.
LINKED = T.StructType([T.StructField(c, T.LongType()) for c in ("vec_id", "n_links", "n_first", "first_second", "first_third", "second_third", "head")])
DIGESTS = ("first_second", "first_third", "second_third")
PARTNERS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("also", T.ArrayType(T.LongType()))])


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _assign(key: tuple[pa.Scalar, ...], vectors: pa.Table, centres: pa.Table) -> pa.Table:
    n = vectors.num_rows
    label, dim = key[0].as_py(), key[1].as_py()
    if not n:
        return pa.table([pa.array([], f) for f in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()))], names=PLACED.fieldNames())
    if centres.num_rows:
        ids = centres["vec_id"].to_numpy()
        order = np.argsort(ids)
        ids, c = ids[order], _unit(_matrix(centres["x"])[order])
        near = np.argsort(-(_unit(_matrix(vectors["x"])) @ c.T), axis=1, kind="stable")[:, :OVERLAP]
        homes = np.sort(ids[near], axis=1)
    else:
        homes = np.zeros((n, 1), np.int64)
    m = homes.shape[1]
    rows = pa.array(np.repeat(np.arange(n), m))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * m, pa.int32()), pa.array(homes.reshape(-1)))
    return pa.table([pa.array(np.full(n * m, label)), pa.array(np.full(n * m, dim), pa.int32()), pa.array(homes.reshape(-1)), vectors["vec_id"].take(rows), vectors["x"].take(rows), lists.take(rows)], names=PLACED.fieldNames())


NEAREST = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("found", T.ArrayType(T.StructType([T.StructField("far", T.DoubleType()), T.StructField("home", T.LongType())])))])


def _nearest(key: tuple[pa.Scalar, ...], vectors: pa.Table, centres: pa.Table) -> pa.Table:
    """Each vector's ``OVERLAP`` nearest of a part of the centres, with minus their cosine."""
    n = vectors.num_rows if centres.num_rows else 0
    kind = pa.list_(pa.struct([("far", pa.float64()), ("home", pa.int64())]))
    if not n:
        return pa.table([pa.array([], pa.int64()), pa.array([], kind)], names=NEAREST.fieldNames())
    ids = centres["vec_id"].to_numpy()
    order = np.argsort(ids)
    ids, c = ids[order], _unit(_matrix(centres["x"])[order])
    far = -(_unit(_matrix(vectors["x"])) @ c.T)
    near = np.argsort(far, axis=1, kind="stable")[:, :OVERLAP]
    found = pa.StructArray.from_arrays([pa.array(np.take_along_axis(far, near, 1).reshape(-1)), pa.array(ids[near].reshape(-1))], names=["far", "home"])
    return pa.table([vectors["vec_id"], pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * near.shape[1], pa.int32()), found)], names=NEAREST.fieldNames())


def _dealt_twice(nodes: DataFrame, path: str, sizes: DataFrame) -> DataFrame:
    """The rows of ``PLACED`` for labels with more than ``MAX_CENTRES`` centres: no task compares more than it would for a small label."""
    read = lambda frame, where: nodes.sparkSession.read.schema(frame.schema).parquet(where)  # noqa: E731  a side of its own for each cogroup
    sized = nodes.join(sizes, ["label", "dim"])
    place = F.pmod(F.xxhash64(F.lit(9), "vec_id"), F.col("n"))
    wanted = F.ceil(F.col("n") / SHARD_ROWS)
    coarse = F.least(F.ceil(F.sqrt(wanted)), F.lit(MAX_CENTRES))
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    salt = F.pmod(F.xxhash64(F.lit(8), "vec_id"), salts).cast("int").alias("salt")
    spread = F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
    keys = ["label", "dim", "salt"]

    first = read(nodes, path).join(sizes, ["label", "dim"]).where(place < coarse).select("label", "dim", spread, "vec_id", "x")
    near = sized.select("label", "dim", salt, "vec_id", "x").groupBy(*keys).cogroup(first.groupBy(*keys)).applyInArrow(_nearest, NEAREST)
    near = near.select("vec_id", F.explode("found.home").alias("area"))
    near = sized.join(near, "vec_id", "left").withColumn("area", F.coalesce("area", F.lit(0)))
    placed, area_path = store.written(near.select("label", "dim", "area", "vec_id", "x", (place < wanted).alias("centre")), "ann-areas")

    # Within an area, its vectors are dealt by number to tasks that each have all its centres.
    area = ["label", "dim", "area"]
    parts = placed.groupBy(*area).agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(6), "vec_id"), F.col("parts")).cast("int").alias("part")
    here = placed.join(parts, area).select(*area, part, "vec_id", "x")
    centres = read(placed, area_path).where("centre").join(parts, area).select(*area, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "x")
    found = here.groupBy(*area, "part").cogroup(centres.groupBy(*area, "part")).applyInArrow(_nearest, NEAREST)
    # At most OVERLAP areas a vector, and OVERLAP centres of each.
    homes = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, OVERLAP)
    best = found.groupBy("vec_id").agg(F.array_sort(F.transform(homes, lambda h: h["home"])).alias("homes"))
    # An area without a centre of its own: its vectors share the area itself, as the home -1 - area.
    own = placed.groupBy("vec_id").agg(F.array(F.min(-1 - F.col("area"))).alias("own"))
    out = sized.join(own, "vec_id").join(best, "vec_id", "left").withColumn("homes", F.coalesce("homes", "own"))
    # All lists are as long as OVERLAP, as those of small labels are; a home repeated is one home.
    filled = F.slice(F.concat("homes", F.array_repeat(F.element_at("homes", -1), OVERLAP)), 1, OVERLAP)
    return out.select("label", "dim", F.explode("homes").alias("shard"), "vec_id", "x", filled.alias("homes")).select(*PLACED.fieldNames())


def robust_prune(x: np.ndarray) -> np.ndarray:
    """Neighbours of each row (unit vectors), ``DEGREE`` at most, -1 where fewer. All rows take a step together."""
    n = len(x)
    pool = min(POOL, n - 1)
    if pool < 1:
        return np.full((n, 1), -1)
    sim = (x.astype(np.float32) @ x.T.astype(np.float32))
    np.fill_diagonal(sim, -2)
    cand = np.argpartition(-sim, pool - 1, axis=1)[:, :pool]
    s = np.take_along_axis(sim, cand, 1)
    order = np.argsort(-s, axis=1, kind="stable")
    cand, s = np.take_along_axis(cand, order, 1), np.take_along_axis(s, order, 1)
    d = np.sqrt(np.maximum(2 - 2 * s, 0))
    open_ = np.ones((n, pool), dtype=bool)
    out = np.full((n, min(DEGREE, pool)), -1)
    rows = np.arange(n)
    for step in range(out.shape[1]):
        first = open_.argmax(1)
        some = open_[rows, first]
        if not some.any():
            break
        r, f = rows[some], first[some]
        got = cand[r, f]
        out[r, step] = got
        between = np.sqrt(np.maximum(2 - 2 * sim[got[:, None], cand[r]], 0))
        open_[r] &= ~(ALPHA * between <= d[r])
        open_[r, f] = False
    return out


def medoids(x: np.ndarray) -> np.ndarray:
    """Entry points: the row nearest the mean, then each time the row furthest from those taken."""
    mean = x.mean(0)
    got = [int((x @ mean).argmax())]
    far = x @ x[got[0]]
    for _ in range(min(MEDOIDS, len(x)) - 1):
        got.append(int(far.argmin()))
        far = np.maximum(far, x @ x[got[-1]])
    return np.array(got)


def range_search(x: np.ndarray, adjacent: list[np.ndarray] | np.ndarray, queries: np.ndarray, own: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of rows found with similarity of at least ``least``, by expansion from the medoids and the first row of each part that holds none."""
    n, m = len(x), len(queries)
    limits, flat = adjacent
    sim = np.full((m, n), -2.0, np.float32)
    done = np.zeros((m, n), dtype=bool)
    x32, q32 = x.astype(np.float32), queries.astype(np.float32)
    entry = medoids(x)
    part = heads(n, np.repeat(np.arange(n), np.diff(limits)), flat)
    entry = np.concatenate([entry, np.setdiff1d(part, part[entry])])
    sim[:, entry] = q32 @ x32[entry].T
    if own is not None:
        at = np.arange(m)
        sim[at, own] = 2.0
    slack = np.float32(0.06)
    while True:
        beam = min(BEAM, n)
        kth = np.partition(sim, n - beam, axis=1)[:, n - beam] if n > beam else np.full(m, -2, np.float32)
        take = (sim > -2) & ~done & ((sim >= kth[:, None]) | (sim >= least - slack))
        q, r = np.nonzero(take)
        if not len(q):
            break
        done[q, r] = True
        count = limits[r + 1] - limits[r]
        if not count.any():
            continue
        to = flat[ragged(limits[r], count)]
        q = np.repeat(q, count)
        fresh = sim[q, to] == -2
        key = np.unique(q[fresh] * n + to[fresh])
        for a in range(0, len(key), 1 << 17):
            z = key[a : a + (1 << 17)]
            sim[z // n, z % n] = np.einsum("ij,ij->i", q32[z // n], x32[z % n])
    near = (sim >= least - 1e-4) & (sim < 2.0)
    return np.nonzero(near)


def links(df: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per input row."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("x")).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("v"))
    spark = df.sparkSession
    # Equal vectors by 128 bits of hash; zeros of either sign are equal.
    same = F.transform("v.x", lambda v: F.when(v == 0, 0.0).otherwise(v))
    single, single_path = store.written(good.select("vec_id", "v.label", "v.x", F.xxhash64(same).alias("h"), F.xxhash64(F.lit(1), same).alias("g")), "ann-single")
    equal = ["label", "h", "g"]
    folded = single.groupBy(*equal).agg(F.min("vec_id").alias("vec_id"), F.min_by("x", "vec_id").alias("x"), F.count("*").alias("weight"))
    classes, class_path = store.written(folded.withColumn("dim", F.size("x")), "ann-classes")
    nodes, path = store.written(classes.select("vec_id", "label", "x", "dim"), "ann-nodes")

    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    most = SHARD_ROWS * MAX_CENTRES
    few, many = sizes.where(F.col("n") <= most), sizes.where(F.col("n") > most)
    sized = nodes.join(few, ["label", "dim"])
    again = df.sparkSession.read.schema(nodes.schema).parquet(path).join(few, ["label", "dim"])
    wanted = F.ceil(F.col("n") / SHARD_ROWS)
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    centres = again.where((F.col("n") > SHARD_ROWS) & (F.pmod(F.xxhash64(F.lit(9), "vec_id"), F.col("n")) < wanted)).select("label", "dim", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "vec_id", "x")
    dealt = sized.select("label", "dim", F.pmod(F.xxhash64(F.lit(8), "vec_id"), salts).cast("int").alias("salt"), "vec_id", "x")
    placed = dealt.groupBy("label", "dim", "salt").cogroup(centres.groupBy("label", "dim", "salt")).applyInArrow(_assign, PLACED)
    if not many.isEmpty():
        placed = placed.unionAll(_dealt_twice(nodes, path, many))
    placed, placed_path = store.written(placed, "ann-placed")

    shard = ["label", "dim", "shard"]
    parts = placed.groupBy(*shard).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocked = placed.join(parts, shard).withColumn("block", F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.col("blocks")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        near = robust_prune(_unit(_matrix(table["x"])))
        # Both directions: a pruned graph is searched along reversed edges too.
        a, b = np.nonzero(near >= 0)
        a, b = np.concatenate([a, near[a, b]]), np.concatenate([near[a, b], a])
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        return pa.table([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.searchsorted(a, np.arange(len(ids) + 1)), pa.int32()), pa.array(ids[b]))], names=ADJACENT.fieldNames())

    lists = blocked.select(*shard, "block", "vec_id", "x").groupBy(*shard, "block").applyInArrow(build, ADJACENT)
    united = lists.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # OVERLAP lists at most
    weights = spark.read.schema(classes.schema).parquet(class_path).select("vec_id", "weight")
    full, full_path = store.written(blocked.join(united, "vec_id").join(weights, "vec_id"), "ann-graph")

    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    carried = ["vec_id", "x", "homes", "near", "weight"]
    paired = lambda frame, *more: frame.select(*shard, "block", other, *carried, *more).select(*shard, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", *carried, *more)

    def found_in(key: tuple[pa.Scalar, ...], table: pa.Table):
        """Links (rows a < b of the table) found in a task, and for each whether its vectors share several shards."""
        low, high = key[3].as_py(), key[4].as_py()
        ids, block = table["vec_id"].to_numpy(), table["block"].to_numpy()
        x, homes = _unit(_matrix(table["x"])), _matrix(table["homes"])
        base, ask = np.flatnonzero(block == low), np.flatnonzero(block == high)
        if not len(base) or not len(ask):
            return ids, homes, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, homes.shape[1]), dtype=bool)
        # The united lists, as far as they lead to rows of this block.
        near = table["near"].combine_chunks().take(pa.array(base))
        flat, count = near.flatten().to_numpy(), near.value_lengths().to_numpy()
        source = np.repeat(np.arange(len(base)), count)
        order = np.argsort(ids[base])
        at = np.minimum(np.searchsorted(ids[base][order], flat), len(base) - 1)
        ok = ids[base][order][at] == flat
        limits = np.searchsorted(source[ok], np.arange(len(base) + 1))
        q, r = range_search(x[base], (limits, order[at[ok]]), x[ask], np.arange(len(base)) if low == high else None, least)
        a, b = ask[q], base[r]
        a, b = np.minimum(a, b), np.maximum(a, b)
        key_ = np.unique(a[a != b] * len(ids) + b[a != b])
        a, b = key_ // len(ids), key_ % len(ids)
        # Verified in double precision; which of its shards a vector shares with its partner.
        keep, shared = np.zeros(len(a), dtype=bool), np.zeros((len(a), homes.shape[1]), dtype=bool)
        for z in range(0, len(a), 1 << 16):
            s = slice(z, z + (1 << 16))
            shared[s] = (homes[a[s]][:, :, None] == homes[b[s]][:, None, :]).any(2)
            keep[s] = np.einsum("ij,ij->i", x[a[s]], x[b[s]]) >= least
        return ids, homes, a[keep], b[keep], shared[keep]

    def search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, homes, a, b, _ = found_in(key, table)
        n, here, weight = len(ids), key[2].as_py(), table["weight"].to_numpy()
        p, q = np.concatenate([a, b]), np.concatenate([b, a])
        # A list of shards may name one twice, to be as long as the others; the first place counts.
        fresh = np.ones(homes.shape, dtype=bool)
        fresh[:, 1:] = homes[:, 1:] != homes[:, :-1]
        shared = np.zeros((len(p), homes.shape[1]), dtype=bool)
        for z in range(0, len(p), 1 << 16):
            s = slice(z, z + (1 << 16))
            shared[s] = (homes[p[s]][:, :, None] == homes[q[s]][:, None, :]).any(2) & fresh[p[s]]
        several = shared.sum(1) > 1
        first = homes[p, shared.argmax(1)] == here if len(p) else np.zeros(0, dtype=bool)
        single = np.bincount(p[~several], weight[q[~several]], n).astype(np.int64)
        counted = np.bincount(p[several & first], weight[q[several & first]], n).astype(np.int64)
        low, high = np.minimum(ids[p], ids[q]).astype(np.uint64), np.maximum(ids[p], ids[q]).astype(np.uint64)
        name = mix(mix(low + np.uint64(0x9E3779B97F4A7C15)) ^ high)
        digests = []
        for i, j in ((0, 1), (0, 2), (1, 2)):
            d = np.zeros(n, np.uint64)
            if j < homes.shape[1]:
                # Links whose first shared shard is the i-th, as it finds them and as the j-th does: equal sets cancel.
                use = several & (shared.argmax(1) == i) & shared[:, j] & ((homes[p, i] == here) | (homes[p, j] == here))
                np.bitwise_xor.at(d, p[use], name[use])
            digests.append(pa.array(d.view(np.int64)))
        rank = np.argsort(ids)
        place = np.empty(n, np.int64)
        place[rank] = np.arange(n)
        head = ids[rank][heads(n, place[a], place[b])][place] if n else ids
        some = np.zeros(n, dtype=bool)
        some[p] = True
        return pa.table([pa.array(ids), pa.array(single), pa.array(counted), *digests, pa.array(head)], names=LINKED.fieldNames()).filter(pa.array(some))

    def partners(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, homes, a, b, shared = found_in(key, table)
        p, q = np.concatenate([a, b]), np.concatenate([b, a])
        ask = np.concatenate([shared.sum(1) > 1] * 2) & table["asked"].to_numpy(zero_copy_only=False)[p]
        order = np.argsort(p[ask], kind="stable")
        p, q = p[ask][order], q[ask][order]
        own = np.unique(p)
        limits = np.concatenate([np.searchsorted(p, own), [len(p)]])
        return pa.table([pa.array(ids[own]), pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(ids[q]))], names=PARTNERS.fieldNames())

    task = [*shard, "low", "high"]
    found, _ = store.written(paired(full).groupBy(*task).applyInArrow(search, LINKED), "ann-links")
    summed = found.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.sum("n_first").alias("n_first"), *(F.bit_xor(c).alias(c) for c in DIGESTS))
    totals, totals_path = store.written(summed, "ann-totals")
    missed = totals.where(" OR ".join(f"{c} <> 0" for c in DIGESTS)).select("vec_id")
    counts = totals.select("vec_id", (F.col("n_links") + F.col("n_first")).alias("n_links"))
    again_path = None
    if not missed.isEmpty():
        read = spark.read.schema(full.schema).parquet(full_path)
        marked = read.join(missed.withColumn("asked", F.lit(True)), "vec_id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        places = spark.read.schema(full.schema).parquet(full_path).join(missed, "vec_id", "left_semi").select(*shard).distinct()
        lists = paired(marked.join(places, shard, "left_semi"), "asked").groupBy(*task).applyInArrow(partners, PARTNERS)
        # A partner's weight counts once, whichever shards found it.
        each = lists.select("vec_id", F.explode("also").alias("partner")).distinct().join(weights.select(F.col("vec_id").alias("partner"), "weight"), "partner")
        more = each.groupBy("vec_id").agg(F.sum("weight").alias("n_also"))
        again, again_path = store.written(missed.join(more, "vec_id", "left").select("vec_id", F.coalesce("n_also", F.lit(0)).alias("n_also")), "ann-again")
        counts = totals.join(again, "vec_id", "left").select("vec_id", (F.col("n_links") + F.coalesce("n_also", "n_first")).alias("n_links"))
    comps = connected(found.select(F.col("vec_id").alias("a"), F.col("head").alias("b")), "ann-comps")
    known = counts.join(comps.withColumnRenamed("node", "vec_id"), "vec_id", "full")
    per_class = spark.read.schema(classes.schema).parquet(class_path).select("vec_id", *equal, "weight").join(known, "vec_id", "left")
    per_class = per_class.select(*equal, (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
    # The members of classes; a class of a third of all vectors is one row on the other side.
    members, member_path = store.written(spark.read.schema(single.schema).parquet(single_path).select("vec_id", *equal).join(per_class, equal).select("vec_id", "n_links", "component"), "ann-members")
    store.remove(spark, path, placed_path, full_path, single_path, class_path, totals_path, *([again_path] if again_path else []))
    out = rows.select("vec_id").join(members, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def audit(df: DataFrame, result: DataFrame, least: float = 0.93, sample: int = 200, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> float:
    """Share of the true links of a hashed, bounded sample of vectors that ``result`` counts (1.0 if they have none)."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x")).where(F.col("label").isNotNull() & usable("x"))
    picked = rows.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(sample).select(F.col("vec_id").alias("p"), "label", F.col("x").alias("y"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    cosine = dot("x", "y") / F.sqrt(dot("x", "x")) / F.sqrt(dot("y", "y"))
    true = rows.join(F.broadcast(picked), "label").where((F.col("p") != F.col("vec_id")) & (F.size("x") == F.size("y")) & (cosine >= least)).groupBy("p").agg(F.count("*").alias("want"))
    got = true.join(result.select(F.col("vec_id").alias("p"), "n_links"), "p").agg(F.sum("want").alias("want"), F.sum(F.least("want", "n_links")).alias("got")).first()
    return float(got.got / got.want) if got.want else 1.0
