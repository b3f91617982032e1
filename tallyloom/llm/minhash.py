"""MinHash near-dedup with tensored banding.

Two collections of ``m`` sub-keys, each made of ``r`` minhashes, are computed:
``2 m r`` minhashes. Every pair of a sub-key of the one and a sub-key of the other
is the key of a table, so there are ``m * m`` tables of ``2 r`` minhashes each. Two
texts of similarity J meet in some table with probability ``(1 - (1 - J^r)^m)^2``:
0.9999 at J = 0.8 with the defaults.

Steps
1. One pass over the texts: set size, a 128-bit digest of the set, sub-keys, and a
   16-bit signature for estimates. Equal sets become one class, stood for by the
   smallest id.
2. Sub-keys that only one class has are dropped, then table keys are formed.
3. In each bucket every class is compared with the bucket's hub (the class whose
   sub-keys are the most common): a row per member, not per pair.
4. Links are confirmed on the full sets of shingles and joined to components.
5. Classes in buckets that still hold several components are dealt, with their sets, to
   a task for each first sub-key (large sub-keys: one for each pair of blocks). A task
   confirms every pair that meets in a table, is of two components and can reach the
   threshold by the sizes and by the number of shingles that other components of the
   task have (exact bounds); it returns one link for each class and local component, so
   no pairs are written or shuffled. No candidate pair is left unresolved.

Defined cases. Null or empty text, or one without words: empty set, linked with
nothing. Null id: ``component_id`` null, kept. Rows repeated under one id: nodes
are ids, and a row of the result per row of the input; if their texts differ, near
links are confirmed on the greatest text. Ties: equal sets are one
class. Empty table: no rows. Extra columns are ignored. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import store
from tallyloom.llm import vectext as V
from tallyloom.llm.components import connected, heads

TABLES_SIDE = 14
ROWS_SIDE = 3
#: Pairs whose estimate is lower are no candidates: at a true 0.8 and 84 minhashes, about one in 10^6.
LEAST_ESTIMATE = 0.55
#: Classes of a block of a sub-key, and rows of a bucket of tasks, in step 5.
BLOCK = 2048
BUCKET_ROWS = 512
#: Groups of equal sets are joined to their stand-in over so many keys.
SALTS = 16

SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("hi", T.LongType()),
        T.StructField("lo", T.LongType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
        T.StructField("sig", T.BinaryType()),
    ]
)


def shingles(t: V.Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle in order, row limits); fewer words than ``k`` are one shingle, none give none. Case-folded."""
    w = V.Words(t)
    h = w.hashes(t, fold_case=True)
    g = V.gram_hash(h, k)
    n = np.where(w.n >= k, w.n - k + 1, (w.n > 0).astype(np.int64))
    limits = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(limits[-1], np.uint64)
    full = np.flatnonzero(w.n >= k)
    out[V.ragged(limits[full], n[full])] = g[V.ragged(w.row[full], n[full])]
    for i in np.flatnonzero((w.n > 0) & (w.n < k)):
        a = h[w.row[i] : w.row[i + 1]]
        out[limits[i]] = V.mix(V.gram_hash(a, len(a)) ^ np.uint64(len(a)))[0]
    return out, limits


def sets(t: V.Texts, k: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    h, limits = shingles(t, k)
    return [np.unique(h[a:b]) for a, b in zip(limits[:-1].tolist(), limits[1:].tolist())]


def _sign(k: int):
    total = 2 * TABLES_SIDE * ROWS_SIDE
    rng = np.random.default_rng(41)
    xor = rng.integers(0, 2**63, total).astype(np.uint64)
    mul = rng.integers(0, 2**62, total).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    part = rng.integers(0, 2**62, (ROWS_SIDE,)).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in V.chunks(batch.column(1)):
                h, limits = shingles(t, k)
                some = np.flatnonzero(np.diff(limits))
                mins = np.zeros((total, t.rows), np.uint64)
                if len(some):
                    for j in range(total):
                        x = h ^ xor[j]
                        x *= mul[j]
                        mins[j, some] = np.minimum.reduceat(x, limits[some])
                n, hi, lo = np.zeros(t.rows, np.int64), np.zeros(t.rows, np.uint64), np.zeros(t.rows, np.uint64)
                for i in some:
                    s = np.unique(h[limits[i] : limits[i + 1]])
                    n[i], hi[i], lo[i] = len(s), V.mix(s).sum(), V.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()
                keys = np.zeros((t.rows, 2 * TABLES_SIDE), np.uint64)
                for slot in range(2 * TABLES_SIDE):
                    keys[:, slot] = V.mix((mins[slot * ROWS_SIDE : (slot + 1) * ROWS_SIDE] * part[:, None]).sum(0) + np.uint64(slot + 1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(t.rows + 1) * 2 * TABLES_SIDE, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                low = (mins.T >> np.uint64(48)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(t.first, t.rows).cast(pa.int64()), pa.array(n), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), lists, pa.array([r.tobytes() for r in low], pa.binary())],
                    names=SIGNED.fieldNames(),
                )

    return run


_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array((x == y).mean(1) >= LEAST_ESTIMATE))


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(i).to_pylist() for i in (0, 1)]
            # A hub's text comes with each of its partners: each id is cut into shingles once a batch.
            first = {}
            for side in (0, 1):
                for i, x in enumerate(ids[side]):
                    first.setdefault(x, (side, i))
            texts = pa.array([batch.column(2 + s)[i].as_py() for s, i in first.values()], pa.large_string())
            of = {}
            at = list(first)
            for t in V.chunks(texts):
                of.update(zip(at[t.first : t.first + t.rows], sets(t, k)))
            good = []
            for x, y in zip(*ids):
                p, q = of[x], of[y]
                if len(p) > len(q):
                    p, q = q, p
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(q) else 0
                good.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


PACKED = "doc_id long, n int, comp long, keys array<long>, places array<struct<slot:int,u:long,blocks:int>>, hashes binary"


def _pack(k: int):
    """Each class with its set of shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in V.chunks(batch.column(5)):
                part = batch.slice(t.first, t.rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array([x.tobytes() for x in sets(t, k)], pa.binary())], names=[*batch.schema.names[:5], "hashes"])

    return run


def linked_pairs(n: np.ndarray, comp: np.ndarray, keys: np.ndarray, slot: int, block: np.ndarray, hashes: list[np.ndarray], percent: int, side: int = TABLES_SIDE) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of different components that link and meet first at sub-key ``slot``.

    If the rows are of two blocks, only pairs across the blocks are meant.
    """
    owner = np.repeat(np.arange(len(n)), [len(x) for x in hashes])
    _, code = np.unique(np.concatenate(hashes), return_inverse=True)
    low, high = np.full(code.max(initial=-1) + 1, np.iinfo(np.int64).max), np.full(code.max(initial=-1) + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, code, comp[owner])
    np.maximum.at(high, code, comp[owner])
    shared = low != high
    some = shared[code]
    s = np.bincount(owner[some], minlength=len(n))
    live = np.flatnonzero(100 * s >= percent * n)
    empty = np.zeros(0, np.int64)
    if len(live) < 2:
        return empty, empty
    place = np.cumsum(shared) - 1
    width = -(-int(shared.sum()) // 64) * 64
    bits = np.empty((len(live), width // 64), np.uint64)
    limits = np.searchsorted(owner[some], np.arange(len(n) + 1))
    at = place[code[some]]
    for a in range(0, len(live), 256):
        rows = live[a : a + 256]
        line = np.zeros((len(rows), width), dtype=bool)
        for i, r in enumerate(rows):
            line[i, at[limits[r] : limits[r + 1]]] = True
        bits[a : a + 256] = np.packbits(line, axis=1).view(np.uint64)
    n, comp, keys, block, s = n[live], comp[live], keys[live], block[live], s[live]
    across = block.min() != block.max()
    found = []
    for a in range(0, len(live), 32):
        i = np.arange(a, min(a + 32, len(live)))[:, None]
        j = np.arange(len(live))[None, :]
        can = (i < j) & (comp[i] != comp[j]) & ((block[i] != block[j]) | (not across))
        # |A & B| >= percent / (100 + percent) * (|A| + |B|) where they link, and |A & B| is at most what either shares.
        can &= np.minimum(s[i], s[j]) * (100 + percent) >= (n[i] + n[j]) * percent
        can &= np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent
        x, y = np.nonzero(can)
        x += a
        same = keys[x] == keys[y]
        meet = same[:, slot] & ~same[:, :slot].any(1) & same[:, side:].any(1)
        x, y = x[meet], y[meet]
        step = max(1, (1 << 21) // bits.shape[1])
        for z in range(0, len(x), step):
            u, v = x[z : z + step], y[z : z + step]
            both = np.bitwise_count(bits[u] & bits[v]).sum(1, dtype=np.int64)
            good = 100 * both >= percent * (n[u] + n[v] - both)
            found.append((live[u[good]], live[v[good]]))
    if not found:
        return empty, empty
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _across(percent: int, side: int):
    """Links between components within a bucket of (sub-key, pair of blocks), a forest of them."""

    def run(table: pa.Table) -> pa.Table:
        slot, u, low, high, block, ids, n, comp = (table[c].to_numpy() for c in ("slot", "u", "low", "high", "block", "doc_id", "n", "comp"))
        keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(n), -1)
        hashes = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        order = np.lexsort((ids, high, low, u, slot))
        new = np.ones(len(order), dtype=bool)
        for c in (slot, u, low, high):
            c = c[order]
            new[1:] &= c[1:] == c[:-1]
        new[1:] = ~new[1:]
        starts = [*np.flatnonzero(new).tolist(), len(order)]
        left, right = [], []
        for a, b in zip(starts[:-1], starts[1:]):
            rows = order[a:b]
            if comp[rows].min() == comp[rows].max():
                continue
            x, y = linked_pairs(n[rows].astype(np.int64), comp[rows], keys[rows], int(slot[rows[0]]), block[rows], [hashes[r] for r in rows], percent, side)
            # A link for each member and local component says as much as all of its links.
            head = heads(len(rows), x, y)
            member = np.flatnonzero(head != np.arange(len(rows)))
            left.append(ids[rows[member]])
            right.append(ids[rows[head[member]]])
        none = np.zeros(0, np.int64)
        return pa.table([pa.array(np.concatenate([none, *left])), pa.array(np.concatenate([none, *right]))], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per input row. ``100 * |A & B| >= percent * |A | B|`` links."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed, signed_path = store.written(docs.mapInArrow(_sign(k), SIGNED), "minhash-signed")

    known = signed.where("doc_id is not null and n_shingles > 0")
    classes = known.groupBy("hi", "lo", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = known.join(classes.select(F.col("rep").alias("doc_id"), "hi", "lo"), ["doc_id", "hi", "lo"]).dropDuplicates(["doc_id", "hi", "lo"])

    sub = reps.select("doc_id", F.col("n_shingles").cast("int").alias("n"), F.posexplode("keys").alias("slot", "key"))
    common = sub.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    side = lambda low: F.collect_list(F.when((F.col("slot") >= TABLES_SIDE) == F.lit(not low), F.col("key")))  # noqa: E731  at most TABLES_SIDE each
    have = sub.join(common, "key").groupBy("doc_id", "n").agg(side(True).alias("us"), side(False).alias("vs"), F.sum(F.log2("times")).alias("score"))
    have, have_path = store.written(have.where((F.size("us") > 0) & (F.size("vs") > 0)), "minhash-keys")
    rows = have.select("doc_id", "n", "score", F.explode("us").alias("x"), "vs").select("doc_id", "n", "score", "x", F.explode("vs").alias("y")).select(F.xxhash64("x", "y").alias("key"), "doc_id", "n", "score")

    hubs = rows.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct(-F.col("score"), F.col("doc_id").alias("doc_id"), F.col("n").alias("n"))).alias("hub")).where("size > 1")
    hubs = hubs.select("key", "size", F.col("hub.doc_id").alias("hub"), F.col("hub.n").alias("hub_n"))
    placed, placed_path = store.written(rows.join(hubs, "key").select("key", "size", "doc_id", "n", "hub", "hub_n"), "minhash-placed")

    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    stars = placed.where((F.col("doc_id") != F.col("hub")) & fits(F.col("n"), F.col("hub_n"))).select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()

    sigs = reps.select("doc_id", "sig")
    active = placed.select("doc_id").distinct()
    texts, texts_path = store.written(docs.join(active, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text")), "minhash-texts")

    def links(pairs: DataFrame) -> DataFrame:
        likely = (
            pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("s")), "a")
            .join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("t")), "b")
            .select("a", "b", "s", "t")
            .mapInArrow(_likely, _PAIR)
        )
        full = likely.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("t")), "b")
        return full.select("a", "b", "s", "t").mapInArrow(_confirm(k, percent), _PAIR)

    first, first_path = store.written(links(stars), "minhash-links")
    comps, comps_path = store.written(connected(first), "minhash-comps")

    # Buckets that several components still share.
    now = placed.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id"))
    mixed = now.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    rest = now.join(mixed, "key", "left_semi").groupBy("doc_id").agg(F.first("n").alias("n"), F.first("comp").alias("comp"))
    rest, rest_path = store.written(rest.join(reps.select("doc_id", "keys"), "doc_id"), "minhash-rest")

    firsts = rest.select("doc_id", "comp", F.posexplode(F.slice("keys", 1, TABLES_SIDE)).alias("slot", "u"))
    open_ = firsts.groupBy("slot", "u").agg(F.count("*").alias("size"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
    open_ = open_.select("slot", "u", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    entry = F.struct("slot", "u", "blocks")
    dealt = firsts.join(open_, ["slot", "u"]).groupBy("doc_id").agg(F.collect_list(entry).alias("places"))  # at most TABLES_SIDE
    dealt = rest.join(dealt, "doc_id").join(texts, "doc_id").select("doc_id", "n", "comp", "keys", "places", "text")
    packed, packed_path = store.written(dealt.mapInArrow(_pack(k), PACKED), "minhash-sets")
    buckets = 1 + (packed.agg(F.sum(F.size("places"))).first()[0] or 0) // BUCKET_ROWS

    own = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.col("blocks")).cast("int")
    rows = packed.select("doc_id", "n", "comp", "keys", "hashes", F.explode("places").alias("p")).select("*", "p.slot", "p.u", "p.blocks").withColumn("block", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    task = F.pmod(F.xxhash64("slot", "u", "low", "high"), F.lit(buckets)).alias("task")
    rows = rows.select(task, "slot", "u", "low", "high", "block", "doc_id", "n", "comp", "keys", "hashes")
    across = rows.groupBy("task").applyInArrow(_across(percent, TABLES_SIDE), _PAIR)

    second, second_path = store.written(across, "minhash-links")
    comps2, comps2_path = store.written(connected(first.unionAll(second)), "minhash-comps")

    # A group of equal sets meets its stand-in under several keys: one task would hold all copies else.
    salt = lambda c: F.pmod(F.xxhash64(F.lit(2), c), F.lit(SALTS)).cast("int")
    all_salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    spread = classes.withColumn("salt", F.explode(F.when(F.col("copies") > 1, all_salts).otherwise(F.array(salt("rep"))))).drop("copies")
    members = signed.select("doc_id", "n_shingles", "hi", "lo", salt("doc_id").alias("salt")).join(spread, ["hi", "lo", "n_shingles", "salt"], "left")
    # Rows repeated under one id with different texts tie their classes together.
    out = members.join(comps2.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    result, result_path = store.written(out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")), "minhash-result")
    store.remove(spark, signed_path, have_path, placed_path, texts_path, first_path, comps_path, rest_path, packed_path, second_path, comps2_path)
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id stands for its component, all columns as they were; rows of null id stay."""
    gone = near_duplicates(docs, k, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
