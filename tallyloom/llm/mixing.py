"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Per source: total words, rows, target words and number of blocks (a block is a
   hash bucket of about ``block_words`` words). Sources are listed on the driver:
   one small row each, the size of the list of weights that a mix needs anyway.
2. Whole epochs of a source are drawn while its target allows; the rest is drawn
   from its blocks in a seeded affine permutation, up to the exact number of words
   (the last block is drawn in hash order within the block).
3. The shards' block quotas come from a splitting tree: the range of shards is
   halved again and again, and at each node the counts of every source that go
   left are one multivariate hypergeometric draw, so totals are exact.
4. A source's draws (epoch by epoch, in permuted block order) fill its shards'
   quotas one after another: disjoint blocks. Rows are ordered by a hash in a shard.

Targets: sources in code point order, null last, weigh ``weights`` repeating; a
target above ``cap`` times its source's words stops there and the excess is
shared again by weight until none is above.

Null text: 0 words. Null source: a source of its own, last. A null id mixes like any
other row; rows of equal id are ordered by their text's hash, and equal rows are drawn
each on its own. An empty table gives no rows. A source without words has target 0.
Words of whole texts count, however long they are. Extra columns are ignored by :func:`mix` and kept by :func:`materialise`, whatever their
names. More than ``MAX_SOURCES`` sources are refused: their list is a plan on the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm import store

BLOCK_WORDS = 200_000
#: Sources that a mix may have, and up to which number their list is broadcast.
MAX_SOURCES = 1_000_000
FEW_SOURCES = 20_000
#: Blocks of a source whose words are summed by one task.
GROUP_BLOCKS = 4096


def size_of(text: F.Column) -> F.Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    trimmed = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.regexp_replace(trimmed, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> list[float]:
    """Target words of each source, in order."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, free, pool = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(w[i] for i in sorted(free))
        over = [i for i in sorted(free) if pool * w[i] / total > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = pool * w[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            free.discard(i)
            pool -= out[i]
    return out


def split_tree(counts: list[int], shards: int, seed: int = 11) -> np.ndarray:
    """Blocks of each source in each shard, shape (sources, shards).

    A node's capacity divides over its halves in proportion to their shards; which
    sources' blocks go left is a multivariate hypergeometric draw.
    """
    out = np.zeros((len(counts), shards), np.int64)

    def down(have: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[:, low] = have
            return
        mid = (low + high) // 2
        total = int(have.sum())
        left = total * (mid - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        took = rng.multivariate_hypergeometric(have, left, method="marginals") if total else have.copy()
        down(took, low, mid)
        down(have - took, mid, high)

    if len(counts):
        down(np.array(counts, np.int64), 0, shards)
    return out


def row_hash(seed: int, id_col: str, text_col: str, source_col: str) -> F.Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.col(text_col)), F.col(source_col))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, shards: int = 16, block_words: int = BLOCK_WORDS, whole: bool = False, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, and
    ``draws``, an array of (epoch, shard, words) for each time the row is drawn.

    ``whole`` draws the last row of a source whole if at least half of it is due, else not at all.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).alias("source"),
        size_of(F.col(text_col)).alias("size"),
        row_hash(seed, id_col, text_col, source_col).alias("h"),
    )
    rows, _ = store.written(rows, "mix-sizes")  # ids and sizes, without texts

    per = sorted(rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect(), key=lambda r: (r.source is None, r.source or ""))
    if len(per) > MAX_SOURCES:
        raise ValueError(f"{len(per)} sources; at most {MAX_SOURCES} can be mixed")
    goal = targets([r.words for r in per], weights, cap)
    plan, counts = [], []
    for i, r in enumerate(per):
        blocks = max(1, min(r.rows, math.ceil(r.words / block_words)))
        epochs = int(goal[i] // r.words) if r.words else 0
        rest = goal[i] - epochs * r.words
        draws = epochs * blocks + (math.ceil(blocks * rest / r.words) if r.words else 0)
        rng = np.random.default_rng([seed, i])
        a = next(x for x in map(int, rng.integers(1, max(2, blocks), 1000)) if math.gcd(x, blocks) == 1) if blocks > 1 else 1
        plan.append((r.source, r.words, goal[i], blocks, epochs, int(round(rest)), a, int(rng.integers(0, blocks))))
        counts.append(draws)
    ends = np.cumsum(split_tree(counts, shards, seed), axis=1).tolist() if per else []
    schema = "source string, source_size long, target double, blocks long, epochs int, rest long, mul long, add long, ends array<long>"
    info = spark.createDataFrame([(*p, e) for p, e in zip(plan, ends)], schema)

    # A row a source: the list that the plan above was made from.
    info = F.broadcast(info) if len(per) <= FEW_SOURCES else info
    with_plan = rows.join(info, rows.source.eqNullSafe(info.source)).drop(info.source)
    block = F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.col("blocks"))
    ranked = with_plan.withColumn("rank", F.pmod(block * F.col("mul") + F.col("add"), F.col("blocks")))

    # Words due from each block in the last, partial epoch: a running sum over the blocks of a source, in two
    # levels (groups of blocks, then blocks of a group), so that no task holds all blocks of a large source.
    in_block = ranked.groupBy("source", "rank", "rest").agg(F.sum("size").alias("words")).withColumn("group", F.floor(F.col("rank") / GROUP_BLOCKS))
    ahead = lambda w: F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = in_block.groupBy("source", "group").agg(F.sum("words").alias("words"))
    groups = groups.select(F.col("source").alias("s"), F.col("group").alias("g"), ahead(Window.partitionBy("source").orderBy("group")).alias("ahead"))
    placed = in_block.join(groups, in_block.source.eqNullSafe(groups.s) & (in_block["group"] == groups.g))
    run = F.col("ahead") + ahead(Window.partitionBy("source", "group").orderBy("rank"))
    due = placed.select("source", "rank", "words", F.least(F.col("words"), F.greatest(F.lit(0), F.col("rest") - run)).alias("due"))
    due = due.select(F.col("source").alias("s"), F.col("rank").alias("k"), "due", (F.col("due") < F.col("words")).alias("partial"))
    drawn = ranked.join(due, ranked.source.eqNullSafe(due.s) & (ranked["rank"] == due.k)).drop("s", "k")

    split = F.col("partial") & (F.col("due") > 0)
    # Only the one partial block of a source is ordered; the others are whole or not drawn.
    order = Window.partitionBy("source", "rank").orderBy("h", "doc_id", "size")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = drawn.where(split).withColumn("left", F.col("due") - before)
    some = F.least(F.col("size"), F.greatest(F.lit(0), F.col("left")))
    if whole:
        some = F.when(F.col("left") * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    part = part.withColumn("extra", some).drop("left")
    full = drawn.where(~split).withColumn("extra", F.when(F.col("partial"), F.lit(0)).otherwise(F.col("size")))
    # A block without words is neither partial nor due; its rows have size 0.
    both = full.unionByName(part)

    shard = lambda e: F.size(F.filter("ends", lambda x: x <= e * F.col("blocks") + F.col("rank")))
    times = F.col("epochs") + F.when(F.col("extra") > 0, 1).otherwise(0)
    epochs = F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))
    draws = F.transform(
        epochs,
        lambda e: F.struct(
            e.alias("epoch"),
            F.least(shard(e), F.lit(shards - 1)).cast("int").alias("shard"),
            F.when(e < F.col("epochs"), F.col("size")).otherwise(F.col("extra")).alias("words"),
        ),
    )
    taken = F.col("epochs") * F.col("size") + F.col("extra")
    return both.select("doc_id", "source", "h", "size", "source_size", "target", taken.cast("long").alias("taken"), draws.alias("draws"))


def materialise(docs: DataFrame, mixed: DataFrame, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: a row of ``docs`` for each draw, dealt to its shard and shuffled within by a hash. Rows keep their columns; ``seed`` is the mix's."""
    drawn = mixed.where("taken > 0").select(F.col("doc_id").alias("id"), "h", "draws")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), row_hash(seed, id_col, text_col, source_col).alias("h"))
    keys = ["h"]
    # Equal rows of the input were drawn each on its own: they are numbered on both sides, so that each meets its own draws.
    if not mixed.groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        keys = ["h", "nth"]
        numbered = lambda df, by: df.withColumn("nth", F.row_number().over(Window.partitionBy("id", "h").orderBy(by)))
        drawn = numbered(mixed.select(F.col("doc_id").alias("id"), "h", "draws", "taken"), F.col("draws").cast("string")).where("taken > 0")
        rows = numbered(rows, F.to_json("row"))
    drawn = drawn.select(F.col("id").alias("of"), *keys, F.explode("draws").alias("draw"))
    joined = rows.join(drawn, keys).where(F.col("id").eqNullSafe(F.col("of")))
    place = [F.col("draw.shard"), F.xxhash64("draw.epoch", "h")]
    return joined.repartitionByRange(*place).sortWithinPartitions(*place).select("row.*")
