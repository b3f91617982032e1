"""Re-audit of stored against derived rows by a tree of digests: only ranges that differ are read row by row.

Rows fall into ranges by the hash of their key. A range's digest is its size and the sums of two 64-bit hashes of each of its rows, so it depends on no order, and a parent's
is the sum of its children's. A tree is a small table, whatever it stands for: it can be stored beside the rows, so that a later audit needn't read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Children of a node; with three levels there are 16, 256 and 4096 ranges.
FANOUT, LEVELS = 16, 3
SUMS = ["digest_0", "digest_1"]


def _range(df: DataFrame, key: list[str], level: int) -> Column:
    # A null of a key and an absent one are alike here: hashes pass over nulls, and the range of equal keys is equal, which is all that counts.
    return F.pmod(F.xxhash64(*key), F.lit(FANOUT**level)).alias("range")


def digest_tree(df: DataFrame, key: list[str], levels: int = LEVELS) -> DataFrame:
    """(level, range, n, digest_0, digest_1): a row for each range of each level that has rows; level 0 is the whole. One pass."""
    # Hashes pass over nulls, so each column's absence is hashed too.
    cells = [c for name in sorted(df.columns) for c in (F.col(name), F.col(name).isNull())]
    lanes = [F.xxhash64(F.lit(i), *cells).alias(c) for i, c in enumerate(SUMS)]
    sums = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in SUMS]
    leaves = df.select(_range(df, key, levels), *lanes).groupBy("range").agg(F.count("*").alias("n"), *sums)
    # A leaf's number leaves its parent's when it is divided: at most as many rows as there are leaves.
    up = leaves.select(F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"), F.col("range").alias("leaf"), "n", *SUMS)
    return up.withColumn("range", F.pmod("leaf", F.pow(F.lit(FANOUT), F.col("level")).cast("long"))).groupBy("level", "range").agg(F.sum("n").alias("n"), *sums)


def differing(stored: DataFrame, derived: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(range) of the leaves of two trees that differ, found from the root down: below a range that agrees nothing is compared."""
    parts = ["n", *SUMS]
    same = F.struct(*(F.col(f"a.{c}") for c in parts)).eqNullSafe(F.struct(*(F.col(f"b.{c}") for c in parts)))
    open_ = None
    for level in range(levels + 1):
        a, b = stored.where(F.col("level") == level).alias("a"), derived.where(F.col("level") == level).alias("b")
        if open_ is not None:
            parent = F.pmod("range", F.lit(FANOUT ** (level - 1)))
            a, b = (t.join(F.broadcast(open_.withColumnRenamed("range", "parent")), parent == F.col("parent"), "left_semi").alias(n) for t, n in ((a, "a"), (b, "b")))  # a row a range of the level above
        joined = a.join(b, F.col("a.range") == F.col("b.range"), "full")
        open_ = joined.where(~same).select(F.coalesce("a.range", "b.range").alias("range"))
    return open_


def drift(stored: DataFrame, derived: DataFrame, key: list[str], levels: int = LEVELS, stored_tree: DataFrame | None = None) -> DataFrame:
    """The rows of :func:`state.drift`, that is all that one side has and the other has not, with the side. Of both sides only the rows in
    ranges that differ are shuffled; the ranges (``FANOUT ** levels`` at most) are sent to all tasks. ``stored_tree``: the stored rows' own, if there is one.

    Trees and ranges are checkpointed, which needs ``spark.checkpoint.dir``. Keys needn't be unique. Two different ranges with equal digests are not to be expected (two sums of 64-bit hashes; it is an audit against faults, not against forgery)."""
    derived = derived.select(*stored.columns)
    tree = (stored_tree if stored_tree is not None else digest_tree(stored, key, levels)).checkpoint()
    ranges = differing(tree, digest_tree(derived, key, levels).checkpoint(), levels).checkpoint()
    part = lambda df: df.withColumn("_range", _range(df, key, levels)).join(F.broadcast(ranges.withColumnRenamed("range", "_range")), "_range", "left_semi").drop("_range")
    a, b = part(stored), part(derived)
    return a.exceptAll(b).withColumn("side", F.lit("stored")).unionByName(b.exceptAll(a).withColumn("side", F.lit("derived")))
