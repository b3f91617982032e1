"""All pairs of texts that are alike, by blocks of texts of one length: what a block of pairs can't hold is ruled out by matrices, the rest by bit vectors.

Titles have too few different neighbours of characters for an inverted index: common ones join nearly everything with everything. So every block of texts
meets every block whose length allows the ratio, in a group of its own of ``BLOCK`` texts a side. The work is quadratic in the distinct texts, at some
0.1 microseconds of CPU a pair; memory is a group's, and what is shuffled is a block's texts once for every block that it meets.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import similarity_bound

#: Texts of a block, columns of its matrices, neighbouring places that share one, and the pairs whose bit vectors are held at once.
BLOCK, WIDTH, PLACES, AT_ONCE = 2048, 1024, 8, 1 << 19
_MIX = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263)]


def _codes(texts: list[str]) -> np.ndarray:
    """Texts of one length as rows of code points."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), -1)


def _neighbours(codes: np.ndarray) -> np.ndarray:
    return codes[:, :-1] * _MIX[0] ^ codes[:, 1:] * _MIX[1]


def _column(grams: np.ndarray, place: int) -> np.ndarray:
    """The column of a pair of neighbours in a range of places; equal ones have equal columns, others may."""
    return ((grams + np.uint32(place * int(_MIX[2]) & 0xFFFFFFFF)) * _MIX[3] >> np.uint32(16)) % np.uint32(WIDTH)


def _held(codes: np.ndarray) -> np.ndarray:
    """How often a text has each pair of neighbours in each range of places."""
    grams, x = _neighbours(codes), np.zeros((len(codes), WIDTH), np.float32)
    rows = np.arange(len(codes))
    for i in range(grams.shape[1]):
        x[rows, _column(grams[:, i], i // PLACES)] += 1
    return x


def _met(codes: np.ndarray, back: int, ahead: int, size: int) -> np.ndarray:
    """Whether a text can match a pair of neighbours of a text of ``size`` in a range of places: with a place there that lies up to ``back`` before or ``ahead`` after its own."""
    grams, x = _neighbours(codes), np.zeros((len(codes), WIDTH), np.float32)
    rows = np.arange(len(codes))
    for j in range(grams.shape[1]):
        for place in range(max(0, j - back) // PLACES, min(size - 2, j + ahead) // PLACES + 1):
            x[rows, _column(grams[:, j], place)] = 1
    return x


def _common(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The longest common subsequence of texts ``i`` of ``a``, of 64 characters at most, and ``j`` of ``b``, or more: characters of one low byte count as equal."""
    size = a.shape[1]
    where = np.zeros((len(a), 256), np.uint64)
    for at in range(size):
        where[np.arange(len(a)), a[:, at] & 255] |= np.uint64(1 << at)
    where, base, low = where.ravel(), i * 256, (b & 255).astype(np.int64)
    v = np.full(len(i), np.iinfo(np.uint64).max, np.uint64)
    for at in range(b.shape[1]):
        u = v & where[base + low[j, at]]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v & np.uint64((1 << size) - 1))


def possible(a: list[str], b: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b``, each texts of one length, of all pairs that can be ``least`` alike, and of some that can't.

    ``M = least * s / 2`` of the ``s`` characters of both must match in order, in at most ``1 + s - 2 * M`` runs, so ``3 * M - s - 1`` pairs of neighbours do
    too, none further from its place than the characters before it that stay unmatched.
    """
    none = np.zeros(0, np.int64)
    if not a or not b:
        return none, none
    m, n = len(a[0]), len(b[0])
    matched = int(np.ceil(least * (m + n) / 2 - 1e-9))
    if matched > min(m, n):
        return none, none
    x, y, need = _codes(a), _codes(b), 3 * matched - m - n - 1
    if need > 0:
        i, j = np.nonzero(_held(x) @ _met(y, n - matched, m - matched, m).T >= need)
    else:
        i, j = (v.ravel() for v in np.indices((len(a), len(b))))
    if min(m, n) > 64:
        return i, j
    kept = []
    for at in range(0, len(i), AT_ONCE):
        p, q = i[at : at + AT_ONCE], j[at : at + AT_ONCE]
        kept.append((_common(x, y, p, q) if m <= 64 else _common(y, x, q, p)) >= matched)
    kept = np.concatenate(kept) if kept else np.zeros(0, bool)
    return i[kept], j[kept]


def _compared(least: float):
    def run(table: pa.Table) -> pa.Table:
        texts, asks, holds, second = (table.column(c).to_pylist() for c in ("t", "asks", "holds", "second"))
        one, two = [k for k, s in enumerate(second) if not s], [k for k, s in enumerate(second) if s]
        own = not two  # a block with itself
        if own and table.column("whole")[0].as_py() is False:
            one = []  # the other block has no texts
        i, j = possible([texts[k] for k in one], [texts[k] for k in (one if own else two)], least)
        if own:
            i, j = i[i < j], j[i < j]
        out, matcher, held = [], SequenceMatcher(None), None
        for x, y in zip(i.tolist(), j.tolist()):
            x, y = one[x], (one if own else two)[y]
            for p, q in ((x, y), (y, x)):  # the ratio's order matters
                s, t = texts[p], texts[q]
                if asks[p] and holds[q] and (min(len(s), len(t)) <= 64 or similarity_bound(s, t) >= least):
                    if t != held:  # what is known of the second text serves for all of its partners
                        matcher.set_seq2(t)
                        held = t
                    matcher.set_seq1(s)
                    if (ratio := matcher.ratio()) >= least:
                        out.append((s, t, ratio))
        return pa.table({"asked": pa.array([o[0] for o in out], pa.string()), "other": pa.array([o[1] for o in out], pa.string()), "ratio": pa.array([o[2] for o in out], pa.float64())})

    return run


def alike(texts: DataFrame, least: float) -> DataFrame:
    """(asked, other, ratio): all pairs of different texts that are at least ``least`` alike, of (t, asks, holds): distinct texts, not empty, and on which sides each stands.

    A length with more than ``BLOCK`` texts is dealt by a hash into blocks of about as many.
    """
    texts = texts.withColumn("size", F.length("t"))
    sizes = texts.groupBy("size").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))  # a row a length
    first, second = (sizes.select(F.col("size").alias(f"{p}_size"), F.col("n").alias(f"{p}_n")) for p in ("a", "b"))
    met = first.join(second, (F.col("a_size") <= F.col("b_size")) & (F.ceil(least * (F.col("a_size") + F.col("b_size")) / 2 - 1e-9) <= F.col("a_size")))
    met = met.withColumn("a_block", F.explode(F.sequence(F.lit(0), F.col("a_n") - 1))).withColumn("b_block", F.explode(F.sequence(F.lit(0), F.col("b_n") - 1)))
    group = ["a_size", "a_block", "b_size", "b_block"]
    whole = (F.col("a_size") == F.col("b_size")) & (F.col("a_block") == F.col("b_block"))
    met = met.where((F.col("a_size") < F.col("b_size")) | (F.col("a_block") <= F.col("b_block"))).select(*group, whole.alias("whole"))
    sides = F.array(F.struct(F.col("a_size").alias("size"), F.col("a_block").alias("block"), F.lit(False).alias("second")), F.struct(F.col("b_size").alias("size"), F.col("b_block").alias("block"), F.lit(True).alias("second")))
    roles = met.select(*group, "whole", F.inline(sides)).where("NOT (whole AND second)")
    placed = texts.join(sizes, "size").withColumn("block", F.pmod(F.xxhash64("t"), F.col("n")).cast("int"))
    dealt = placed.join(roles, ["size", "block"]).select(*group, "whole", "second", "t", "asks", "holds")
    # By a number: few bytes of texts are much work, which adaptive execution would put in one task.
    dealt = dealt.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group)
    return dealt.groupBy(*group).applyInArrow(_compared(least), "asked string, other string, ratio double")
