"""Suffix-array dedup of byte strings.

:func:`by_doubling` is distributed prefix doubling over every byte position: rank pairs
at growing offsets are sorted by Spark and reranked; positions leave as soon as their
prefix is unique. :func:`deduplicate` gives the same result from sampled suffixes
(see :mod:`tallyloom.llm.repeats`): anchor positions named at growing lengths, and single
positions only where their anchor's longer string is ambiguous. It moves a fraction of
the data, and is what the query uses; the README has the figures of both.

Each byte covered by a ``threshold``-byte string that also starts earlier is removed.
Null or empty text: no bytes, nothing removed. Null id: the row is returned
unchanged and takes no part in matching. Rows repeated under one id are at one
place, so neither is earlier than the other; where their texts differ, each loses
only what is repeated in it. Texts shorter than the threshold are kept; texts of any
length are read whole. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import repeats, store
from tallyloom.llm import vectext as V

FIRST_NAME = 24

KEPT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept", T.BinaryType()),
        T.StructField("kept_sha256", T.StringType()),
    ]
)


FIRST_LENGTH = 8


def _ranked(pairs: DataFrame) -> DataFrame:
    """``pairs`` (doc_id, sub, i, a, b) with the rank of (a, b) in sorted order, repeated pairs only.

    Distinct pairs are counted with map-side combining, so a hot pair is a row a task; those that repeat are range-partitioned
    and sorted, and numbered in that order. The numbers are written before they are used: a lost task can't change them.
    """
    often = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    often, path = store.written(often.repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("r", F.monotonically_increasing_id()), "suffix-ranks")
    out, _ = store.written(pairs.join(often, ["a", "b"]).select("doc_id", "sub", "i", "r"), "suffix-positions")
    store.remove(pairs.sparkSession, path)
    return out


def by_doubling(docs: DataFrame, threshold: int = 100, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows as :func:`deduplicate`, by prefix doubling over all positions: some 30 bytes a position and round."""
    docs, _ = repeats.identified(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    data = docs.where(f"doc_id is not null and octet_length(text) >= {threshold}").distinct().select("doc_id", "sub", F.encode("text", "UTF-8").alias("x"))
    length = min(FIRST_LENGTH, threshold)
    at = data.select("doc_id", "sub", "x", F.explode(F.sequence(F.lit(0), F.octet_length("x") - length)).alias("i"))
    number = lambda from_, n: F.conv(F.hex(F.substring("x", from_, F.lit(n))), 16, 10).cast("long")  # noqa: E731  four bytes at most
    first, rest = min(length, 4), max(length - 4, 0)
    ranks = _ranked(at.select("doc_id", "sub", "i", number(F.col("i") + 1, first).alias("a"), (number(F.col("i") + 1 + first, rest) if rest else F.lit(0).cast("long")).alias("b")))
    while length < threshold:
        step = min(length, threshold - length)
        later = ranks.select("doc_id", "sub", (F.col("i") - step).alias("i"), F.col("r").alias("b"))
        ranks, length = _ranked(ranks.withColumnRenamed("r", "a").join(later, ["doc_id", "sub", "i"])), length + step
    # Of the repeated strings all but the earliest go.
    lead = ranks.groupBy("r").agg(F.min(F.struct("doc_id", "i")).alias("lead"))
    gone = ranks.join(lead, "r").where(F.struct("doc_id", "i") != F.col("lead")).select("doc_id", "sub", repeats.packed(F.col("i").cast("long"), F.col("i"), F.col("i")).alias("place"))
    return repeats.apply(docs, gone, _kept(threshold, with_text), KEPT)


def _kept(threshold: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(2)
            for t in V.chunks(batch.column(1)):
                n, removed, spans, kept, sha = np.diff(t.off), [], [], [], []
                for i in range(t.rows):
                    raw = t.data[t.off[i] : t.off[i + 1]]
                    place = places[t.first + i]
                    if place.is_valid:
                        out = repeats.covered(len(raw), np.asarray(place.values), threshold)
                        removed.append(int(out.sum()))
                        spans.append(int(out[0]) + int((out[1:] & ~out[:-1]).sum()) if len(out) else 0)
                        raw = raw[~out]
                    else:
                        removed.append(0)
                        spans.append(0)
                    raw = raw.tobytes()
                    kept.append(raw if with_text else None)
                    sha.append(hashlib.sha256(raw).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.rows), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha, pa.string())], names=KEPT.fieldNames())

    return run


def deduplicate(docs: DataFrame, threshold: int = 100, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: byte counts, removed runs, the remaining bytes (unless not wanted) and their digest."""
    docs, total = repeats.identified(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    matched = docs.where("doc_id is not null")
    assert threshold >= 8, "places are told apart by eight bytes"
    first = repeats.run_blocks(matched, repeats.Bytes, threshold, min(FIRST_NAME, threshold), total, earlier=True)
    gone, _ = repeats.verdicts(matched, first, repeats.Bytes, threshold, total, earlier=True)
    return repeats.apply(docs, gone, _kept(threshold, with_text), KEPT)
