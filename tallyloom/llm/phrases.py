"""Substring dedup by repeated-phrase automata.

1. Confirm: the phrases (``PHRASE`` words) that stand for windows of ``size`` words (the
   window's anchor, see :mod:`tallyloom.llm.repeats`) are counted over all documents; those
   that occur again are confirmed. A window whose phrase occurs once is unique.
2. Compile: documents are dealt to shards of about ``SHARD_BYTES`` of text, and the confirmed
   phrases of a shard's documents, as strings, are compiled into its Aho-Corasick automaton. So
   an automaton stays as large as its shard, however many phrases the corpus has.
3. Stream: every document runs through its shard's automaton, which locates every occurrence
   of a confirmed phrase on word limits. Only windows around a located phrase go on; a text
   without a hit loses nothing.
4. Windows so located are compared over all documents, whole stretches of them at once where
   they are equal, and those whose word sequence also starts anywhere else, in the same document
   too, are removed. Windows are judged on the input.

Null or empty text: no words. Null id: matched among the others like any id; each
text of null id for itself. Rows repeated under one id are copies of each other where
their texts are equal, and apart where they differ. Texts shorter than the window are
kept; texts of any length are read whole. Of equal windows none has precedence: all
of them go. Empty table: no rows. Extra columns are ignored. The id -2**62 stands for null
inside and comes back as null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import repeats, store
from tallyloom.llm import vectext as V

PHRASE = 8
#: Text of a shard of documents; its automaton takes about 20 times that in memory.
SHARD_BYTES = 2 << 20

KEPT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()),
        T.StructField("kept_sha256", T.StringType()),
    ]
)


NO_ID = -(1 << 62)


def joined(t: V.Texts, w: V.Words) -> tuple[np.ndarray, np.ndarray]:
    """All words of a chunk, each after one space and rows closed by two, as bytes, and each word's place in that."""
    n = w.end - w.start
    row_of = np.searchsorted(w.row, np.arange(len(n)), "right") - 1
    lead = np.cumsum(n + 1) - (n + 1) + 2 * row_of
    out = np.full(int((n + 1).sum()) + 2 * t.rows + 2, 32, np.uint8)
    out[V.ragged(lead + 1, n)] = t.data[V.ragged(w.start, n)]
    return out, lead


FOUND = T.StructType([T.StructField("name", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("phrase", T.BinaryType())])


def _phrases(size: int):
    """(name, shard, count, phrase) of the phrases that stand for the windows of each chunk and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = batch.column(0).to_numpy()
            for t in V.chunks(batch.column(1), repeats.CHUNK):
                w = V.Words(t)
                out, lead = joined(t, w)
                for u, limits, base in repeats.pieces(w.hashes(t), w.row, size):
                    row, _, _, anchor, name, _, _ = repeats.runs(u, limits, size, PHRASE)
                    if not len(row):
                        continue
                    first = limits[row] + base + anchor
                    shard = shards[t.first + row]
                    # A phrase that stands for several runs in a row at one place occurs once there.
                    _, at = np.unique(first, return_index=True)
                    first, shard, name = first[at], shard[at], name[at]
                    order = np.lexsort((name, shard))
                    first, shard, name = first[order], shard[order], name[order]
                    new = np.ones(len(first), dtype=bool)
                    new[1:] = (name[1:] != name[:-1]) | (shard[1:] != shard[:-1])
                    starts = np.flatnonzero(new)
                    first = first[starts]
                    last = first + PHRASE - 1
                    n = lead[last] + 1 + (w.end - w.start)[last] + 1 - lead[first]
                    text = out[V.ragged(lead[first], n)].tobytes()
                    limits_ = pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                    strings = pa.Array.from_buffers(pa.binary(), len(n), [None, limits_, pa.py_buffer(text)])
                    counts = np.diff(np.append(starts, len(new))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(name[starts].view(np.int64)), pa.array(shard[starts], pa.int32()), pa.array(counts), strings], names=FOUND.fieldNames())

    return run


def compiled(phrases: list[bytes]) -> ahocorasick.Automaton | None:
    """The automaton of the phrases; None if there are none."""
    if not phrases:
        return None
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for p in phrases:
        p = p.decode("latin-1")  # a character a byte: places are bytes
        automaton.add_word(p, len(p))
    automaton.make_automaton()
    return automaton


def locate(automaton: ahocorasick.Automaton | None, text: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Stream a chunk through the automaton: at which of its words a phrase starts."""
    hit = np.zeros(len(lead), dtype=bool)
    if automaton is not None and len(lead):
        # Longer phrases that end together are all reported. Each starts with the space before a word.
        found = np.unique(np.fromiter((end + 1 - n for end, n in automaton.iter(text.tobytes().decode("latin-1"))), np.int64))
        hit[np.searchsorted(lead, found)] = True
    return hit


def _stream(size: int, buckets: int):
    """Blocks of the runs of one shard's documents that its automaton locates."""

    def run(docs: pa.Table, phrases: pa.Table) -> Iterator[pa.RecordBatch]:
        automaton, seen = compiled(phrases["phrase"].to_pylist()), repeats.Seen()
        for batch in docs.to_batches():
            ids, subs = batch.column("doc_id").to_numpy(), batch.column("sub").to_numpy()
            for t in V.chunks(batch.column("text"), repeats.CHUNK):
                w = V.Words(t)
                hit = locate(automaton, *joined(t, w))
                if not hit.any():
                    continue
                for u, limits, base in repeats.pieces(w.hashes(t), w.row, size):
                    row, lo, hi, anchor, name, whole, more = repeats.runs(u, limits, size, PHRASE)
                    keep = hit[limits[row] + base + anchor]
                    row, lo, hi, anchor, name, whole, more = (x[keep] for x in (row, lo, hi, anchor, name, whole, more))
                    if len(row):
                        yield repeats.blocks(ids[t.first + row], subs[t.first + row], repeats.packed(lo + base, hi + base, anchor + base), name, whole, more, buckets, False, seen)

    return run


def located(docs: DataFrame, size: int, total: int) -> tuple[DataFrame, str]:
    """The blocks of all runs around a located phrase of (doc_id, sub, text), and the path of the confirmed phrases."""
    shards = max(1, int(total // SHARD_BYTES) + 1)
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))
    every = dealt.select("shard", "text").mapInArrow(_phrases(size), FOUND).groupBy("name", "shard").agg(F.sum("n").alias("n"), F.min("phrase").alias("phrase"))
    every, every_path = store.written(every, "phrases")
    confirmed = every.groupBy("name").agg(F.sum("n").alias("times")).where("times > 1").select("name")
    wanted, wanted_path = store.written(every.join(confirmed, "name").select("shard", "phrase"), "phrases-confirmed")
    store.remove(docs.sparkSession, every_path)

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        got = list(stream(left, right))
        return pa.Table.from_batches(got) if got else repeats.no_blocks()

    stream = _stream(size, repeats.bucket_count(total))
    return dealt.select("shard", "doc_id", "sub", "text").groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(run, repeats.BLOCK), wanted_path


def deduplicate(docs: DataFrame, size: int = 35, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: word counts, the kept words joined by one space (unless not wanted) and their digest."""
    named, total = repeats.identified(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text")))
    first, path = located(named, size, total)
    gone, _ = repeats.verdicts(named, first, repeats.Words, size, total, earlier=False)
    store.remove(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(2)
            for t in V.chunks(batch.column(1)):
                w = V.Words(t)
                raw = t.data.tobytes()
                removed, kept, sha = [], [], []
                for i in range(t.rows):
                    a, b = w.row[i], w.row[i + 1]
                    starts, ends = w.start[a:b], w.end[a:b]
                    place = places[t.first + i]
                    gone_n = 0
                    if place.is_valid:
                        out = repeats.covered(b - a, np.asarray(place.values), size)
                        gone_n = int(out.sum())
                        starts, ends = starts[~out], ends[~out]
                    joined = b" ".join([raw[x:y] for x, y in zip(starts.tolist(), ends.tolist())])
                    removed.append(gone_n)
                    kept.append(joined.decode() if with_text else None)
                    sha.append(hashlib.sha256(joined).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.rows), pa.array(w.n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())], names=KEPT.fieldNames())

    done = repeats.apply(named, gone, run, KEPT)
    return done.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
