"""Token ids as Parquet list columns, and selective reads of them.

Texts are range-partitioned and sorted by id, encoded, and each partition is one
file: ids as a dictionary- or delta-encoded list column, the id of the text, its
length in ids, the shard and the count of ids before it in the shard. Row groups,
pages and page row counts are set by the caller; Parquet's column and offset
indexes let a reader skip pages by ``doc_id`` and read metadata without ids.

Encoding uses the tokenizers library on whole texts cut at ASCII white space: the
tokenizer drops white space and no token, normalisation or special string of it
spans one, so the ids are those of the whole text. Distinct words are encoded
once and kept in a bounded cache.

Null text: no ids but the end id. A null id sorts first; rows of equal id are
ordered by text, and rows equal in both in either order, which gives the same files. Extra columns are
ignored. No text is cut, however long. Empty table: no rows and no ids.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import vectext as V

CACHE_WORDS = 1_500_000

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("shard_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ]
)


#: The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: White space beyond ASCII's, controls, and capitals whose lower case depends on context or is not one letter.
_ODD = regex.compile(r"[\s\p{C}\u03a3\u0130]")


def _is_known_form(spec: dict) -> bool:
    """Does the file normalise by NFC, white space and lower case, and cut by one pattern before byte-level merges?"""
    kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        kinds == ["NFC", "Replace", "Lowercase"]
        and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
        and "Regex" in cuts[0]["pattern"]
        and not cuts[1]["add_prefix_space"]
        and not cuts[1]["use_regex"]
        and all(a["content"].startswith("<|") for a in spec.get("added_tokens", []))
    )


class WordCache:
    """Sorted word hashes (and a second hash of each, to tell words of one hash apart) with the words' ids end to end."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path) as f:
            spec = json.load(f)
        self.plain = _is_known_form(spec)
        if self.plain:
            self.piece = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.clear()

    def word_ids(self, word: str) -> list[int] | None:
        """Ids of a word straight from the tokenizer's merge model, or None where its
        normaliser may do more than lower-casing (the caller then runs the whole tokenizer)."""
        if not self.plain or "<|" in word or _ODD.search(word) or not unicodedata.is_normalized("NFC", word):
            return None
        word = word.lower()
        if word.isascii():
            return [x.id for p in self.piece.findall(word) for x in self.model.tokenize(p)]
        return [x.id for p in self.piece.findall(word) for x in self.model.tokenize(p.encode().decode("latin-1").translate(_BYTE_CHARS))]

    def clear(self) -> None:
        self.known, self.at, self.n, self.flat = np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.more = np.zeros(1, np.uint64)

    def learn(self, raw: bytes, hashed: np.ndarray, more: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        if len(self.known) > CACHE_WORDS:
            self.clear()
        words = [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]
        got = [self.word_ids(w) for w in words]
        rest = [i for i, g in enumerate(got) if g is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False) if rest else ()):
            got[i] = e.ids
        n = np.fromiter(map(len, got), np.int64, len(got))
        at = np.cumsum(n) - n + len(self.flat)
        self.flat = np.concatenate([self.flat, np.fromiter((x for g in got for x in g), np.int32, int(n.sum()))])
        hashed = np.concatenate([self.known, hashed])
        order = np.argsort(hashed, kind="stable")
        self.known, self.at, self.n = hashed[order], np.concatenate([self.at, at])[order], np.concatenate([self.n, n])[order]
        self.more = np.concatenate([self.more, more])[order]

    def look_up(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.known, hashed), len(self.known) - 1)
        return at, self.known[at] == hashed

    def encode(self, t: V.Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, row limits)."""
        w = V.Words(t)
        hashed, more = w.lanes(t)
        unique, where, back = np.unique(hashed, return_index=True, return_inverse=True)
        at, found = self.look_up(unique)
        for _ in range(2):  # again if learning cleared the cache
            if found.all():
                break
            new = ~found
            self.learn(t.data.tobytes(), unique[new], more[where[new]], w.start[where[new]], w.end[where[new]])
            at, found = self.look_up(unique)
        if (self.more[at][back] != more).any():  # two words of one hash: without the cache
            rows = [e.ids for e in self.tokenizer.encode_batch_fast([t.text(i).decode() for i in range(t.rows)], add_special_tokens=False)]
            return np.array([x for r in rows for x in r], np.int32), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        n, first = self.n[at][back], self.at[at][back]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.flat[V.ragged(first, n)], ends[w.row]


_caches: dict[str, WordCache] = {}


def cache(path: str) -> WordCache:
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows in ascending id order, one range of ids a partition, with their ids and place in the shard.

    Texts are shuffled once, before they are encoded, so that range sampling costs no encoding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, shard, before = cache(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for t in V.chunks(batch.column(1)):
                ids, limits = c.encode(t)
                n = np.diff(limits)
                out = np.empty(len(ids) + t.rows, np.int32)
                ends = limits[1:] + np.arange(t.rows)
                keep = np.ones(len(out), dtype=bool)
                keep[ends] = False
                out[keep] = ids
                out[ends] = end_id
                n = n + 1
                start = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(t.first, t.rows).cast(pa.int64()),
                        pa.array(np.full(t.rows, shard), pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(out)),
                    ],
                    names=SCHEMA.fieldNames(),
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA)


def write(frame: DataFrame, path: str, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2_000, dictionary: bool = True) -> None:
    """The file format: zstd Parquet; without ``dictionary``, version 2 pages give delta-packed ids."""
    (
        frame.write.option("compression", "zstd")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("parquet.page.row.count.limit", str(page_rows))
        .option("parquet.enable.dictionary", str(dictionary).lower())
        .option("parquet.dictionary.page.size", str(1 << 20))
        .option("parquet.writer.version", "PARQUET_1_0" if dictionary else "PARQUET_2_0")
        .parquet(path)
    )


def read(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows with ``low <= doc_id <= high``; only the named columns are read, and only pages whose ids overlap."""
    frame = spark.read.schema(SCHEMA).parquet(path)
    if low is not None:
        frame = frame.where(F.col("doc_id") >= low)
    if high is not None:
        frame = frame.where(F.col("doc_id") <= high)
    return frame.select(*columns) if columns else frame


CRC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("shard_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(4)
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        values = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        limits = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        crc = [zlib.crc32(values[a:b]) for a, b in zip(limits[:-1].tolist(), limits[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(np.diff(limits), pa.int64()), pa.array(crc, pa.int64())], names=CRC.fieldNames())


def starts(spark: SparkSession, path: str) -> DataFrame:
    """Count of ids before each shard: metadata columns only, a row a file."""
    from pyspark.sql import Window

    per = read(spark, path, columns=["shard", "n_tokens"]).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return per.select("shard", F.coalesce(before, F.lit(0)).alias("shard_base"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per text, from the files: ids before it, its ids and their crc32."""
    rows = read(spark, path).mapInArrow(_crc, CRC)
    return rows.join(starts(spark, path), "shard").select("doc_id", (F.col("shard_base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32", "shard")
