"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

Pre-tokenisation uses no regex. Every code point becomes a class, every class a
transition function over eight states, and the functions are composed by an
associative scan (doubling steps, each over the positions whose composed
function is not constant yet; three letters in a row are constant already).
State before a character, its class and the next class decide whether a token
starts there. This equals the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

Slices are hashed as spans of the flat byte array, made unique, looked up in a
bounded cache by their bytes, and the unseen ones are merged together: one
round of array operations merges the lowest-ranked pair of every slice at once.

Null text: an empty text with no ids. Null ids and repeated rows: each row is
treated alone. Extra columns are ignored. A text of any length is encoded whole.
Empty table: no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyloom.llm import vectext as V

# Classes and states of the scan.
LETTER, NUMBER, OTHER, SPACE, WHITE, APOS1, APOS2 = range(7)
S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_WHITE, S_TWO, S_ONE, S_FRESH = range(8)
#: Code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CACHE_SLICES = 1_500_000
LONG_SLICE = 48
#: Bytes of text encoded together.
CHUNK = 1 << 20


@lru_cache(maxsize=None)
def classes() -> np.ndarray:
    """Class of each code point."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE_SPACE] = WHITE
    table[0x20] = SPACE
    return table


@lru_cache(maxsize=None)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Functions closed under composition: (index by class, table ``then[f, g]`` of f first, constant value or -1, index by values)."""
    by_class = {
        LETTER: tuple({S_TWO: S_ONE, S_ONE: S_FRESH}.get(s, S_LETTER) for s in range(8)),
        NUMBER: (S_NUMBER,) * 8,
        OTHER: (S_OTHER,) * 8,
        SPACE: (S_SPACE,) * 8,
        WHITE: (S_WHITE,) * 8,
        APOS1: tuple(S_OTHER if s in (S_OTHER, S_SPACE) else S_ONE for s in range(8)),
        APOS2: tuple(S_OTHER if s in (S_OTHER, S_SPACE) else S_TWO for s in range(8)),
    }
    known = {f: i for i, f in enumerate(dict.fromkeys([*((s,) * 8 for s in range(8)), *by_class.values()]))}
    grew = True
    while grew:
        grew = False
        for f in list(known):
            for g in list(known):
                h = tuple(g[x] for x in f)
                if h not in known:
                    known[h] = len(known)
                    grew = True
    listed = list(known)
    then = np.array([[known[tuple(g[x] for x in f)] for g in listed] for f in listed], np.uint8)
    const = np.array([f[0] if len(set(f)) == 1 else -1 for f in listed], np.int8)
    return np.array([known[by_class[c]] for c in range(7)], np.uint8), then, const, known


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where tokens start, as code point indices; ``first`` are the rows' first code points."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    is_first = np.zeros(n + 1, dtype=bool)
    is_first[first[first < n]] = True
    is_first[n] = True
    c = classes()[points]
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        padded = np.append(points, [0, 0]).astype(np.uint32)
        ends = np.append(is_first, True)
        one, two = padded[quote + 1], padded[quote + 2]
        ok1 = ~ends[quote + 1]
        ok2 = ok1 & ~ends[np.minimum(quote + 2, n)]
        c[quote[ok1 & np.isin(one, [ord(x) for x in "stmd"])]] = APOS1
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        c[quote[ok2 & pair]] = APOS2
    by_class, then, const, known = monoid()
    f = by_class[c]
    start_const = np.array([known[(listed[S_FRESH],) * 8] for listed in known], np.uint8)  # applied to the fresh state
    f[is_first[:n]] = start_const[f[is_first[:n]]]
    d = 1
    active = np.flatnonzero(const[f] < 0)
    while len(active):
        f[active] = then[f[active - d], f[active]]
        active = active[const[f[active]] < 0]
        d *= 2
    state = const[f]
    before = np.empty(n, np.int8)
    before[0] = S_FRESH
    before[1:] = state[:-1]
    before[is_first[:n]] = S_FRESH
    white = (c == SPACE) | (c == WHITE)
    last = np.empty(n, dtype=bool)  # the next character is in the row and not white
    last[-1] = False
    last[:-1] = ~white[1:] & ~is_first[1:n]
    starts = _STARTS[c, before]
    starts |= white & last
    return np.flatnonzero(starts)


#: Does a token start, by class and state before.
_STARTS = np.zeros((7, 8), dtype=bool)
_STARTS[LETTER, [S_NUMBER, S_OTHER, S_WHITE, S_FRESH]] = True
_STARTS[NUMBER] = True
_STARTS[NUMBER, [S_NUMBER, S_SPACE]] = False
for _c in (OTHER, APOS1, APOS2):
    _STARTS[_c] = True
    _STARTS[_c, [S_OTHER, S_SPACE]] = False
for _c in (SPACE, WHITE):
    _STARTS[_c] = True
    _STARTS[_c, [S_SPACE, S_WHITE]] = False


class Vocabulary:
    """Ranks of a tiktoken file, with every split of a token into two tokens as a pair to merge."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line)}
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.length = np.fromiter(map(len, self.tokens), np.int64, size)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.size = size
        get, pairs = self.ranks.get, {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * size + b] = rank
        order = np.array(sorted(pairs), np.int64)
        self.pair, self.pair_rank = order, np.array([pairs[k] for k in order.tolist()], np.int32)
        two = np.full((256, 256), size, np.int32)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                two[token[0], token[1]] = rank
        self.of_two = two
        self.clear()

    def clear(self) -> None:
        """The cache: sorted slice hashes with their ids end to end; first those of whole tokens."""
        end = self.start + self.length
        hashed = V.string_hashes(self.bytes, self.start, end)[0]
        order = np.argsort(hashed)
        self.known, self.known_at = hashed[order], order.astype(np.int64)
        self.known_n = np.ones(len(order), np.int32)
        self.flat = np.arange(self.size, dtype=np.int32)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's union, ``size`` where it is no token; a negative id is padding."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.pair[at] == key), self.pair_rank[at], self.size)

    def merge_together(self, raw: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode short slices (rows of ``raw``, lengths ``n``), a merge of each in every round: ids end to end, counts."""
        wide = raw.shape[1]
        inside = np.arange(wide) < n[:, None]
        done = np.where(inside, self.of_byte[raw], -1).astype(np.int32)
        if wide > 1:
            ids, rows = done.copy(), np.arange(len(done))
            ranks = np.where(inside[:, 1:], self.of_two[raw[:, :-1], raw[:, 1:]], self.size)
            cols = np.arange(wide)
            while len(rows):
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(rows)), at]
                over = best == self.size
                if over.any():
                    done[rows[over]] = ids[over]
                    stay = ~over
                    rows, ids, ranks, at, best = rows[stay], ids[stay], ranks[stay], at[stay], best[stay]
                    if not len(rows):
                        break
                k = np.arange(len(rows))
                right_of = cols > at[:, None]
                ids[:, :-1] = np.where(right_of[:, :-1], ids[:, 1:], ids[:, :-1])
                ids[:, -1] = -1
                ids[k, at] = best
                ranks[:, :-1] = np.where(right_of[:, :-2], ranks[:, 1:], ranks[:, :-1])
                ranks[:, -1] = self.size
                here = at < wide - 1
                ranks[k[here], at[here]] = self.rank_of(best[here], ids[k[here], at[here] + 1])
                here = at > 0
                ranks[k[here], at[here] - 1] = self.rank_of(ids[k[here], at[here] - 1], best[here])
        kept = done >= 0
        return done[kept], kept.sum(axis=1)

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Encode one long slice with a heap of pairs, leftmost first among equals."""
        ids = [int(self.of_byte[b]) for b in piece]
        n = len(ids)
        tokens, get = self.tokens, self.ranks.get
        left, right, live = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(tokens[ids[i]] + tokens[ids[i + 1]])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not live[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], right[i] = r, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q >= 0 and (s := get(tokens[ids[p]] + tokens[ids[q]])) is not None:
                    heapq.heappush(heap, (s, p, ids[p], ids[q]))
        return np.array([x for x, ok in zip(ids, live) if ok], np.int64)

    def learn(self, data: np.ndarray, hashed: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Encode slices that the cache lacks and add them."""
        if len(self.known) > CACHE_SLICES:
            self.clear()
        n = end - start
        long = n > LONG_SLICE
        group = np.where(long, -1, (n + 1) // 2)
        got_n, got_ids, got_hash = [], [], []
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            if g < 0:
                for i in rows:
                    ids = self.merge_long(data[start[i] : end[i]].tobytes())
                    got_ids.append(ids.astype(np.int32))
                    got_n.append(np.array([len(ids)]))
                    got_hash.append(hashed[i : i + 1])
                continue
            wide = int(n[rows].max())
            ids, count = self.merge_together(data[np.minimum(start[rows][:, None] + np.arange(wide), len(data) - 1)], n[rows])
            got_ids.append(ids)
            got_n.append(count)
            got_hash.append(hashed[rows])
        count = np.concatenate(got_n)
        at = np.cumsum(count) - count + len(self.flat)
        self.flat = np.concatenate([self.flat, *got_ids])
        hashed = np.concatenate([self.known, *got_hash])
        order = np.argsort(hashed, kind="stable")
        self.known = hashed[order]
        self.known_at = np.concatenate([self.known_at, at])[order]
        self.known_n = np.concatenate([self.known_n, count.astype(np.int32)])[order]

    def look_up(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the cache, found)."""
        at = np.minimum(np.searchsorted(self.known, hashed), len(self.known) - 1)
        return at, self.known[at] == hashed

    def encode_slices(self, data: np.ndarray, hashed: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct slices, as (count, place of the first in ``flat``)."""
        at, found = self.look_up(hashed)
        if not found.all():
            new = ~found
            self.learn(data, hashed[new], start[new], end[new])
            at, found = self.look_up(hashed)
            if not found.all():  # the cache was cleared first
                new = ~found
                self.learn(data, hashed[new], start[new], end[new])
                at, _ = self.look_up(hashed)
        return self.known_n[at].astype(np.int64), self.known_at[at]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a local rank file, read once per worker."""
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = Vocabulary(f.read())
    return _loaded[path]


def encode_texts(t: V.Texts, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, byte offset of each id in its text, row limits into ids) of a chunk."""
    data = t.data
    point_at = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.searchsorted(point_at, t.off[:-1])
    start = point_at[boundaries(points, first)]
    end = np.append(start[1:], len(data)).astype(np.int64)
    hashed = V.string_hashes(data, start, end)[0]
    _, where, back = np.unique(hashed, return_index=True, return_inverse=True)
    count, lead = vocab.encode_slices(data, hashed[where], start[where], end[where])
    ids = vocab.flat[V.ragged(lead[back], count[back])]
    length = vocab.length[ids]
    at = np.cumsum(length) - length
    limits = np.searchsorted(at, t.off)
    limits[-1] = len(ids)
    # An id that starts where empty rows lie belongs to the last row that starts there.
    offsets = at - np.repeat(t.off[:-1], np.diff(limits))
    return ids, offsets, limits


def decode_ids(ids: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """The bytes of the ids, end to end."""
    return vocab.bytes[V.ragged(vocab.start[ids], vocab.length[ids])]


def checked(t: V.Texts, vocab: Vocabulary):
    """Encode and decode a chunk. Should two slices ever share a hash, the decoded
    bytes differ from the text, and its rows' slices are merged one at a time."""
    ids, offsets, limits = encode_texts(t, vocab)
    decoded = decode_ids(ids, vocab)
    if not np.array_equal(decoded, t.data):
        parts, off, lim = [], [], [0]
        for i in range(t.rows):
            raw = t.text(i)
            points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
            at = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[boundaries(points, np.zeros(1, np.int64))].tolist()
            got = [[vocab.ranks[p]] if (p := raw[a:b]) in vocab.ranks else vocab.merge_long(p).tolist() for a, b in zip(at, [*at[1:], len(raw)])]
            got = np.array([x for g in got for x in g], np.int64)
            parts.append(got)
            off.append(np.cumsum(vocab.length[got]) - vocab.length[got])
            lim.append(lim[-1] + len(got))
        ids, offsets, limits = np.concatenate(parts), np.concatenate(off), np.array(lim)
        decoded = decode_ids(ids, vocab)
    return ids.astype(np.uint32), offsets, limits, decoded


ENCODED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        T.StructField("offsets", T.ArrayType(T.IntegerType(), False)),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("round_trip", T.BooleanType()),
    ]
)


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids, their byte offsets and a decoding check of every text. A map over the scan, no shuffle.

    ``ranks_path`` is a file that every worker can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks_path)
        for batch in batches:
            for t in V.chunks(batch.column(1), CHUNK):
                ids, offsets, limits, decoded = checked(t, vocab)
                lists = [pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(x.astype(np.int32))) for x in (ids, offsets)]
                parts = [decoded[a:b].tobytes() for a, b in zip(t.off[:-1], t.off[1:])]
                sha = [hashlib.sha256(x).hexdigest() for x in parts]
                same = [x == t.text(i) for i, x in enumerate(parts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.rows).cast(pa.int64()), *lists, pa.array(np.diff(limits), pa.int64()), pa.array(sha), pa.array(same)], schema=_arrow(ENCODED))

    return docs.select(id_col, text_col).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data): the bytes that the ids stand for. Null ids: empty bytes."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks_path)
        for batch in batches:
            out = [decode_ids(np.array(x.as_py() or [], np.int64), vocab).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "data"])

    return encoded.select(id_col, ids_col).mapInArrow(run, schema)


DIGEST = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode, and digest both; the id lists stay in the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks_path)
        for batch in batches:
            for t in V.chunks(batch.column(1), CHUNK):
                ids, _, limits, decoded = checked(t, vocab)
                ids = ids.astype("<u4")
                rows = list(zip(limits[:-1].tolist(), limits[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(t.first, t.rows).cast(pa.int64()),
                        pa.array(np.diff(limits), pa.int64()),
                        pa.array([hashlib.sha256(ids[a:b]).hexdigest() for a, b in rows], pa.string()),
                        pa.array([hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(t.off[:-1].tolist(), t.off[1:].tolist())], pa.string()),
                    ],
                    names=DIGEST.fieldNames(),
                )

    return docs.select(id_col, text_col).mapInArrow(run, DIGEST)


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.ArrayType(T.IntegerType(), False): pa.list_(pa.int32())}
    return pa.schema([(f.name, kinds[f.dataType]) for f in schema])
