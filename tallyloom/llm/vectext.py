"""Arrow batches of text as flat byte arrays, and hashes over them.

All kernels work on one numpy array that holds the bytes of many texts end to
end, so there is no Python loop over words. Words are hashed eight bytes at a
time by a multiply-and-shift mixer, in one or two independent lanes of 64 bits.
Windows that slide over units (words, or the eight bytes from each place) are
hashed by differences of prefix sums ``S[i] = sum(u * B**i)`` modulo 2**64,
normalised by the inverse power of their start and mixed. Units are mixed values,
never plain bytes, so that patterns of two letters do not cancel in the sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
#: Odd, so that they have inverses modulo 2**64; one a lane.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_BASE = _BASES[0]
_U = np.uint64


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``B**i`` and ``B**-i`` for i < n, kept per worker and grown on demand."""
    if lane not in _powers or len(_powers[lane][0]) < n:
        size, both = max(n, (1 << 20) + 4096), []
        for base in (_BASES[lane], pow(_BASES[lane], -1, 1 << 64)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _powers[lane] = tuple(both)
    up, down = _powers[lane]
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def prefix(u: np.ndarray, lane: int = 0) -> np.ndarray:
    """Prefix sums of units, length ``len(u) + 1``."""
    up, _ = powers(len(u) + 1, lane)
    s = np.zeros(len(u) + 1, np.uint64)
    np.cumsum(u * up[:-1], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of the units ``start`` to ``end``; their number takes part."""
    _, down = powers(len(s), lane)
    return mix((s[end] - s[start]) * down[start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_STEPS = ((_U(0x9FB21C651E98DF25), _U(0xD6E8FEB86659FD93)), (_U(0xC2B2AE3D27D4EB4F), _U(0xA24BAED4963EE407)))
#: Strings above this length are hashed one at a time.
LONG_STRING = 1 << 14


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def string_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lanes: int = 1) -> list[np.ndarray]:
    """64-bit hashes of ``data[start:end]``, a list of lanes."""
    size = end - start
    out = [(size.astype(np.uint64) + _U(1)) * _STEPS[k][1] for k in range(lanes)]
    whole = np.flatnonzero(size > LONG_STRING)
    at, left, rows = start.copy(), np.where(size > LONG_STRING, 0, size), np.arange(len(size))
    view = eights(data)
    rows = rows[left > 0]
    while len(rows):
        part = view[at[rows]] & _MASKS[np.minimum(left[rows], 8)]
        for k in range(lanes):
            x = (out[k][rows] ^ part) * _STEPS[k][0]
            x ^= x >> _U(32)
            x *= _STEPS[k][1]
            x ^= x >> _U(29)
            out[k][rows] = x
        at[rows] += 8
        left[rows] -= 8
        rows = rows[left[rows] > 0]
    for i in whole:
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=16).digest()
        for k in range(lanes):
            out[k][i] = int.from_bytes(digest[8 * k : 8 * k + 8], "little")
    return [mix(x) for x in out]


class Texts:
    """Some rows of a string column: ``data`` bytes, ``off`` row limits (rows + 1)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, first: int):
        self.data, self.off, self.first, self.rows = data, off, first, len(off) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row limits of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, limits, values = column.buffers()
    if len(column) == 0 or limits is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(limits, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Runs of whole rows of about ``limit`` bytes; a longer row is a chunk of its own."""
    data, off = flat(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield Texts(data[off[a] : off[b]], off[a : b + 1] - off[a], a)
        a = b


def slices(batches: Iterator[pa.RecordBatch], at: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of about ``limit`` bytes of text column ``at``: what is made of a run is as small."""
    for batch in batches:
        for t in chunks(batch.column(at), limit):
            yield batch.slice(t.first, t.rows)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all rows: limits, and ``row`` limits into them."""

    def __init__(self, t: Texts):
        inside = np.zeros(len(t.data) + 2, dtype=np.int8)
        inside[1:-1] = ~_SPACE[t.data]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # A word that runs over a row limit is two words.
        cut = t.off[1:-1]
        cut = cut[(cut > 0) & (cut < len(t.data))]
        if len(cut):
            cut = np.unique(cut)
            cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
        self.start, self.end = start, end
        self.row = np.searchsorted(start, t.off)
        self.n = np.diff(self.row)

    def lanes(self, t: Texts, fold_case: bool = False, lanes: int = 2) -> list[np.ndarray]:
        return string_hashes(_LOWER[t.data] if fold_case else t.data, self.start, self.end, lanes)

    def hashes(self, t: Texts, fold_case: bool = False) -> np.ndarray:
        return self.lanes(t, fold_case, 1)[0]


def gram_hash(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes (length ``len(w) - k + 1``)."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _U(_BASE)
        out += w[j : j + n]
    return mix(out)


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices start[i], start[i] + 1, ... (count[i] of them), end to end."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    lead = np.cumsum(count) - count
    return np.repeat(start - lead, count) + np.arange(total)
