"""Repeated windows of a fixed length, found exactly from sampled positions.

Texts are sequences of units (bytes or words). A window is ``T`` consecutive units
of one text. Its anchor is the leftmost least hash among the ``k``-unit strings in
it, so equal windows have equal anchors at equal places. Windows in a row that
share an anchor make a run; about one run per ``(T - k) / 2`` units.

Naming in rounds, each round only over what the round before left:

* round 1, length ``k``: anchors are grouped by name; an anchor that is unique
  ends there, and with it all windows of its run;
* round 2, the run's whole stretch (``T`` to ``2 T - k`` units): runs whose stretch
  is repeated are decided as a whole;
* round 3, length ``T``: where an anchor has several stretches, the windows of one
  run of each are named one by one.

Stretches and windows are told apart by 96 bits beside their bucket; an anchor's
name only says which runs are compared.

Names travel as packed blocks, one for each chunk of texts and bucket of names.
Within a chunk, and then within a task, equal stretches are combined before the
shuffle: one goes to the bucket of its name, the others (already decided) to buckets
by text, so a passage that a third of all texts hold is no hot bucket. Nor is a phrase
that they hold in ever other surroundings: its stretches are dealt by stretch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import store
from tallyloom.llm import vectext as V

PIECE = 1 << 20
#: Text whose runs are found and packed together: some twenty numbers a byte are held.
CHUNK = 1 << 20
BUCKET_BYTES = 4 << 20
WINDOWS = 1 << 19
REMOVED, EDGE = 1, 2

_U = np.uint64


class Bytes:
    """A unit a byte place: the eight bytes from there on. ``extra`` bytes of a window are no unit's start."""

    extra = 7

    @staticmethod
    def units(t: V.Texts) -> tuple[np.ndarray, np.ndarray]:
        n = np.maximum(np.diff(t.off) - 7, 0)
        return V.mix(V.eights(t.data)[V.ragged(t.off[:-1], n)]), np.concatenate([[0], np.cumsum(n)])


class Words:
    """A unit a word."""

    extra = 0

    @staticmethod
    def units(t: V.Texts) -> tuple[np.ndarray, np.ndarray]:
        w = V.Words(t)
        return w.hashes(t), w.row


def second(u: np.ndarray) -> np.ndarray:
    """Units of the second lane."""
    return (u ^ (u >> _U(31))) * _U(0xA24BAED4963EE407)


def sliding_min(m: np.ndarray, w: int) -> np.ndarray:
    """Least of each w in a row, by running minima within blocks from both ends."""
    n = len(m)
    blocks = -(-n // w)
    p = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    p[:n] = m
    p = p.reshape(blocks, w)
    left = np.minimum.accumulate(p, axis=1).reshape(-1)
    right = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


#: Low bits of an anchor's hash that give way to its place; no piece is longer. Equal windows so compare equal bits, whatever piece they are in.
PLACE_BITS = 22


def runs(u: np.ndarray, limits: np.ndarray, size: int, k: int):
    """(row, lo, hi, anchor, anchor name, stretch name, more of it) of each run; places from the row's start, lengths in units."""
    n = np.diff(limits)
    windows = np.maximum(n - size + 1, 0)
    if not windows.any():
        e = np.zeros(0, np.int64)
        return e, e, e, e, e.view(np.uint64), e.view(np.uint64), e.astype(np.uint32)
    s = V.prefix(u)
    _, down = V.powers(len(s))
    h = s[k:] - s[:-k]
    h *= down[: len(h)]
    h ^= h >> _U(32)
    h *= _U(0x9FB21C651E98DF25)
    h ^= h >> _U(29)
    mask = _U((1 << PLACE_BITS) - 1)
    h &= ~mask
    h |= np.arange(len(h), dtype=np.uint64)
    least = sliding_min(h, size - k + 1)
    p = V.ragged(limits[:-1], windows)
    anchor = (least[p] & mask).astype(np.int64)
    new = np.empty(len(p), dtype=bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    lo, hi, anchor = p[first], p[last], anchor[first]
    row = np.searchsorted(limits, lo, "right") - 1
    name = V.span_hash(s, anchor, anchor + k)
    whole = V.mix(V.span_hash(s, lo, hi + size) + (anchor - lo).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))
    more = V.span_hash(V.prefix(second(u), 1), lo, hi + size, 1)
    base = limits[row]
    return row, lo - base, hi - base, anchor - base, name, whole, (more >> _U(32)).astype(np.uint32)


def pieces(u: np.ndarray, limits: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Units and row limits; a long row in overlapping pieces, with their place in it."""
    if len(u) <= PIECE:
        yield u, limits, 0
        return
    for a in range(0, len(u) - size + 1, PIECE - size + 1):
        part = u[a : a + PIECE]
        yield part, np.array([0, len(part)]), a


_BINARY = ("name", "whole", "more", "doc", "sub", "place", "state")
BLOCK = T.StructType([T.StructField("bucket", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in _BINARY)])
VERDICT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("sub", T.LongType()), T.StructField("place", T.LongType()), T.StructField("kind", T.IntegerType())])

SINGLE, SEVERAL, DECIDED = 0, 1, 2
#: Bits beside these: the name is known to have several stretches; the entry only says so of its name.
KNOWN, SAYS = 4, 8
#: Stretches of one name in a chunk from which on they are dealt by stretch.
MANY = 64


def narrow(x: np.ndarray) -> bytes:
    """Numbers as differences, all first bytes, all second bytes and so on: mostly zeros, which shuffle compression drops."""
    return np.diff(x, prepend=np.zeros(1, x.dtype)).view(np.uint8).reshape(-1, 8).T.tobytes()


def widen(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1))


class Seen:
    """Stretches that a task has sent more than once, so that further ones need not go to their bucket.

    A passage that all texts hold so costs its bucket a few entries a task, not one a chunk.
    Bounded: ``LIMIT`` stretches; those beyond it are sent chunk by chunk.
    """

    LIMIT = 1 << 17
    SKETCH = 1 << 23

    def __init__(self) -> None:
        self.whole, self.more = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.doc, self.place, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.once = np.zeros(self.SKETCH, dtype=bool)
        self.said: set[int] = set()

    def decided(self, whole: np.ndarray, more: np.ndarray, doc: np.ndarray, place: np.ndarray, several: np.ndarray, earlier: bool) -> np.ndarray:
        """Which of a chunk's distinct stretches (heads, ``whole`` ascending) are settled by those sent before; the others count as sent."""
        out = np.zeros(len(whole), dtype=bool)
        if len(self.whole):
            at = np.minimum(np.searchsorted(self.whole, whole), len(self.whole) - 1)
            known = (self.whole[at] == whole) & (self.more[at] == more)
            later = (doc > self.doc[at]) | ((doc == self.doc[at]) & (place > self.place[at]))
            out = known & (later if earlier else self.times[at] > 1)
            sent = np.flatnonzero(known & ~out)
            np.add.at(self.times, at[sent], 1)
            if earlier:
                self.doc[at[sent]], self.place[at[sent]] = doc[sent], place[sent]
        else:
            known = out
        slot = (whole % _U(self.SKETCH)).astype(np.int64)
        first = np.ones(len(whole), dtype=bool)
        first[1:] = whole[1:] != whole[:-1]
        new = np.flatnonzero((self.once[slot] | several) & ~known & first)[: self.LIMIT - len(self.whole)]
        self.once[slot] = True
        if len(new):
            merged = [np.concatenate(x) for x in ((self.whole, whole[new]), (self.more, more[new]), (self.doc, doc[new]), (self.place, place[new]), (self.times, np.where(several[new], 2, 1)))]
            order = np.argsort(merged[0], kind="stable")
            self.whole, self.more, self.doc, self.place, self.times = (x[order] for x in merged)
        return out


def blocks(doc: np.ndarray, sub: np.ndarray, place: np.ndarray, name: np.ndarray, whole: np.ndarray, more: np.ndarray, buckets: int, earlier: bool, seen: Seen) -> pa.RecordBatch:
    """Combine equal stretches of a chunk and deal all to buckets. A name that is the stretch's own isn't sent.

    State DECIDED: another one sent stands for it (and it is to be removed).
    SEVERAL: it stands for others too.
    """
    alone = name is whole
    order = np.lexsort((sub, place, doc, more, whole))
    doc, sub, place, name, whole, more = (x[order] for x in (doc, sub, place, name, whole, more))
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (whole[1:] != whole[:-1]) | (more[1:] != more[:-1])
    if earlier and len(doc):
        # Rows repeated under one id are at one place: none is earlier than the other. Equal rows are one.
        again = ~new
        again[1:] &= (doc[1:] == doc[:-1]) & (place[1:] == place[:-1]) & (sub[1:] == sub[:-1])
        doc, sub, place, name, whole, more, new = (x[~again] for x in (doc, sub, place, name, whole, more, new))
    lead = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0)) if len(doc) else np.zeros(0, np.int64)
    head = (doc == doc[lead]) & (place == place[lead]) if earlier else new
    follows = np.zeros(len(doc), dtype=bool)
    follows[:-1] = ~new[1:]
    state = np.where(head, np.where(new & follows, SEVERAL, SINGLE), DECIDED).astype(np.uint8)
    at = np.flatnonzero(new)
    settled = seen.decided(whole[at], more[at], doc[at], place[at], follows[at], earlier)
    # Heads of one stretch are at one place: what settles the first settles them all.
    state[settled[np.cumsum(new) - 1]] = DECIDED
    head = state != DECIDED
    bucket = np.where(head, name % _U(buckets), V.mix(doc.view(np.uint64) + _U(17)) % _U(buckets)).astype(np.int64)
    if not alone and len(doc):
        # A name with many stretches (a common phrase in ever other surroundings) would be a hot bucket: they go to buckets
        # by stretch, all to be compared window by window, and one entry a task tells the name's bucket.
        named, times = np.unique(name[new], return_counts=True)
        hot = head & np.isin(name, named[times >= MANY])
        if hot.any():
            tell = [i for i in np.flatnonzero(hot & new).tolist() if not (int(name[i]) in seen.said or seen.said.add(int(name[i])))]
            bucket[hot] = (V.mix(whole[hot] + _U(29)) % _U(buckets)).astype(np.int64)
            state[hot] |= KNOWN
            told = (name[tell] % _U(buckets)).astype(np.int64)
            bucket = np.concatenate([bucket, told])
            doc, sub, place, name, whole, more = (np.concatenate([x, x[tell]]) for x in (doc, sub, place, name, whole, more))
            state = np.concatenate([state, np.full(len(tell), SAYS, np.uint8)])
    order = np.lexsort((place, doc, bucket))
    bucket, doc, sub, place, name, whole, more, state = (x[order] for x in (bucket, doc, sub, place, name, whole, more, state))
    at, start = np.unique(bucket, return_index=True)
    ends = np.append(start[1:], len(bucket))
    cut = lambda x, to=np.ndarray.tobytes: pa.array([to(x[a:b]) for a, b in zip(start.tolist(), ends.tolist())], pa.binary())
    short = (name[: 0 if alone else len(name)] >> _U(32)).astype(np.uint32)
    return pa.RecordBatch.from_arrays([pa.array(at), cut(short), cut(whole), cut(more), cut(doc, narrow), cut(sub, narrow), cut(place, narrow), cut(state)], names=BLOCK.fieldNames())


def no_blocks() -> pa.Table:
    return pa.table([pa.array([], pa.int64()), *[pa.array([], pa.binary())] * len(_BINARY)], names=BLOCK.fieldNames())


def resolve(earlier: bool, with_edges: bool):
    """Verdicts of one bucket: what is removed, and which runs need their windows named."""

    def run(table: pa.Table) -> pa.Table:
        raw = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind)
        wide = lambda c: np.concatenate([widen(b) for b in table[c].to_pylist()])
        name, whole, more, state = raw("name", np.uint32), raw("whole", np.uint64), raw("more", np.uint32), raw("state", np.uint8)
        doc, sub, place = wide("doc"), wide("sub"), wide("place")
        name = name if len(name) else (whole >> _U(32)).astype(np.uint32)
        decided = state == DECIDED
        says = name[state == SAYS]
        out = [(doc[decided], sub[decided], place[decided], np.full(int(decided.sum()), REMOVED))]
        live = np.flatnonzero(~decided & (state != SAYS))
        live = live[np.lexsort((sub[live], place[live], doc[live], more[live], whole[live], name[live]))]
        name, whole, more, doc, sub, place, state = (x[live] for x in (name, whole, more, doc, sub, place, state))
        n = len(live)
        if n:
            new_name = np.ones(n, dtype=bool)
            new_name[1:] = name[1:] != name[:-1]
            first = new_name.copy()
            first[1:] |= (whole[1:] != whole[:-1]) | (more[1:] != more[:-1])
            group = np.cumsum(first) - 1
            if earlier:
                lead = np.flatnonzero(first)[group]
                removed = (doc != doc[lead]) | (place != place[lead])
                edge = ~removed
            else:
                count = np.bincount(group)
                some = np.bincount(group, (state & 3) == SEVERAL) > 0
                removed = ((count > 1) | some)[group]
                edge = first
            kind = np.where(removed, REMOVED, 0)
            if with_edges:
                of_name = np.cumsum(new_name) - 1
                several = (np.bincount(of_name, first) > 1)[of_name] | ((state & KNOWN) != 0) | np.isin(name, says)
                kind |= np.where(edge & several, EDGE, 0)
            some = kind > 0
            out.append((doc[some], sub[some], place[some], kind[some]))
        columns = [np.concatenate(x) for x in zip(*out)]
        return pa.table([*map(pa.array, columns[:3]), pa.array(columns[3].astype(np.int32))], names=VERDICT.fieldNames())

    return run


def packed(lo, hi, anchor):
    """Start, windows less one and the anchor's distance in one number (arrays or columns)."""
    return lo * 65536 + (hi - lo) * 256 + (anchor - lo)


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo = place >> 16
    return lo, lo + ((place >> 8) & 255), lo + (place & 255)


#: Ids that come with several texts are told apart by a broadcast up to this number, by a join beyond it.
FEW_IDS = 100_000


def identified(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, sub, text) of every row, and the bytes of all texts.

    ``sub`` is 0, or a hash of the text where the id (null too) comes with several texts:
    places and verdicts of one of them so never reach another.
    """
    per = docs.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("text").alias("h")).groupBy("doc_id").agg(F.sum("n").alias("n"), (F.min("h") != F.max("h")).alias("odd"))
    found = per.agg(F.sum("n").alias("n"), F.sum(F.col("odd").cast("long")).alias("odd")).first()
    if not found["odd"]:
        return docs.select("doc_id", F.lit(0).cast("long").alias("sub"), "text"), found["n"] or 0
    odd = per.where("odd").select(F.col("doc_id").alias("odd_id"), "odd")
    if found["odd"] <= FEW_IDS:
        odd = F.broadcast(odd)
    rows = docs.join(odd, docs["doc_id"].eqNullSafe(F.col("odd_id")), "left")
    return rows.select("doc_id", F.when(F.col("odd"), F.xxhash64("text")).otherwise(0).alias("sub"), "text"), found["n"] or 0


def bucket_count(total: int) -> int:
    return max(1, int(total // BUCKET_BYTES) + 1)


def run_blocks(docs: DataFrame, kind: type, size: int, k: int, total: int, earlier: bool) -> DataFrame:
    """The blocks of all runs of (doc_id, sub, text)."""
    n, k, buckets = size - kind.extra, k - kind.extra, bucket_count(total)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            ids, subs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for t in V.chunks(batch.column(2), CHUNK):
                for u, limits, base in pieces(*kind.units(t), n):
                    row, lo, hi, anchor, name, whole, more = runs(u, limits, n, k)
                    if len(row):
                        yield blocks(ids[t.first + row], subs[t.first + row], packed(lo + base, hi + base, anchor + base), name, whole, more, buckets, earlier, seen)

    return docs.select("doc_id", "sub", "text").mapInArrow(names, BLOCK)


def verdicts(docs: DataFrame, first: DataFrame, kind: type, size: int, total: int, earlier: bool) -> tuple[DataFrame, list[str]]:
    """(doc_id, sub, place) of windows to remove, as packed runs, and the paths to delete when they are used up.

    ``docs`` has doc_id (not null), sub and text; ``first`` the blocks of its runs. ``earlier``:
    a window goes if its string starts earlier too (smaller id, or earlier in the text); else if
    it starts anywhere else.
    """
    n, buckets = size - kind.extra, bucket_count(total)
    assert n < 255, "the anchor's distance is kept in one byte"
    first, first_path = store.written(first.groupBy("bucket").applyInArrow(resolve(earlier, True), VERDICT), "repeats-runs")
    edges = first.where(F.col("kind").bitwiseAND(EDGE) != 0).groupBy("doc_id", "sub").agg(F.array_sort(F.collect_set("place")).alias("places"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            ids, subs, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for t in V.chunks(batch.column(2), CHUNK):
                part = lists.slice(t.first, t.rows)
                place = part.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(t.rows), part.value_lengths().to_numpy(zero_copy_only=False))
                u, limits = kind.units(t)
                lo, hi, _ = unpacked(place)
                s, more = V.prefix(u), V.prefix(second(u), 1)
                count = hi - lo + 1
                # Some hundred thousand windows at a time: a long text has many.
                cuts = np.searchsorted(np.cumsum(count), np.arange(0, count.sum(), WINDOWS)).tolist()
                for a, b in zip(cuts, [*cuts[1:], len(count)]):
                    if a == b:
                        continue
                    p = V.ragged(lo[a:b], count[a:b])
                    r = np.repeat(row[a:b], count[a:b])
                    start = limits[r] + p
                    name = V.span_hash(s, start, start + n)
                    also = (V.span_hash(more, start, start + n, 1) >> _U(32)).astype(np.uint32)
                    yield blocks(ids[t.first + r], subs[t.first + r], packed(p, p, p), name, name, also, buckets, earlier, seen)

    again = docs.join(edges, ["doc_id", "sub"]).select("doc_id", "sub", "text", "places").mapInArrow(windows, BLOCK).groupBy("bucket").applyInArrow(resolve(earlier, False), VERDICT)
    again, again_path = store.written(again, "repeats-windows")
    gone = first.where(F.col("kind").bitwiseAND(REMOVED) != 0).select("doc_id", "sub", "place").unionAll(again.select("doc_id", "sub", "place"))
    return gone, [first_path, again_path]


def covered(n: int, places: np.ndarray, size: int) -> np.ndarray:
    """Which of n bytes or words the windows of the packed runs cover."""
    lo, hi, _ = unpacked(places)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, lo, 1)
    np.add.at(change, hi + size, -1)
    return np.cumsum(change[:-1]) > 0


def apply(docs: DataFrame, gone: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """Run over (doc_id, text, places) of every row; a row without removals has null places."""
    per = gone.groupBy("doc_id", "sub").agg(F.collect_list("place").alias("places"))  # at most the text's own windows
    return docs.join(per, ["doc_id", "sub"], "left").select("doc_id", "text", "places").mapInArrow(run, schema)
