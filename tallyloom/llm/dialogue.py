"""Conversation structure repair by weighted finite-state composition.

The rows of a conversation, by turn, are an input acceptor; an edit transducer keeps (K), gives another role
(R), deletes (D) or inserts (I) rows at costs; a grammar acceptor allows the role initials ``(s?(ua)+)?``. The
three are composed lazily: a row's arcs from one grammar state to the next are made when a row of its class is first met. The
repair is the least path over weights of (cost, edit initials), costs first.

Edit initials need not be carried along a path. They determine the grammar state they lead to, and none of those that lead
over the same rows is the beginning of another, so the order (rank) of the at most four at a row decides all later comparisons.
A weight is thus (cost, rank), steps repeat and are remembered, and a run of rows is summed up by 4 x 4 such weights, which compose
associatively. So a conversation of any length is repaired in parts:

1. Rows are sorted by conversation and turn over range partitions; a conversation of a great share of all rows is many partitions.
2. A task repairs the conversations that lie within its partition as it reads them. Those at its ends, and those
   longer than a chunk (``CHUNK_ROWS`` or ``CHUNK_BYTES``), leave open chunks. For these, first occurrences are
   aggregated, each chunk gives its summary, one scan a conversation over its summaries (a row a chunk) chooses each chunk's first
   and last state, and each chunk gives its edits.

Faults, the first that holds: ``blank`` (no character but ``\\x20\\x09-\\x0D``), ``duplicate`` (role and text occurred before in the
conversation), ``truncated`` (the last other character is none of ``.!?``). Blank and duplicate rows must go.

Defined cases. A null role or text is one space. Rows of a null id are one conversation. Null turns come first; rows of one
turn by role, then by the text's md5. Equal rows are each a row (all but the first are duplicates). A role that is empty or begins
with none of s, u, a can't be kept. Texts count whole, however long. Empty table: no rows. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import store

SPACE = " \t\n\v\f\r"
CHUNK_ROWS = 1 << 16
CHUNK_BYTES = 32 << 20
#: Rows that a task gives at once.
OUT_ROWS, OUT_BYTES = 4096, 8 << 20

COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED_COST = 3
NAMES = {"u": "user", "a": "assistant"}
#: Grammar states: nothing yet, after s, after u, after a; where each initial leads.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
STATES = range(4)
#: What must be inserted after the last row.
ENDING = ("", "II", "I", "")
INITIALS = "sua"

START = ((0, 0), None, None, None)


def row_class(role: str, fault: str | None) -> int:
    """All of a row that its arcs depend on."""
    initial = INITIALS.find(role[:1]) if role else -1
    return 3 * (initial % 4) + (2 if fault in ("blank", "duplicate") else 1 if fault else 0)


def _given(state: int) -> str:
    """The one role that may be inserted, or given to a row, in a state."""
    return "a" if state == 2 else "u"


@lru_cache(maxsize=None)
def arcs(kind: int) -> tuple[tuple[int, int, int, str], ...]:
    """(state, next state, cost, edits) over a row of a class: the least for each pair of states."""
    initial, fault = divmod(kind, 3)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for state in STATES:
        at, seen, before = state, set(), ""
        while at not in seen:  # a state met again costs more than before
            seen.add(at)
            ways = [(at, "D")]
            if fault < 2:
                ways.append((GRAMMAR[at][_given(at)], "R"))
                if initial < 3 and INITIALS[initial] in GRAMMAR[at]:
                    ways.append((GRAMMAR[at][INITIALS[initial]], "K"))
            for to, edit in ways:
                weight = (sum(COST[e] for e in before + edit) + (TRUNCATED_COST if fault == 1 and edit != "D" else 0), before + edit)
                best[state, to] = min(best.get((state, to), weight), weight)
            at, before = GRAMMAR[at][_given(at)], before + "I"
    return tuple((a, b, cost, edits) for (a, b), (cost, edits) in sorted(best.items()))


def _ranked(best: dict[int, tuple]) -> tuple[tuple, int, tuple]:
    """Weights as (cost above the least, rank), the least, and where each came from; ``best``: state to (cost, order, origin)."""
    least = min(w[0] for w in best.values())
    rank = {s: n for n, s in enumerate(sorted(best, key=lambda s: best[s][1]))}
    return tuple((best[s][0] - least, rank[s]) if s in best else None for s in STATES), least, tuple(best[s][2] if s in best else None for s in STATES)


@lru_cache(maxsize=1 << 16)
def step(weights: tuple, kind: int) -> tuple[tuple, int, tuple]:
    """Over a row: the next weights, the cost that all have more, and (state, edits) behind each."""
    best: dict[int, tuple] = {}
    for a, b, cost, edits in arcs(kind):
        if weights[a]:
            w = (weights[a][0] + cost, (weights[a][1], edits), (a, edits))
            if b not in best or w < best[b]:
                best[b] = w
    return _ranked(best)


def path(kinds: list[int], first: int, last: int | None) -> tuple[list[str], int]:
    """The edits of each row on the least path from state to state, and its last state; ``last`` None: the best one to end in."""
    weights, backs = tuple((0, 0) if s == first else None for s in STATES), []
    for kind in kinds:
        weights, _, back = step(weights, kind)
        backs.append(back)
    at = ended(weights) if last is None else last
    end, out = at, []
    for back in reversed(backs):
        at, edits = back[at]
        out.append(edits)
    return out[::-1], end


def ended(weights: tuple) -> int:
    """The state in which the least whole path ends."""
    return min((w[0] + sum(COST[e] for e in ENDING[s]), w[1], ENDING[s], s) for s, w in enumerate(weights) if w)[-1]


def summary(kinds: list[int]) -> list[int | None]:
    """Costs and ranks of a run of rows, from each state to each: 32 numbers, None where no path leads."""
    out: list[int | None] = []
    for first in STATES:
        weights, total = tuple((0, 0) if s == first else None for s in STATES), 0
        for kind in kinds:
            weights, more, _ = step(weights, kind)
            total += more
        for w in weights:
            out += [w[0] + total, w[1]] if w else [None, None]
    return out


def scan(summaries: list[list[int | None]]) -> list[tuple[int, int]]:
    """First and last state of each run of a conversation on its least path."""
    weights, backs = START, []
    for s in summaries:
        best: dict[int, tuple] = {}
        for a in STATES:
            for b in STATES:
                cost, rank = s[8 * a + 2 * b : 8 * a + 2 * b + 2]
                if weights[a] and cost is not None:
                    w = (weights[a][0] + cost, (weights[a][1], rank), a)
                    if b not in best or w < best[b]:
                        best[b] = w
        weights, _, back = _ranked(best)
        backs.append(back)
    at, out = ended(weights), []
    for back in reversed(backs):
        out.append((back[at], at))
        at = back[at]
    return out[::-1]


def roles(edits: list[str], kinds: list[int], state: int) -> list[str]:
    """The role initial behind each edit (``-``: none)."""
    out = []
    for own, kind in zip(edits, kinds):
        made = ""
        for e in own:
            c = "-" if e == "D" else INITIALS[kind // 3] if e == "K" else _given(state)
            state = state if e == "D" else GRAMMAR[state][c]
            made += c
        out.append(made)
    return out


def fault_of(text: str) -> str | None:
    """A row's fault by its text alone."""
    said = text.rstrip(SPACE)
    return "blank" if not said else None if said[-1] in ".!?" else "truncated"


class Digest:
    """The result row of a conversation, from its rows in order."""

    def __init__(self, conv):
        self.conv, self.sha, self.audit = conv, hashlib.sha256(), []
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.low = self.turn = self.before = None
        self.turns = self.illegal = self.cost = self.written = 0

    def _say(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.written else "") + f"{role}:{text}").encode())
        self.written += 1

    def add(self, turn: int | None, role: str, text: str, fault: str | None, edits: str, made: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.turn
            self.turn = turn
        if fault:
            self.count[fault] += 1
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        self.cost += sum(COST[e] for e in edits) + (TRUNCATED_COST if fault == "truncated" and "D" not in edits else 0)
        self.audit.append(edits)
        for e, c in zip(edits, made):
            if e != "D":
                self._say(role if e == "K" else NAMES[c], "" if e == "I" else text)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.turn - self.low + 1 - self.turns
        return (self.conv, gaps, *self.count.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


DIGEST = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _kind(df: DataFrame, *more: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("conv_id", df.schema["conv_id"].dataType), *more])


def _digest_kind(df: DataFrame) -> T.StructType:
    return _kind(df, *(T.StructField(c, T.StringType() if c in DIGEST[-2:] else T.LongType()) for c in DIGEST))


def _row_kind(df: DataFrame) -> T.StructType:
    text = [T.StructField(c, T.StringType()) for c in ("role", "text", "fault", "edits", "made")]
    return _kind(df, T.StructField("turn", T.LongType()), T.StructField("gone", T.BooleanType()), T.StructField("place", T.LongType()), T.StructField("chunk", T.LongType()), *text)


class _Out:
    """Rows of a schema, given in batches of bounded size."""

    def __init__(self, kind: pa.Schema):
        self.kind, self.rows, self.bytes = kind, [], 0

    def add(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.bytes += size

    def batch(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows) if self.rows else [()] * len(self.kind), self.kind)], schema=self.kind)
        self.rows, self.bytes = [], 0
        return made

    def full(self) -> bool:
        return len(self.rows) >= OUT_ROWS or self.bytes >= OUT_BYTES


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}


def _arrow(kind: T.StructType, table: pa.Table | pa.RecordBatch) -> pa.Schema:
    """The Arrow schema of a result; ids are as they came."""
    own = {"conv_id": table.schema.field("conv_id").type} if "conv_id" in table.schema.names else {}
    return pa.schema([(f.name, own.get(f.name) or _ARROW[f.dataType.simpleString()]) for f in kind])


def _repaired(rows: list[list]) -> None:
    """Fill in faults, edits and made roles of a whole conversation's rows [conv, turn, gone, place, chunk, role, text, fault, edits, made]."""
    seen, live = set(), [r for r in rows if not r[2]]
    for r in live:
        said = (r[5], r[6])
        if r[7] != "blank" and said in seen:
            r[7] = "duplicate"
        seen.add(said)
    kinds = [row_class(r[5], r[7]) for r in live]
    edits, end = path(kinds, 0, None)
    made = roles(edits, kinds, 0)
    for r, e, m in zip(live, edits, made):
        r[8], r[9] = e, m
    if live:
        live[-1][8] += ENDING[end]
        live[-1][9] += "".join("ua"[k] for k in (() if end in (0, 3) else (0, 1) if end == 1 else (1,)))


def _sorted(df: DataFrame) -> DataFrame:
    """(conv_id, turn, gone, role, text), by conversation, over range partitions. Equal rows may be dealt to several."""
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.md5("text").asc(), F.col("n").asc()]
    return df.withColumn("n", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("n")


def _segments(df: DataFrame, digests: bool) -> DataFrame:
    """Rows with their edits where the task has the whole conversation, else with a chunk; ``digests``: whole conversations as their digest."""
    kind = _row_kind(df)
    if digests:
        kind = T.StructType([*kind, *_digest_kind(df).fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 33
        out, held, size, conv, open_ = None, [], 0, None, True

        def give(left_open: bool) -> None:
            if left_open:
                for r in held:
                    r[4] = held[0][3]
            else:
                _repaired(held)
                if digests:
                    done = Digest(held[0][0])
                    for r in held:
                        if not r[2]:
                            done.add(r[1], *r[5:])
                    row = done.row()
                    out.add((row[0], *[None] * 9, *row[1:]), len(row[-2]))
                    return
            for r in held:
                out.add((*r, *[None] * 8) if digests else tuple(r), len(r[6]))

        for batch in batches:
            out = out or _Out(_arrow(kind, batch))
            for c, turn, gone, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "gone", "role", "text"))):
                if held and c != conv:
                    give(open_)
                    held, size, open_ = [], 0, False
                elif len(held) >= CHUNK_ROWS or size >= CHUNK_BYTES:
                    give(True)
                    held, size, open_ = [], 0, True
                if out.full():
                    yield out.batch()
                conv = c
                held.append([c, turn, gone, place, None, role, text, None if gone else fault_of(text), None, None])
                place += 1
                size += len(text)
        if held:
            give(True)
            yield out.batch()

    return df.mapInArrow(run, kind)


def _opened(rows: DataFrame) -> DataFrame:
    """The rows of open chunks with faults, edits and roles."""
    light = rows.where("NOT gone").select("conv_id", "chunk", "place", "role", "fault", F.md5("text").alias("said"))
    first = light.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("said").alias("s")).agg(F.min("place").alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("said") == F.col("s"))
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    fault = F.when(F.col("fault") == "blank", "blank").when(F.col("place") > F.col("first"), "duplicate").otherwise(F.col("fault"))
    kind = 3 * initial + F.when(fault.isin("blank", "duplicate"), 2).when(fault.isNotNull(), 1).otherwise(0)
    marked = light.join(first, same).select("conv_id", "chunk", "place", kind.cast("int").alias("kind"), fault.alias("fault"))
    marked, marked_path = store.written(marked, "dialogue-marked")
    conv = marked.schema["conv_id"].dataType

    def in_order(t: pa.Table, by: str) -> pa.Table:
        return t.sort_by(by)

    sums = T.StructType([T.StructField("conv_id", conv), T.StructField("chunk", T.LongType()), T.StructField("weights", T.ArrayType(T.LongType()))])

    def summed(t: pa.Table) -> pa.Table:
        found = summary(in_order(t, "place")["kind"].to_pylist())
        return pa.Table.from_arrays([t["conv_id"].slice(0, 1), t["chunk"].slice(0, 1), pa.array([found], pa.list_(pa.int64()))], schema=_arrow(sums, t))

    states = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("ends", T.BooleanType())])

    def scanned(t: pa.Table) -> pa.Table:
        t = in_order(t, "chunk")
        found = scan(t["weights"].to_pylist())
        cols = [t["chunk"], pa.array([a for a, _ in found], pa.int32()), pa.array([b for _, b in found], pa.int32()), pa.array([False] * (len(found) - 1) + [True])]
        return pa.Table.from_arrays(cols, schema=_arrow(states, t))

    edited = T.StructType([T.StructField("at", T.LongType()), T.StructField("found", T.StringType()), T.StructField("edits", T.StringType()), T.StructField("made", T.StringType())])

    def repaired(t: pa.Table, state: pa.Table) -> pa.Table:
        t = in_order(t, "place")
        kinds = t["kind"].to_pylist()
        if not kinds:
            return _arrow(edited, t).empty_table()
        one = state.to_pylist()[0]
        edits, end = path(kinds, one["first"], one["last"])
        made = roles(edits, kinds, one["first"])
        if one["ends"]:
            edits[-1] += ENDING[end]
            made[-1] += "".join("ua"[k] for k in (() if end in (0, 3) else (0, 1) if end == 1 else (1,)))
        return pa.Table.from_arrays([t["place"], t["fault"], pa.array(edits, pa.string()), pa.array(made, pa.string())], schema=_arrow(edited, t))

    chosen = marked.groupBy("chunk").applyInArrow(summed, sums).groupBy("conv_id").applyInArrow(scanned, states)
    again = marked.sparkSession.read.schema(marked.schema).parquet(marked_path)
    edits = again.groupBy("chunk").cogroup(chosen.groupBy("chunk")).applyInArrow(repaired, edited)
    return rows.drop("fault", "edits", "made").join(edits, F.col("place") == F.col("at"), "left").withColumnRenamed("found", "fault").drop("at")


def _plain(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return df.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))


def damaged(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with faults by the crc32 of ``id:turn`` (a null is one space), modulo 20: 0 drops a row (``gone``), 1 empties its
    text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = _plain(df, id_col, turn_col, role_col, text_col)
    rows = rows.withColumn("way", F.crc32(F.encode(F.concat(text("conv_id"), F.lit(":"), text("turn")), "UTF-8")) % 20)
    said = F.when(F.col("way").isin(0, 1), "").when(F.col("way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", (F.col("way") == 0).alias("gone"), role.alias("role"), said.alias("text"), "way")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("way") == 3, 2).otherwise(1)))).drop("way", "copy")


def repair(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, place, step, edit, fault, turn, role, text): the edits in order; a row with edit D is one left out, one with I is
    new, without turn or text. Rows by (place, step) without D are the repaired conversation."""
    rows = _plain(df, id_col, turn_col, role_col, text_col).withColumn("gone", F.lit(False))
    found, _ = store.written(_segments(_sorted(rows), digests=False), "dialogue-rows")
    every = found.where("chunk IS NULL").unionByName(_opened(found.where("chunk IS NOT NULL")))
    out = every.select("*", F.posexplode(F.split("edits", "")).alias("step", "edit")).where("edit <> ''")
    given = F.when(F.substring("made", F.col("step") + 1, F.lit(1)) == "a", "assistant").otherwise("user")
    new = F.col("edit") == "I"
    return out.select(F.col("conv_id").alias(id_col), "place", "step", "edit", F.when(~new, F.col("fault")).alias("fault"), F.when(~new, F.col("turn")).alias("turn"), F.when(F.col("edit").isin("K", "D"), F.col("role")).otherwise(given).alias("role"), F.when(new, "").otherwise(F.col("text")).alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """A row a conversation of the rows that :func:`damaged` gives: counts, cost, edits, and the hash of the repaired rows.

    A digest is one hash over a whole conversation, so an open conversation's rows come together in one task at last, which reads them
    in order and holds only the edits' initials."""
    kind = _digest_kind(rows)
    found, _ = store.written(_segments(_sorted(rows), digests=True), "dialogue-digests")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = now = None
        for batch in batches:
            out = out or _Out(_arrow(kind, batch))
            for c, gone, *row in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "gone", "turn", "role", "text", "fault", "edits", "made"))):
                if now is None or now.conv != c:
                    if now:
                        out.add(now.row(), sum(map(len, now.audit)))
                    now = Digest(c)
                if not gone:
                    now.add(*row)
                if out.full():
                    yield out.batch()
        if now:
            out.add(now.row())
            yield out.batch()

    opened = _opened(found.where("chunk IS NOT NULL").select(*_row_kind(rows).fieldNames()))
    ordered = opened.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return found.where("chunk IS NULL").select(*kind.fieldNames()).unionByName(ordered.mapInArrow(run, kind))
