"""Attempted writes: which of them a revisioned state accepts, for keys of any size.

A write states the revision it expects and when its content was verified. It is accepted if that is the current revision, the verification isn't older than
that of the last accepted write, and the fixed fields are those of the key's first accepted write; then the revision is one more. A refused write changes
nothing, so whether a write is accepted depends on all before it.

Over a run of writes the state, (revision, verified), goes through a function. The first accepted write of a key is its first that expects 0, so what the
fixed fields must be is one aggregation. Of the rest, a run's function is partial: from revision r it leads on only through the run's writes that expect r, and of
those only through ones later than which no verification so early comes before (records): a row of (r, least verified, then: revision, verified) for each.

1. Writes are sorted by key and order over range partitions; a key of many writes is in many partitions (pieces).
2. Each piece gives the rows of its function, from its last write to its first.
3. One pass over a key's function rows, piece by piece, finds the state before each piece. It holds one state at a time; no payload is moved.
4. Each piece is read once more with the state before it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEVER = -(1 << 63)

STATES = T.StructType([T.StructField("key", T.StringType()), T.StructField("piece", T.LongType()), T.StructField("revision", T.LongType()), T.StructField("verified", T.LongType())])
MAPS = T.StructType([*STATES, T.StructField("next_revision", T.LongType()), T.StructField("next_verified", T.LongType())])


def _number(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType
    if isinstance(kind, T.TimestampNTZType):  # as UTC, whatever the session's zone
        return (F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)).cast("long")
    return F.unix_micros(c) if isinstance(kind, T.TimestampType) else F.col(c).cast("long")


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The function rows of each piece; batches hold (key, piece, expected, verified, same) in order."""
    held: list[tuple[int, int]] = []
    at = None

    def made() -> pa.RecordBatch:
        # By expected revision, the records of what is read so far, the earliest last: minus verified, and the state it leads to.
        records: dict[int, tuple[list[int], list[tuple[int, int]]]] = {}

        def through(revision: int, verified: int) -> tuple[int, int]:
            found = records.get(revision)
            # The earliest record that is verified late enough; those after it are later and greater.
            k = bisect_left(found[0], 1 - verified) - 1 if found else -1
            return found[1][k] if k >= 0 else (revision, verified)

        for expected, verified in reversed(held):
            leads = through(expected + 1, verified)
            late, states = records.setdefault(expected, ([], []))
            while late and -late[-1] <= verified:
                late.pop()
                states.pop()
            late.append(-verified)
            states.append(leads)
        rows = [(at[0], at[1], r, -v, *s) for r, (late, states) in records.items() for v, s in zip(late, states)]
        return _batch(MAPS, rows)

    for batch in batches:
        for key, piece, expected, verified, same in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, piece) != at:
                if held:
                    yield made()
                held, at = [], (key, piece)
            if same:
                held.append((expected, verified))
    if held:
        yield made()


def _batch(kind: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    types = {"string": pa.string(), "bigint": pa.int64()}
    schema = pa.schema([(f.name, types[f.dataType.simpleString()]) for f in kind])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each piece; batches hold function rows by (key, piece, revision, verified), and one of revision -1 before each piece."""
    now, key, ready, out = (0, NEVER), None, False, []
    for batch in batches:
        for k, piece, revision, verified, next_revision, next_verified in zip(*(c.to_pylist() for c in batch.columns)):
            if revision < 0:
                if k != key:
                    now, key = (0, NEVER), k
                ready = True
                out.append((k, piece, *now))
                if len(out) >= 4096:
                    yield _batch(STATES, out)
                    out = []
            elif ready and revision == now[0] and verified >= now[1]:
                # The rows of one revision are by time of verification: the first that is late enough is the earliest write.
                now, ready = (next_revision, next_verified), False
    yield _batch(STATES, out)


def attempted_writes(log: DataFrame, key: str, order: list[str], expected: str, verified: str, fixed: list[str], valid: Column | None = None) -> DataFrame:
    """All writes with ``current_revision`` (before the write), ``revision_ok``, ``time_ok``, ``identity_ok`` and ``accepted``.

    ``verified`` is a time or a whole number. ``valid`` is a condition of the row itself; a write that fails it is never accepted. A write without
    an expected revision or a verification time is never accepted. Nulls of fixed fields equal each other. A null key is a key. Writes equal
    in all of ``order`` are taken in no certain order, so give it an id. Needs ``spark.checkpoint.dir``; an empty log gives no rows.
    """
    names = log.columns
    order_key = F.struct(*order)
    row_ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    usable = row_ok & F.coalesce(F.col(expected) >= 0, F.lit(False)) & F.col(verified).isNotNull()
    packed = log.select(F.struct(*names).alias("row"), F.to_json(F.struct(F.col(key).alias("k")), {"ignoreNullFields": "false"}).alias("key"), F.col(expected).cast("long").alias("expected"), _number(log, verified).alias("verified"), order_key.alias("order"), F.struct(*fixed).alias("fixed"), usable.alias("usable"))
    first = packed.where("usable AND expected = 0").groupBy("key").agg(F.min_by("fixed", "order").alias("first_fixed"))
    first = first.withColumnRenamed("key", "of")
    same = F.coalesce(F.col("fixed").eqNullSafe(F.col("first_fixed")), F.lit(False))
    marked = packed.join(first, F.col("key") == F.col("of"), "left").select("row", "key", "expected", "verified", "order", "usable", same.alias("identity_ok"), (same & F.col("usable")).alias("same"))
    keys = ["key", "order"]
    ranged = marked.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    rows = ranged.drop("order").withColumn("piece", F.shiftright("place", 33)).checkpoint()

    light = rows.select("key", "piece", "expected", "verified", "same")
    starts = light.select("key", "piece").distinct().select("key", "piece", F.lit(-1).cast("long").alias("revision"), F.lit(NEVER).alias("verified"), F.lit(0).cast("long").alias("next_revision"), F.lit(0).cast("long").alias("next_verified"))
    functions = light.mapInArrow(_functions, MAPS).unionByName(starts)
    states = functions.repartition("key").sortWithinPartitions("key", "piece", "revision", "verified").mapInArrow(_fold, STATES)
    states = states.select(F.col("key").alias("of"), F.col("piece").alias("of_piece"), F.col("revision").alias("from_revision"), F.col("verified").alias("from_verified"))
    known = rows.join(states, (F.col("key") == F.col("of")) & (F.col("piece") == F.col("of_piece"))).drop("of", "of_piece")

    kind = T.StructType([rows.schema["row"], rows.schema["identity_ok"], rows.schema["usable"], T.StructField("current_revision", T.LongType()), T.StructField("revision_ok", T.BooleanType()), T.StructField("time_ok", T.BooleanType()), T.StructField("accepted", T.BooleanType())])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = now = None
        for batch in batches:
            out = []
            for k, piece, expected_, verified_, same_, r, v in zip(*(batch.column(c).to_pylist() for c in ("key", "piece", "expected", "verified", "same", "from_revision", "from_verified"))):
                if (k, piece) != at:
                    at, now = (k, piece), (r, v)
                revision_ok, time_ok = expected_ == now[0], verified_ is not None and verified_ >= now[1]
                accepted = same_ and revision_ok and time_ok
                out.append((now[0], revision_ok, time_ok, accepted))
                if accepted:
                    now = (now[0] + 1, verified_)
            cols = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("identity_ok"), batch.column("usable"), *cols], names=kind.fieldNames())

    done = known.repartition("key", "piece").sortWithinPartitions("key", "piece", "place").mapInArrow(judged, kind)
    # Before a key's first accepted write there is nothing that its fixed fields could differ from.
    return done.select("row.*", "current_revision", "revision_ok", "time_ok", (F.col("identity_ok") | (F.col("current_revision") == 0)).alias("identity_ok"), "accepted")


def rolling(log: DataFrame, key: str, op: str, at: str, expected: str, verified: str, published: str, now: Column, hours: int = 24) -> DataFrame:
    """What happens to rolling items by ``now``, a row an event: (key, op, kind, reason, at, revision, first_seen, published).

    Writes come in the order of ``at``, then ``op``. One is taken while its item is fresh (published <= at < published + hours), if
    :func:`attempted_writes` accepts it; publication is fixed by the first. Kinds: ``first``, ``update``, ``refused`` (with the reason: stale,
    identity, revision or verification) and ``expired``, once for each item, at the end of its hours, with its last revision. A write after the end
    is stale, so listing an item again does not bring it back. Writes after ``now`` have not happened.
    """
    ends = lambda c: c + F.expr(f"INTERVAL {hours} HOURS")
    fresh = (F.col(published) <= F.col(at)) & (F.col(at) < ends(F.col(published)))
    w = attempted_writes(log.where(F.col(at) <= now), key, [at, op], expected, verified, [published], fresh)
    reason = F.when(~F.coalesce(fresh, F.lit(False)), "stale").when(~F.col("identity_ok"), "identity").when(~F.coalesce("revision_ok", F.lit(False)), "revision").otherwise("verification")
    items = w.where("accepted").groupBy(key).agg(F.min(at).alias("first_seen"), F.min(published).alias("item_published"), F.count("*").alias("revision"))
    known = items.select(F.col(key).alias("of"), "first_seen", "item_published")
    kind = F.when(~F.col("accepted"), "refused").when(F.col("current_revision") == 0, "first").otherwise("update")
    seen = w.join(known, F.col(key).eqNullSafe(F.col("of")), "left").where(F.col(at).isNotNull())
    # What was known of the item when the write came.
    before = F.col("accepted") | (F.col("current_revision") > 0)
    written = seen.select(F.col(key).alias("key"), F.col(op).cast("string").alias("op"), kind.alias("kind"), F.when(~F.col("accepted"), reason).alias("reason"), F.col(at).alias("at"), (F.col("current_revision") + F.col("accepted").cast("long")).alias("revision"), F.when(before, F.col("first_seen")).alias("first_seen"), F.when(before, F.col("item_published")).alias("published"))
    end = ends(F.col("item_published"))
    over = items.where(end <= now).select(F.col(key).alias("key"), F.lit(None).cast("string").alias("op"), F.lit("expired").alias("kind"), F.lit(None).cast("string").alias("reason"), end.alias("at"), "revision", "first_seen", F.col("item_published").alias("published"))
    return written.unionByName(over)
