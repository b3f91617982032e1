"""Structured Streaming forms of the windows, replay and expiry rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def edition_counts(events: DataFrame, t: str = "ts", kind: str = "event_type", lateness: str = "0 seconds") -> DataFrame:
    """Counts per closed 12-hour edition; append mode emits a window once, after its end."""
    w = events.withWatermark(t, lateness).groupBy(F.window(t, "12 hours", startTime="9 hours"), kind)
    return w.agg(F.count("*").alias("n")).select(F.col("window.end").alias("window_end"), kind, "n")


def once_per_operation(ops: DataFrame, op_id: str, t: str, within: str = "24 hours") -> DataFrame:
    """The first row of each operation id; repeats within the horizon are replays."""
    return ops.withWatermark(t, within).dropDuplicatesWithinWatermark([op_id])


def first_seen(events: DataFrame, key: str, t: str, hours: int = 24) -> DataFrame:
    """Per key the first-seen time, kept in state until ``hours`` of event time have passed; emitted when it is new."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        least = min((f[t].min() for f in frames if len(f)), default=None)
        if least is None or state.exists:
            return
        state.update((least.value // 1000,))
        state.setTimeoutTimestamp(max(least.value // 1_000_000 + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "first_seen": [least]})

    kind = events.schema[key].dataType.simpleString()
    return (
        events.withWatermark(t, "0 seconds")
        .groupBy(key)
        .applyInPandasWithState(step, f"{key} {kind}, first_seen timestamp", "first_us long", "append", GroupStateTimeout.EventTimeTimeout)
    )


def _micros(t: pd.Timestamp) -> int:
    return t.value // 1000


def _timer(us: int) -> int:
    """The first millisecond by which an instant has passed."""
    return -(-us // 1000)


class Rolling(StatefulProcessor):
    """Rolling items: writes wait in a list until the watermark has passed them, so that they are judged in order however they came; an
    item's fixed times, revision and last verification are a value; timers wake it for waiting writes and for its end.

    What an item was stays known after its end, so that a relisting finds it, for ``forget_hours`` more (None: for good).
    """

    ITEM = "first_us long, published_us long, revision long, verified long, ended boolean"
    WAITING = "at_us long, op string, expected long, verified long, published_us long"

    def __init__(self, names: dict[str, str], hours: int, forget_hours: int | None):
        self.names, self.life, self.forget = names, hours * 3_600_000_000, None if forget_hours is None else forget_hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", self.ITEM)
        self.waiting = handle.getListState("waiting", self.WAITING)

    def handleInputRows(self, key, rows, timerValues):
        n, timers = self.names, set()
        for frame in rows:
            held = []
            for at, op, expected, verified, published in zip(*(frame[n[c]] for c in ("at", "op", "expected", "verified", "published"))):
                held.append((_micros(at), None if pd.isna(op) else str(op), *(None if pd.isna(v) else int(v) for v in (expected, verified)), None if pd.isna(published) else _micros(published)))
            if held:
                self.waiting.appendList(held)
                timers |= {_timer(h[0]) for h in held}
        for t in timers:
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # All that the watermark has passed is judged at the first of a batch's timers; the others find nothing to do.
        now = timerValues.getCurrentWatermarkInMs() * 1000
        first, published, revision, verified, ended = self.item.get() if self.item.exists() else (None, None, 0, None, False)
        due = sorted(h for h in map(tuple, self.waiting.get()) if h[0] <= now) if self.waiting.exists() else []
        out = []
        if due:
            left = [h for h in map(tuple, self.waiting.get()) if h[0] > now]
            self.waiting.put(left) if left else self.waiting.clear()
        for at, op, expected, checked, of in due:
            reason = (
                "stale" if of is None or not of <= at < of + self.life
                else "identity" if revision and of != published
                else "revision" if expected != revision
                else "verification" if checked is None or revision and checked < verified
                else None
            )
            if reason is None:
                if not revision:
                    first, published = at, of
                    self.handle.registerTimer(_timer(of + self.life))
                revision, verified = revision + 1, checked
            kind = "refused" if reason else "first" if revision == 1 else "update"
            out.append((op, kind, reason, at, revision, first, published))
        if revision:
            end = published + self.life
            if not ended and end <= now:
                ended = True
                out.append((None, "expired", None, end, revision, first, published))
                if self.forget is not None:
                    self.handle.registerTimer(_timer(end + self.forget))
            if self.forget is not None and end + self.forget <= now:
                self.item.clear()
            elif out:
                self.item.update((first, published, revision, verified, ended))
        if out:
            frame = pd.DataFrame(out, columns=["op", "kind", "reason", "at", "revision", "first_seen", "published"])
            for c in ("at", "first_seen", "published"):
                frame[c] = pd.to_datetime(frame[c].astype("Int64"), unit="us")
            frame.insert(0, "key", key[0])
            yield frame

    def close(self) -> None:
        pass


def rolling(events: DataFrame, key: str, op: str, at: str, expected: str, verified: str, published: str, hours: int = 24, lateness: str = "0 seconds", forget_hours: int | None = None) -> DataFrame:
    """The stream form of :func:`revisions.rolling`, with the same rows: each as soon as the watermark of ``at`` has passed it.

    ``verified`` is a whole number. Writes may come in any order within ``lateness``; later ones are lost, as the watermark has it. Needs the
    state store that ``session.STATE_STORE`` names, and a session in UTC.
    """
    kind = events.schema[key].dataType.simpleString()
    names = {"at": at, "op": op, "expected": expected, "verified": verified, "published": published}
    out = f"key {kind}, op string, kind string, reason string, at timestamp, revision long, first_seen timestamp, published timestamp"
    return events.withWatermark(at, lateness).groupBy(key).transformWithStateInPandas(Rolling(names, hours, forget_hours), out, "Append", "eventTime")
