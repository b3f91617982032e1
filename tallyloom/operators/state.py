"""Revisioned state from an append-only log: replay, optimistic concurrency, monotonicity, latest, expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def operations(log: DataFrame, op_id: str, digest: str) -> DataFrame:
    """Per operation id: one digest is a replay however often it comes, several are a conflict."""
    return log.groupBy(op_id).agg(F.count("*").alias("n_seen"), (F.min(digest) != F.max(digest)).alias("conflict"))


def revision_checks(log: DataFrame, key: str, order: list[str], expected: str, verified: str, fixed: list[str]) -> DataFrame:
    """Each write of a log of accepted writes checked against the one before: expected revision, no step back in time, fixed fields unchanged.

    Where writes may have been refused, :func:`revisions.attempted_writes` says which revision each of them found."""
    w = Window.partitionBy(key).orderBy(*order)
    current = F.row_number().over(w) - 1
    same = F.lit(True)
    for c in fixed:
        same = same & F.coalesce(F.col(c).eqNullSafe(F.lag(c).over(w)) | (current == 0), F.lit(True))
    return log.select("*", current.alias("current_revision"), (F.col(expected) == current).alias("revision_ok"), F.coalesce(F.col(verified) >= F.lag(verified).over(w), F.lit(True)).alias("time_ok"), same.alias("identity_ok"))


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The current row of each key: one aggregation over the log."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def active(log: DataFrame, key: str, order: list[str], published: str, now, hours: int = 24) -> DataFrame:
    """Latest rows that are still within their time to live at ``now``."""
    p = F.col(published)
    return latest(log, key, order).where((p <= now) & (now < p + F.expr(f"INTERVAL {hours} HOURS")))


def apply_batch(current: DataFrame, batch: DataFrame, violations: DataFrame, key: str, order: list[str]) -> DataFrame:
    """All or nothing: the batch joins the state only if there are no violations at all."""
    ok = violations.limit(1).agg((F.count("*") == 0).alias("_ok"))
    accepted = batch.crossJoin(F.broadcast(ok)).where("_ok").drop("_ok")  # one row
    return latest(current.unionByName(accepted), key, order)


def fill_windows(found: DataFrame, start: str, end: str, window: str = "window_end", hours: int = 12) -> DataFrame:
    """Every window between two ends, those without rows too."""
    spark = found.sparkSession
    all_ = spark.sql(f"SELECT explode(sequence(TIMESTAMP_NTZ'{start}', TIMESTAMP_NTZ'{end}', INTERVAL {hours} HOURS)) AS {window}")
    return all_.join(found, window, "left")


def with_corrections(items: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Items unchanged, each with the number of corrections appended to it and the last of them; the log keeps all."""
    c = corrections.groupBy(key).agg(F.max("correction_id").alias("last_correction"), F.count("*").alias("n_corrections"))
    return items.join(c, key, "left").withColumn("n_corrections", F.coalesce("n_corrections", F.lit(0)))


def drift(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows that differ between stored and recomputed data, with the side that has them."""
    a = stored.exceptAll(derived).withColumn("side", F.lit("stored"))
    return a.unionByName(derived.exceptAll(stored).withColumn("side", F.lit("derived")))


def merge_or_conflict(existing: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of both by key: ``new``, ``same`` or ``conflict``."""
    e = existing.select(key, F.col(digest).alias("_old"))
    return incoming.join(e, key, "left").withColumn("status", F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col(digest), "same").otherwise("conflict")).drop("_old")
