"""Issue timelines, corrections and coverage accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def entries(stories: DataFrame, issue: str, order: list[str], entry_id: str) -> DataFrame:
    """Each story with the previous one of its issue and its place."""
    w = Window.partitionBy(issue).orderBy(*order)
    return stories.select("*", F.lag(entry_id).over(w).alias("previous_entry"), F.row_number().over(w).alias("entry_no"))


def superseded_by(rows: DataFrame, entry_id: str, correction_of: str) -> DataFrame:
    """Each entry with the corrections that name it: a row for each of them, one with a null for an entry that has none."""
    fixes = rows.where(F.col(correction_of).isNotNull()).select(F.col(correction_of).alias(entry_id), F.col(entry_id).alias("superseded_by"))
    return rows.join(fixes, entry_id, "left")


def issue_index(rows: DataFrame, issue: str, covered: str, category: str, entry_id: str) -> DataFrame:
    """Per issue: categories, first and last coverage, entries, and the latest entry."""
    return rows.groupBy(issue).agg(
        F.array_sort(F.collect_set(category)).alias("categories"),
        F.min(covered).alias("first_covered"),
        F.max(covered).alias("last_covered"),
        F.count("*").alias("n_entries"),
        F.max_by(entry_id, F.struct(covered, entry_id)).alias("latest_entry"),
    )


def repeat_report(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, the most common first."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.col("n").desc(), key)


def pages_contiguous(pages: DataFrame, within: str, page: str, boundary: str) -> DataFrame:
    """Per pass: pages run from 1 without gaps, and the last page proves the boundary."""
    return pages.groupBy(within).agg(
        ((F.min(page) == 1) & (F.max(page) == F.count_distinct(page))).alias("contiguous"),
        F.max_by(boundary, page).alias("boundary_confirmed"),
        F.count_distinct(page).alias("n_pages"),
    )


def boundary_proof(rows: DataFrame, page: list[str], t: str, start) -> DataFrame:
    """A page proves the boundary when it has rows and all of them are known to be older than the start."""
    return rows.groupBy(*page).agg(F.bool_and(F.coalesce(F.col(t) < start, F.lit(False))).alias("boundary_confirmed"), F.count("*").alias("n_rows"))


def coverage(listed: DataFrame, observed: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """One row: listed, excluded, observed, missing, complete."""
    ids = listed.select(key).distinct()
    flags = ids.join(observed.select(key).distinct().withColumn("o", F.lit(True)), key, "left").join(excluded.select(key).distinct().withColumn("e", F.lit(True)), key, "left")
    o, e = F.col("o").isNotNull(), F.col("e").isNotNull()
    return flags.agg(
        F.count("*").alias("n_listed"),
        F.count_if(e).alias("n_excluded"),
        F.count_if(o & ~e).alias("n_observed"),
        F.count_if(~o & ~e).alias("n_missing"),
        (F.count_if(~o & ~e) == 0).alias("complete"),
    )


def overlay_holds(posts: DataFrame, holds: DataFrame, key: str, flag: str) -> DataFrame:
    """Held posts lose their membership (unknown, not false) and say why."""
    h = holds.groupBy(key).agg(F.array_sort(F.collect_set("reason")).alias("hold_reasons"))
    return posts.join(h, key, "left").withColumn(flag, F.when(F.col("hold_reasons").isNull(), F.col(flag)))


def run_summary(rows: DataFrame, flags: list[str]) -> DataFrame:
    """One row of counters; a tri-state flag gives three."""
    aggs = [F.count("*").alias("n_rows")]
    for f in flags:
        aggs += [F.count_if(F.col(f)).alias(f"{f}_yes"), F.count_if(~F.col(f)).alias(f"{f}_no"), F.count_if(F.col(f).isNull()).alias(f"{f}_unknown")]
    return rows.agg(*aggs)


def fold_archive(rows: DataFrame, keys: list[str], archived: str, row_id: str) -> DataFrame:
    """Archived rows fold into the first current row of their keys; without one they stay. A row each: the row it counts as, and its own id if that is another."""
    first = rows.where(~F.col(archived)).groupBy(*keys).agg(F.min(row_id).alias("_host"))
    host = F.when(F.col(archived), F.coalesce("_host", row_id)).otherwise(F.col(row_id))
    return rows.join(first, keys, "left").select(*keys, host.alias("_as"), F.when(host != F.col(row_id), F.col(row_id)).alias("alias")).withColumnRenamed("_as", row_id)
