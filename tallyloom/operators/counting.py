"""Conflict-aware counting: repeated evidence per id is reconciled before it is summed.

Two levels of hash aggregation (id, then post), both with map-side combining, so a hot
post costs one row per comment id and task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strict_counts(rows: DataFrame, post: str, cid: str, value: str, total: str | None = None) -> DataFrame:
    """Per post: sum and count over distinct comment ids; conflicting repeats and a wrong total are reported."""
    per = rows.groupBy(post, cid).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), *([F.max(total).alias("total")] if total else []))
    out = per.groupBy(post).agg(
        F.sum("lo").alias("k_count"),
        F.count("*").alias("n_comments"),
        F.count_if(F.col("lo") != F.col("hi")).alias("n_conflicts"),
        *([F.max("total").alias("reported")] if total else []),
    )
    complete = F.col("n_conflicts") == 0
    return out.withColumn("complete", complete & (F.col("n_comments") == F.col("reported")) if total else complete)


def tolerant_counts(rows: DataFrame, post: str, cid: str, value: str, order: str) -> DataFrame:
    """Per post: the last row of each id counts; conflicts, repeats and invalid ids are listed or counted."""
    valid = F.col(cid).isNotNull() & (F.col(value) >= 0)
    per = rows.groupBy(post, cid).agg(
        F.max_by(value, order).alias("last"),
        F.count("*").alias("n"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
        F.max(valid.cast("int")).alias("valid"),
    )
    ok = F.col("valid") == 1
    return per.groupBy(post).agg(
        F.sum(F.when(ok, F.col("last"))).alias("k_count"),
        F.count_if(ok).alias("n_comments"),
        F.sum(F.when(ok, F.col("n") - 1).otherwise(0)).alias("duplicate_rows"),
        F.count_if(ok & (F.col("lo") != F.col("hi"))).alias("n_conflicts"),
        F.sum(F.when(~ok, F.col("n")).otherwise(0)).alias("invalid_rows"),
    )


def evidence(counts: DataFrame, threshold: int = 11) -> DataFrame:
    """Exact totals only when complete; an incomplete total is unknown, yet a trusted sum at the threshold still qualifies."""
    exact = F.col("complete")
    return counts.select(
        "*",
        F.when(exact, F.col("k_count")).alias("known_count"),
        F.when(~exact & (F.col("k_count") >= threshold), F.col("k_count")).alias("known_minimum"),
        F.when(exact, F.col("k_count") >= threshold).when(F.col("k_count") >= threshold, True).alias("qualified"),
        F.when(exact, "exact").when(F.col("k_count") >= threshold, "lower_bound").otherwise("unknown").alias("basis"),
    )


def window_partition(rows: DataFrame, post: str, t: str, start, end) -> DataFrame:
    """Per post: rows before, within (both ends) and after the window; unknown times are none of these."""
    c = F.col(t)
    return rows.groupBy(post).agg(F.count_if(c < start).alias("n_before"), F.count_if(c.between(start, end)).alias("n_within"), F.count_if(c > end).alias("n_after"), F.count_if(c.isNull()).alias("n_unknown"))


def at_least(rows: DataFrame, column: str, threshold: int) -> DataFrame:
    """Rows that reach a threshold; unknown doesn't."""
    return rows.where(F.col(column) >= threshold)


def numeric_totals(rows: DataFrame, json_column: str) -> DataFrame:
    """Sum of every numeric field of a JSON object over all rows."""
    entries = rows.select(F.explode(F.from_json(json_column, "map<string,double>")).alias("field", "value"))
    return entries.where(F.col("value").isNotNull()).groupBy("field").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
