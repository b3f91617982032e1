"""Ordered analytics: best observations, previous and next rows, editorial order, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of a story's score, two decimals each, and the order of its parts.
WEIGHTS = {"recency": "0.20", "importance": "0.35", "interest": "0.10", "domestic": "0.25", "reliability": "0.10"}
PRIORITY = ("importance", "domestic", "reliability", "recency", "interest")


def score(parts: dict[str, Column], weights: dict[str, str] = WEIGHTS) -> Column:
    """The weighted sum in decimals, exact to two places."""
    total = sum((parts[k].cast("decimal(10,2)") * F.lit(w).cast("decimal(4,2)") for k, w in weights.items()), F.lit(0).cast("decimal(10,2)"))
    return F.round(total, 2)


def editorial_rank(df: DataFrame, within: list[str], pos: str, parts: tuple[str, ...] = PRIORITY) -> DataFrame:
    """Rank by the parts in turn, all descending; ties keep their input order."""
    w = Window.partitionBy(*within).orderBy(*(F.col(p).desc() for p in parts), pos)
    return df.withColumn("rank", F.row_number().over(w))


def best_row(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The greatest row of each key by the columns in turn: an aggregation, not a window."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b")).select(key, "_b.*")


def newer_incomplete(df: DataFrame, key: str, order: list[str], complete: str) -> DataFrame:
    """Per key: the selected row (complete first, then latest) and how many later rows are incomplete."""
    w = Window.partitionBy(key)
    at = F.struct(*order)
    chosen = F.max(F.struct(F.col(complete).cast("int").alias("c"), at.alias("at"))).over(w)["at"]
    return df.withColumn("_chosen", chosen).groupBy(key).agg(F.max("_chosen").alias("selected"), F.count_if((at > F.col("_chosen")) & ~F.col(complete)).alias("newer_incomplete"), F.max(at).alias("latest"))


def previous(df: DataFrame, key: str, order: list[str], columns: list[str], offset: int = 1) -> DataFrame:
    """Each row with the previous one of its key in order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.select("*", *(F.lag(c, offset).over(w).alias(f"previous_{c}") for c in columns))


def neighbours(df: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    """Each row with the one before and the one after."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.select("*", F.lag(column).over(w).alias("before"), F.lead(column).over(w).alias("after"))


def visible_before(df: DataFrame, key: str, edition: str, column: str) -> DataFrame:
    """Rows of strictly earlier editions: their number and the latest of them; the own edition isn't visible yet."""
    per = df.groupBy(key, edition).agg(F.count("*").alias("_n"), F.max(column).alias("_last"))
    w = Window.partitionBy(key).orderBy(edition).rowsBetween(Window.unboundedPreceding, -1)
    seen = per.select(key, edition, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("n_prior"), F.last("_last").over(w).alias("last_prior"))
    return df.join(seen, [key, edition])


def next_unread(df: DataFrame, key: str, order: str, row_id: str, is_read: str) -> DataFrame:
    """The next unread row in order, from the start again after the end; null if no other is unread."""
    unread = F.when(~F.col(is_read), F.col(row_id))
    w = Window.partitionBy(key).orderBy(order)
    after = F.first(unread, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    before = F.first(unread, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("next_unread", F.coalesce(after, before))


def unread_first(df: DataFrame, key: str, is_read: str, order: str) -> DataFrame:
    """Place of each row with unread rows first, each part in its order."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col(is_read).cast("int"), order)))


def top_k(df: DataFrame, within: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark prunes to k a task before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("rank") <= k)


def first_per_key(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Ordered dedup: the first row of each key."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_b")).select(*key, "_b.*")


def sticky_first(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The first value of a key stays; ``changed`` marks rows that differ from the one before."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.select("*", F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"first_{value}"), (F.lag(value).over(w) != F.col(value)).alias("changed"))


def latest_n_groups(df: DataFrame, group: str, n: int) -> DataFrame:
    """Rows of the n greatest values of a column (the last editions)."""
    last = df.select(group).distinct().orderBy(F.col(group).desc()).limit(n)
    return df.join(F.broadcast(last), group, "left_semi")  # n rows
