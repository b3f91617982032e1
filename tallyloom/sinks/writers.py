"""Sinks: partitioned editions, append-only snapshots with hashes, guarded CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.sinks.journal import Journal


def csv_guarded(df: DataFrame) -> DataFrame:
    """Flat text columns: nested cells as JSON, and a quote before what a spreadsheet would run as a formula."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if f.dataType.typeName() in ("struct", "array", "map"):
            c = F.to_json(c)
        elif f.dataType.typeName() != "string":
            c = c.cast("string")
        out.append(F.when(c.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c).alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    csv_guarded(df).write.mode("errorifexists").option("header", True).csv(path)


def write_editions(df: DataFrame, path: str) -> None:
    """One folder per date and edition; only the written partitions are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "edition").parquet(path)


def snapshot_rows(items: DataFrame, key: str, payload: list[str], news_kind: Column) -> DataFrame:
    """Per edition: item count, a digest of the items, and whether it has news.

    The digest does not depend on the items' order: each item's SHA-256 is cut into numbers, which are summed (with map-side
    combining, so that an edition of any size is a few numbers a task) and digested with the count.
    """
    digest = F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256)
    per = items.select(key, digest.alias("d"), news_kind.alias("news"))
    per = per.groupBy(key).agg(F.count("*").alias("n_items"), *text.digest_sums(F.col("d")), F.bool_or("news").alias("has_news"))
    return per.select(key, "n_items", text.sums_digest("n_items").alias("snapshot_sha256"), "has_news")


def append_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows to append: immutable keys that exist already are left out."""
    return incoming.join(existing.select(key), key, "left_anti")


def public_columns(df: DataFrame, allowed: list[str], evidence: dict[str, Column]) -> DataFrame:
    """Only allowed columns; one with an evidence condition is null unless that holds."""
    return df.select(*(F.when(evidence[c], F.col(c)).alias(c) if c in evidence else F.col(c) for c in allowed))


def event_rows(events: DataFrame, command: str, recorded: Column) -> DataFrame:
    """Append-only events of :func:`publication.plan`: the command, its payload, its outcome and the row it superseded, as JSON."""
    return events.select(F.lit(command).alias("command"), "*", recorded.alias("recorded_at")).withColumn("superseded", F.to_json("superseded"))


def write_journaled(spark: SparkSession, path: str, batch: str, tables: dict[str, DataFrame]) -> None:
    """Several tables as one step, in the given order, by the :class:`journal.Journal` below the path.

    What an earlier attempt left is finished or undone first. A batch that is done is immutable, and writing it again does nothing.
    """
    log = Journal(spark, path)
    log.recover()
    log.write(batch, tables)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(batch) of the batches that are done: a row each."""
    return Journal(spark, path).done()


def read_journaled(spark: SparkSession, path: str, name: str, schema=None) -> DataFrame:
    """A table's rows of all batches that are done; given its schema, no rows before the first."""
    return Journal(spark, path).read(name, schema)


def replace_outputs(spark: SparkSession, path: str, batch: str, outputs: dict[str, DataFrame]) -> None:
    """Several outputs of one export, replaced together: all are staged first, and readers of :func:`current_output` see the old ones until all new ones are there."""
    write_journaled(spark, path, batch, outputs)


def current_output(spark: SparkSession, path: str, name: str, schema=None) -> DataFrame:
    """An output of the export that is done last (the greatest batch name that has it)."""
    return Journal(spark, path).read(name, schema, latest=True).drop("batch")


def write_publication(spark: SparkSession, roots: list[str], batch: str, stories: DataFrame, entries: DataFrame, index: DataFrame) -> None:
    """An edition, its issues' entries and the index, data before index, into each of several trees."""
    for root in roots:
        write_journaled(spark, root, batch, {"stories": stories, "issues": entries, "index": index})


def idempotent_batches(path: str):
    """A ``foreachBatch`` function that writes each batch id to its own folder, so that a rerun replaces it."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
