"""Timelines that grow by one edition at a time: an append reads and writes rows of the issues that the edition touches, and no others' entries.

All of it goes through a :class:`journal.Journal`, a batch an edition, so an append that is cut off is finished or undone. Tables:

* ``entries``: each story of an issue with its previous entry. Entries are never written again.
* ``heads``: for each issue that a batch touched, what its index row then is. The latest row of an issue counts.
* ``fixes``: which entry supersedes which: the back-annotations of entries that are written already.
* ``folded``: fixes as one row an entry, and heads as one row an issue, since the last :meth:`Timelines.compact`; later rows go on from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.sinks.journal import Journal

ENTRY = "entry_id string, issue string, title string, category string, covered timestamp, pos int, previous_entry string, corrects string"
HEAD = "issue string, title string, categories array<string>, first_covered timestamp, last_covered timestamp, n_entries long, latest_entry string"
FIX = "entry_id string, superseded_by string, pos int"
FOLDED = "entry_id string, superseded_by array<string>"


class Timelines:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.journal = spark, Journal(spark, path)

    def _last_fold(self) -> str:
        """The batch of the last compaction; before the first, an empty name, which is less than all."""
        found = self.journal.intents().where(F.array_contains("tables", "folded")).join(self.journal.done(), "batch", "left_semi").agg(F.max("batch")).first()[0]
        return found or ""

    def index(self) -> DataFrame:
        """A row an issue: title, categories, first and last coverage, entries, and the latest entry."""
        heads = self.journal.read("heads", HEAD).where(F.col("batch") >= self._last_fold())
        columns = [c.split()[0] for c in HEAD.split(", ")]
        return heads.groupBy("issue").agg(F.max_by(F.struct(*columns[1:]), "batch").alias("h")).select("issue", "h.*")

    def entries(self) -> DataFrame:
        """All entries, each with those that supersede it, in their order."""
        fold = self._last_fold()
        old = self.journal.read("folded", FOLDED).where(F.col("batch") == fold).select("entry_id", F.posexplode("superseded_by").alias("pos", "superseded_by"), F.lit("").alias("batch"))
        new = self.journal.read("fixes", FIX).where(F.col("batch") > fold).select("entry_id", "pos", "superseded_by", "batch")
        # An entry's own corrections.
        notes = old.unionByName(new).groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("batch", "pos", "superseded_by"))), lambda f: f["superseded_by"]).alias("superseded_by"))
        return self.journal.read("entries", ENTRY).drop("batch").join(notes, "entry_id", "left").withColumn("superseded_by", F.coalesce("superseded_by", F.array().cast("array<string>")))

    def append(self, batch: str, stories: DataFrame) -> bool:
        """One edition's stories (entry_id, issue, title, category, covered, pos, corrects); False if the batch is done already.

        Batches come in the order of their names; one that is less than the last is refused, and so are an issue with another title than it has, and a
        correction of an entry that its issue doesn't have. A story without an issue stays outside all timelines.
        """
        self.journal.recover()
        last = self.journal.done().agg(F.max("batch")).first()[0] or ""
        if batch <= last:
            if self.journal.done().where(F.col("batch") == batch).isEmpty():
                raise ValueError(f"edition {batch} comes before {last}, which is there already")
            return False
        rows = stories.where(F.col("issue").isNotNull()).select("entry_id", "issue", "title", "category", "covered", "pos", "corrects")
        touched = rows.select("issue").distinct()
        heads = self.index().join(touched, "issue", "left_semi")
        order = Window.partitionBy("issue").orderBy("pos")  # one edition's stories of one issue
        first = F.lag("entry_id").over(order)
        known = heads.select("issue", F.col("title").alias("known"), "latest_entry")
        entries = rows.withColumn("before", first).withColumn("own", F.first("title").over(order)).join(known, "issue", "left")
        conflict = entries.where(F.coalesce("known", "own") != F.col("title")).select("issue").limit(1).collect()
        if conflict:
            raise ValueError(f"conflicting titles of issue {conflict[0].issue}")
        entries = entries.select("entry_id", "issue", "title", "category", "covered", "pos", F.coalesce("before", "latest_entry").alias("previous_entry"), "corrects")
        fixes = entries.where(F.col("corrects").isNotNull())
        earlier = self.journal.read("entries", ENTRY).select("entry_id", "issue").unionByName(entries.select("entry_id", "issue"))
        lost = fixes.join(earlier.select(F.col("entry_id").alias("corrects"), "issue"), ["corrects", "issue"], "left_anti").select("entry_id").limit(1).collect()
        if lost:
            raise ValueError(f"entry {lost[0].entry_id} corrects no entry of its issue")
        now = entries.groupBy("issue").agg(F.min("title").alias("title"), F.collect_set("category").alias("categories"), F.min("covered").alias("first_covered"), F.max("covered").alias("last_covered"), F.count("*").alias("n_entries"), F.max_by("entry_id", "pos").alias("latest_entry"))
        old = heads.select(*(F.col(c.split()[0]).alias("old_" + c.split()[0]) for c in HEAD.split(", ")))
        merged = now.join(old, F.col("issue") == F.col("old_issue"), "left").select(
            "issue", "title", F.array_sort(F.array_union("categories", F.coalesce("old_categories", F.array().cast("array<string>")))).alias("categories"), F.least("first_covered", "old_first_covered").alias("first_covered"),
            F.greatest("last_covered", "old_last_covered").alias("last_covered"), (F.col("n_entries") + F.coalesce("old_n_entries", F.lit(0))).alias("n_entries"), "latest_entry",
        )
        return self.journal.write(batch, {"entries": entries, "fixes": fixes.select(F.col("corrects").alias("entry_id"), F.col("entry_id").alias("superseded_by"), "pos"), "heads": merged})

    def compact(self, batch: str) -> bool:
        """Fold fixes and heads into one row each, as a batch of its own after the last edition's."""
        notes = self.entries().where(F.size("superseded_by") > 0).select("entry_id", "superseded_by")
        return self.journal.write(batch, {"heads": self.index(), "folded": notes})
