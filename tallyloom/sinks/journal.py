"""A write-ahead journal: several tables change as one step, which a lost driver leaves either undone or to be finished.

Below a path that the driver and all executors share:

* ``claims/<batch>`` names the owner that works on a batch; made only if absent, gone when the batch is done.
* ``staged/<batch>/<owner>/<table>`` is what the owner writes first.
* ``intents/<batch>`` is the journal itself: the owner and the tables in their order, made only if absent, when all is staged. From
  here on the batch happens, whoever finishes it.
* ``data/<table>/batch=<batch>`` is a staged table, moved there whole.
* ``done/<batch>`` comes last. Readers see batches that are done and no others.

A step that ended early is taken up by :func:`recover`: with an intent it is finished, without one it is undone. A second
claimant loses at the claim, or, if it held the first claim for dead, at the intent: only one owner's intent can be made. That an absent file is made by one
of two is the file system's promise (HDFS keeps it).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTENT = "batch string, owner string, tables array<string>"


class Lost(RuntimeError):
    """Another owner has the batch."""


class Journal:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Files.

    def _at(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, *parts: str) -> bool:
        fs, path = self._at(*parts)
        return fs.exists(path)

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._at(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _make(self, text: str, *parts: str) -> bool:
        """Make a file only if it is absent."""
        fs, path = self._at(*parts)
        fs.mkdirs(path.getParent())
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if fs.exists(path):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _text(self, *parts: str) -> str | None:
        fs, path = self._at(*parts)
        if not fs.exists(path):
            return None
        source = fs.open(path)
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def _drop(self, *parts: str) -> None:
        fs, path = self._at(*parts)
        fs.delete(path, True)

    # The steps of a batch, in order.

    def claim(self, batch: str, owner: str) -> None:
        if not self._make(owner, "claims", batch):
            raise Lost(f"batch {batch} is claimed")

    def stage(self, batch: str, owner: str, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/staged/{batch}/{owner}/{name}")

    def intend(self, batch: str, owner: str, tables: list[str]) -> None:
        """The claim must still be the owner's; the intent is the point from which the batch happens."""
        if self._text("claims", batch) != owner:
            raise Lost(f"the claim of batch {batch} was given away")
        if not self._make(json.dumps({"batch": batch, "owner": owner, "tables": tables}), "intents", batch):
            raise Lost(f"batch {batch} has another owner's intent")

    def intent(self, batch: str) -> dict | None:
        """The intent of a batch; one that was cut off while it was made is none."""
        try:
            return json.loads(self._text("intents", batch) or "null")
        except ValueError:
            return None

    def publish(self, batch: str) -> None:
        """Move what is staged and not yet there, table by table. Doing it again changes nothing."""
        todo = self.intent(batch)
        for name in todo["tables"]:
            if not self._exists("data", name, f"batch={batch}"):
                fs, target = self._at("data", name, f"batch={batch}")
                fs.mkdirs(target.getParent())
                if not fs.rename(self._at("staged", batch, todo["owner"], name)[1], target):
                    raise RuntimeError(f"table {name} of batch {batch} could not be moved")

    def finish(self, batch: str) -> None:
        self._make(batch, "done", batch)  # an empty file would not be read
        self._drop("staged", batch)
        self._drop("claims", batch)

    # Whole batches.

    def write(self, batch: str, tables: dict[str, DataFrame]) -> bool:
        """All tables as one step, moved in the given order. False if the batch is done already: it is immutable."""
        if self._exists("done", batch):
            return False
        owner = uuid.uuid4().hex
        self.claim(batch, owner)
        for name in tables:
            if not self.intent(batch):  # without an intent nothing was moved: what is there is no step's
                self._drop("data", name, f"batch={batch}")
        self.stage(batch, owner, tables)
        self.intend(batch, owner, list(tables))
        self.publish(batch)
        self.finish(batch)
        return True

    def recover(self, older_than: float = 0.0) -> dict[str, str]:
        """Finish or undo every batch that isn't done and was claimed more than so many seconds ago: batch to ``finished`` or ``undone``.

        An owner that is only slow and is held for dead loses: its claim is gone, or its intent is carried out for it."""
        out = {}
        for batch in self._names("claims"):
            fs, path = self._at("claims", batch)
            if time.time() - fs.getFileStatus(path).getModificationTime() / 1000 < older_than:
                continue
            if self._exists("done", batch) or self.intent(batch):
                self.publish(batch) if not self._exists("done", batch) else None
                self.finish(batch)
                out[batch] = "finished"
            else:
                for folder in ("claims", "intents", "staged"):
                    self._drop(folder, batch)
                out[batch] = "undone"
        return out

    def sink(self, tables: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: each micro-batch is a batch of the journal by its id, so one that Spark repeats after a restart happens once."""

        def write(df: DataFrame, batch_id: int) -> None:
            name = f"{batch_id:020d}"
            kept = df.persist()  # read once for all tables
            try:
                # The query that repeats a batch is the only one that writes it: a claim left behind is its own.
                if self._exists("claims", name):
                    self.recover()
                self.write(name, tables(kept))
            finally:
                kept.unpersist()

        return write

    # Reading.

    def done(self) -> DataFrame:
        """The batches that are done: a row each, read by Spark."""
        if not self._exists("done"):
            return self.spark.createDataFrame([], "batch string")
        files = self.spark.read.format("binaryFile").load(f"{self.path}/done")
        return files.select(F.element_at(F.split("path", "/"), -1).alias("batch"))

    def intents(self) -> DataFrame:
        """The journal: (batch, owner, tables) of all batches that happened or are to happen."""
        if not self._exists("intents"):
            return self.spark.createDataFrame([], INTENT)
        return self.spark.read.schema(INTENT).json(f"{self.path}/intents").where("batch IS NOT NULL")

    def read(self, name: str, schema: str | T.StructType | None = None, latest: bool = False) -> DataFrame:
        """A table's rows of all batches that are done (of the greatest one that has the table, if ``latest``), with their ``batch``; no rows, but the schema, before the first.
        Without a schema, the files' own, of which there must be some.

        The done batches meet the table at its partition column, so folders of others are not opened."""
        own = self.spark.read.parquet(f"{self.path}/data/{name}").drop("batch").schema if schema is None else schema
        kind = T.StructType.fromDDL(own) if isinstance(own, str) else own
        kind = T.StructType([*kind, T.StructField("batch", T.StringType())])
        if not self._exists("data", name):
            return self.spark.createDataFrame([], kind)
        done = self.done()
        if latest:
            done = self.intents().where(F.array_contains("tables", name)).join(done, "batch", "left_semi").agg(F.max("batch").alias("batch"))
        return self.spark.read.schema(kind).parquet(f"{self.path}/data/{name}").join(done, "batch", "left_semi").select(*kind.fieldNames())
