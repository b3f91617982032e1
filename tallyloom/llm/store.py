"""Written tables in the shared folder, for cutting lineage and reuse.

Every intermediate that is read more than once is written as Parquet below the
folder named by ``spark.checkpoint.dir``, which all executors share; a lost
executor costs a re-read, never the data. Operators delete those that their result
does not read; :func:`clear` deletes the rest when results have been written.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


#: Folders written by this process and not yet deleted.
_live: set[str] = set()


@lru_cache(maxsize=None)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="tallyloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Unset: an error on a cluster, whose
    executors share no local folder; a local session gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_dir()
    return found.rstrip("/")


def written(df: DataFrame, name: str, release: bool = True) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder; the reread frame and its path.

    ``release``: the shuffle files of the stages that made the table serve nothing any more, and
    a job of many tables would pile them up, so Spark's cleaner is asked to drop them at once
    (it acts when the driver's JVM collects garbage; without a JVM at hand, it does in its own time).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _live.add(path)
    if release and hasattr(spark, "_jvm"):
        # The scheduler holds the last job's plan until the next one, so a job of one row comes before.
        spark.range(1).collect()
        spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path), path


def folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for what an operator writes there itself; :func:`clear` deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _live.add(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete intermediates that no live frame reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _live.discard(path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediates of this process. Results read some of them, so first write the results that are still needed."""
    remove(spark, *sorted(_live))
