"""Session settings the library relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: The state store that processors with lists and timers need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cpus: int | None = None, app: str = "tallyloom") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.openCostInBytes", "1m")  # a local file of some MB is work for all cores
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One driver table; Spark resolves the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
