"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two aggregations with map-side combining and two joins; a node's
neighbours are never collected. Rounds are written to the shared folder, and end
when a round changes no edge.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import store


def heads(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n rows with links (a, b): the least row reachable from each."""
    head = np.arange(n)
    while True:
        new = head.copy()
        low = np.minimum(head[a], head[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == head).all():
            return head
        head = new


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    r = edges.agg(F.count("*").alias("n"), F.sum(F.shiftright(h, 24)).alias("a"), F.sum(F.pmod(h, F.lit(1 << 40))).alias("b")).first()
    return r["n"], r["a"], r["b"]


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    ``edges`` has columns a and b. Loops and repeated edges are harmless; edges with a
    null end are ignored. No edges: no rows.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, path = store.written(e, name)
    mark = _mark(e)
    while mark[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(mins, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(mins, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(mins.select("u", F.col("m").alias("v"))).distinct()
        new, new_path = store.written(small, name)
        new_mark = _mark(new)
        store.remove(e.sparkSession, path)
        e, path = new, new_path
        if new_mark == mark:
            break
        mark = new_mark
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
