"""A corpus pipeline: quality, near-dedup, PII, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next stage's ``docs``. All but the last return the columns
of ``documents``. A trained classifier can't be stated in SQL, so there is no
``ORACLE_SQL``; tests compare every stage with a brute-force version.

Defined cases, for all stages: a null text is an empty one (and stays null where the row does); texts
are read whole, however long; each row with a null id is a document of its own; repeated rows are near duplicates of
each other, of which one stays; an empty table gives no rows; other columns, whatever their names, are carried along up to the
last stage, which leaves them out.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import bytebpe, minhash, mixing, pii, quality, store

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.7 or more."""
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, machine)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each near-duplicate group (five words, similarity 0.8)."""
    return minhash.deduplicate(docs, k=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by tags; ``n_chars`` follows."""
    return pii.mask(docs, chars_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents drawn to the sources' target weights; one drawn twice is two rows."""
    return mixing.materialise(docs, mixing.mix(docs, whole=True))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids and offsets of each document, with the decoding check."""
    return bytebpe.encode(docs, RANKS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_dedup", one_of_each_group),
    ("pii", mask_personal_data),
    ("mix", mix_sources),
    ("tokens", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    paths = []
    for name, stage in STAGES[:-1]:
        docs, path = store.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        paths.append(path)
        if len(paths) > 1:
            store.remove(spark, paths[-2])
    return STAGES[-1][1](spark, docs, sf_dir)
