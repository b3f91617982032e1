"""Validation as data: named rules over rows give a table of violations; valid means empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) of each rule that a row breaks. A rule that is unknown (null) is broken. One pass, no shuffle."""
    broken = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))
    # Tried in a projection of their own, rules are compiled; within the generator, or within a filter of the array, they would be interpreted. And an
    # inner explode would have them tried twice, the first time only to see whether there is anything to explode.
    tried = df.select(F.col(key).alias("key"), broken.alias("rules"))
    return tried.select("key", F.explode_outer("rules").alias("rule")).where(F.col("rule").isNotNull())


def group_violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """The same for rules on groups: each is an aggregate that must be true."""
    per = df.groupBy(key).agg(*(rule.alias(name) for name, rule in rules.items()))
    return violations(per, key, {name: F.col(name) for name in rules})


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count("*").alias("n"))
