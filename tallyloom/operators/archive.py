"""Editions of an old archive: parsed records with a reviewed map of which issue each belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text

# What archived records say where the archive itself says nothing.
STATUS, VERIFICATION, STAGE = "과거 기록", "not-reverified", "보도"
EVENT_NOTE = "아카이브에 실제 사건·기사 시각이 없어 추정하지 않았습니다."
UNCERTAINTY = "이전 ChatGPT 브리핑 기록이며 항목 전체를 기사 원문으로 재검증하지 않았습니다."
CHANGE = "과거 브리핑에 남아 있는 기록입니다: "
CLOSING_CATEGORY = "웹툰 산업"


def numbered(records: DataFrame) -> DataFrame:
    """Records (slot, line_start) with their ``ordinal`` in the slot, from 1."""
    return records.withColumn("ordinal", F.row_number().over(Window.partitionBy("slot").orderBy("line_start")).cast("int"))


def unassigned(records: DataFrame, assignments: DataFrame, issues: DataFrame) -> DataFrame:
    """(slot, ordinal, problem) where records and the reviewed map disagree: ``unclassified``, ``no record``, ``twice`` or ``unknown issue``; empty if all is well."""
    a = assignments.groupBy("slot", "ordinal").agg(F.count("*").alias("n"), F.min("issue_key").alias("issue_key"))
    known = issues.select("issue_key").distinct().withColumn("known", F.lit(True))
    both = numbered(records).select("slot", "ordinal", F.lit(True).alias("record")).join(a, ["slot", "ordinal"], "full").join(known, "issue_key", "left")
    problem = F.when(F.col("n").isNull(), "unclassified").when(F.col("record").isNull(), "no record").when(F.col("n") > 1, "twice").when(F.col("known").isNull(), "unknown issue")
    return both.select("slot", "ordinal", problem.alias("problem")).where(F.col("problem").isNotNull())


def same_source(source: Column, reviewed: str) -> Column:
    """Whether the archive's text is the one that was reviewed, by its SHA-256."""
    return F.coalesce(F.sha2(F.encode(source, "UTF-8"), 256) == reviewed, F.lit(False))


def stories(records: DataFrame, assignments: DataFrame, issues: DataFrame) -> DataFrame:
    """A story each record (slot, text, line_start, line_end) of its assigned issue (issue_key, issue_id, issue_title, category, context).

    Title, summary and sources come from the record's text; times that the archive doesn't give stay null. ``previous`` is the issue's record before, in the
    archive's order, of whatever slot. Records that :func:`unassigned` names have no story."""
    w = Window.partitionBy("issue_key").orderBy("line_start")  # one archive's records of an issue
    clean = text.bracket_prefix(F.col("text"))
    first = F.regexp_extract(clean, r"^(?s)(.*?[.。])" + text.WHITE + "+", 1)
    title = F.rtrim(F.when(first == "", clean).otherwise(first), F.lit("."))
    said = numbered(records).join(assignments, ["slot", "ordinal"]).join(issues, "issue_key")
    made = said.select("*", F.format_string("archive-%02d", "ordinal").alias("id"), clean.alias("clean"), title.alias("title"), text.source_names(F.col("text")).alias("names"))
    previous = F.lag(F.struct("slot", F.col("id").alias("story_id"), "title")).over(w)
    return made.select(
        "slot", "id", F.concat_ws("-", "slot", "id").alias("topic_key"), "category", "title", F.array("clean").alias("summary"), F.lit(STATUS).alias("status"), F.lit(None).cast("timestamp").alias("published_at"), F.lit(EVENT_NOTE).alias("event_note"),
        F.col("clean").alias("changed"), F.col("context").alias("matters"), F.lit(UNCERTAINTY).alias("uncertainty"), text.number_tokens(F.col("clean")).alias("emphasis"),
        F.struct(F.col("text").alias("original"), F.when(F.col("names").isNotNull(), F.array("names")).otherwise(F.array().cast("array<string>")).alias("names"), F.lit(VERIFICATION).alias("verification"), "ordinal", "line_start", "line_end").alias("archive"),
        F.struct("issue_id", "issue_title", F.lit(STAGE).alias("stage"), F.concat(F.lit(CHANGE), "clean").alias("change")).alias("timeline"), previous.alias("previous"),
    )


def editions(made: DataFrame) -> DataFrame:
    """(slot, id, n_stories, themes, overview) of the slots of :func:`stories`: the categories in the order of their first story, and two lines on what there is."""
    order = F.col("archive.ordinal")
    per = made.groupBy("slot").agg(
        F.count("*").alias("n_stories"), F.collect_list(F.struct(order.alias("n"), "category")).alias("all"),  # an edition's stories
        F.min_by(F.element_at("summary", 1), order).alias("opening"), F.min_by(F.element_at("summary", 1), F.when(F.col("category") == CLOSING_CATEGORY, order)).alias("closing"),
    )
    themes = F.array_distinct(F.transform(F.array_sort("all"), lambda s: s["category"]))
    named = per.withColumn("themes", themes)
    first = F.concat(F.lit("당시 "), "slot", F.lit(" 기록에는 "), F.array_join("themes", ", "), F.lit(" 분야의 소식 "), F.col("n_stories").cast("string"), F.lit("개가 담겨 있습니다."))
    second = F.concat(F.lit("주요 기록: "), "opening", F.when(F.col("closing").isNotNull(), F.concat(F.lit(f" {CLOSING_CATEGORY} 기록: "), "closing")).otherwise(""))
    return named.select("slot", F.concat("slot", F.lit("-archive")).alias("id"), "n_stories", "themes", F.array(first, second).alias("overview"))
