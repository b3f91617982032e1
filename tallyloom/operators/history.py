"""What a story's rules must know of earlier editions and of its own: looked up, not handed in.

All rules that look up other rows are planned together. A story holds keys (topic, sources' URLs, facts, issue, title, its own reference) and looks keys
up (the same, titles that are alike, and the references that it makes). Held and looked-up keys become one table of a row for each key and edition, by one
aggregation with map-side combining; a window over a key's editions, which are few however many stories share the key, gives what of it came before; and
one equi-join brings that back. So no pair of stories is made, and a key that a third of all stories share is a row an edition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import matching

#: Editions back in which a community topic or URL may not have been.
RECENT_EDITIONS = 14
SAME = ("topic", "url", "facts", "issue", "title")


def _ref(edition: Column, story: Column) -> Column:
    return F.when(edition.isNotNull() & story.isNotNull(), F.to_json(F.struct(edition.cast("string").alias("e"), story.cast("string").alias("s"))))


def _keys(stories: DataFrame, columns: list[str], **arrays: Column) -> DataFrame:
    """A row for each key: (field, value) and the columns."""
    each = F.flatten(F.array(*(_tagged(f, a) for f, a in arrays.items())))
    return stories.select(*columns, F.inline(F.array_distinct(each))).where(F.coalesce(F.col("value") != "", F.lit(False)))


def _tagged(field: str, values: Column) -> Column:
    known = F.coalesce(values.cast("array<string>"), F.array().cast("array<string>"))
    return F.transform(known, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))


def with_history(stories: DataFrame, least: float = 0.82) -> DataFrame:
    """Each story with ``repeats`` (an earlier story of its edition is the same), ``n_matches`` (1 if an earlier edition has it, or its issue), ``newest`` (the
    latest of these: edition_id, id, words, facts_hash, cutoff_at), ``same_words``, ``same_facts``, ``newer_source``, ``follow_newest``, ``follow_targets``,
    ``follow_same_issue``, ``known_title``, ``correction_found`` and ``recent`` (a topic or URL of the last ``RECENT_EDITIONS`` editions).

    ``stories``, of any number of editions: edition_id, cutoff_at, archived, pos (in its edition), id, topic_key, title (normalised), urls (canonical), facts_hash, words
    (normalised summary), issue_id, issue_title, follow_edition, follow_story, correction_edition, correction_story, source_at (its latest source). Stories are the same
    by topic, URL, facts, or titles at least ``least`` alike. Only editions with an earlier cut-off are history, and archived ones are not. Of the latest edition's
    matches the first story counts. A null or empty key is none; an unknown answer is null where a rule asks, and false for ``repeats`` and ``recent``.
    """
    s = stories
    about = F.struct(F.col("cutoff_at"), (-F.col("pos")).alias("first"), F.col("edition_id"), F.col("id"), F.col("words"), F.col("facts_hash"), F.col("issue_id"))
    one = lambda c: F.array(c)
    held = _keys(s, ["edition_id", "cutoff_at", "archived", "pos", "issue_title", about.alias("about")], topic=one("topic_key"), url=F.col("urls"), facts=one("facts_hash"), issue=one("issue_id"), title=one("title"), ref=one(_ref(F.col("edition_id"), F.col("id"))))
    me = ["edition_id", "cutoff_at", "pos", "id"]
    asked = _keys(s, me, topic=one("topic_key"), url=F.col("urls"), facts=one("facts_hash"), issue=one("issue_id"), title=one("title"), ref=F.array(_ref(F.col("follow_edition"), F.col("follow_story")), _ref(F.col("correction_edition"), F.col("correction_story"))))
    if least < 1:
        alike = matching.similar_pairs(s.select("title"), s.select(F.col("title").alias("other")), "title", "other", least).where("title <> other")
        asked = asked.unionByName(s.select(*me, "title").join(alike, "title").select(*me, F.lit("title").alias("field"), F.col("other").alias("value")))

    live = ~F.coalesce(F.col("archived"), F.lit(False))
    key = ["field", "value", "edition_id", "cutoff_at"]
    none = lambda c: F.lit(None).cast(held.schema[c].dataType).alias(c)
    both = held.select(*key, "pos", F.when(live, F.col("about")).alias("about"), F.when(live, F.col("issue_title")).alias("issue_title")).unionByName(asked.select(*key, none("pos"), none("about"), none("issue_title")))
    per = both.groupBy(*key).agg(F.min("pos").alias("first_pos"), F.max("about").alias("about"), F.count("about").alias("n"), F.min("issue_title").alias("low"), F.max("issue_title").alias("high"))
    before = Window.partitionBy("field", "value").orderBy(F.unix_micros(F.col("cutoff_at").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    state = per.select(*key, "first_pos", F.max("about").over(before).alias("prior"), F.sum("n").over(before).alias("n_prior"), F.min("low").over(before).alias("low"), F.max("high").over(before).alias("high"))

    # An edition's place among all: a row an edition.
    editions = s.groupBy("edition_id").agg(F.min("cutoff_at").alias("c")).withColumn("rank", F.row_number().over(Window.orderBy("c", "edition_id"))).select("edition_id", "rank")
    prior_rank = editions.select(F.col("edition_id").alias("prior_edition"), F.col("rank").alias("prior_rank"))
    found = asked.join(state, key).withColumn("prior_edition", F.col("prior.edition_id")).join(editions, "edition_id").join(prior_rank, "prior_edition", "left")
    is_same, field = F.col("field").isin(*SAME), F.col("field")
    when = lambda f, c: F.when(field == f, c)
    story = ["edition_id", "id", "pos"]
    looked = found.groupBy(*story).agg(
        F.max(F.coalesce(is_same & (field != "issue") & (F.col("first_pos") < F.col("pos")), F.lit(False))).alias("repeats"),
        F.max(F.when(is_same, F.col("prior"))).alias("newest"),
        F.min(when("issue", F.col("low"))).alias("low"), F.max(when("issue", F.col("high"))).alias("high"),
        F.collect_list(when("ref", F.struct("value", "n_prior", F.col("prior.issue_id").alias("issue_id")))).alias("refs"),  # at most the two references that a story makes
        F.max(F.coalesce(field.isin("topic", "url") & (F.col("rank") - F.col("prior_rank") <= RECENT_EDITIONS), F.lit(False))).alias("recent"),
    )
    looked = looked.select(*(F.col(c).alias(f"_{c}") for c in story), "repeats", "newest", "low", "high", "refs", "recent")
    out = s.join(looked, (F.col("edition_id").eqNullSafe(F.col("_edition_id"))) & F.col("id").eqNullSafe(F.col("_id")) & F.col("pos").eqNullSafe(F.col("_pos")), "left")
    ref = lambda e, i: F.get(F.filter("refs", lambda r: r["value"] == _ref(F.col(e), F.col(i))), F.lit(0))
    target, fixed = ref("follow_edition", "follow_story"), ref("correction_edition", "correction_story")
    newest = F.col("newest")
    return out.select(
        *s.columns, F.coalesce("repeats", F.lit(False)).alias("repeats"), newest.isNotNull().cast("int").alias("n_matches"),
        F.when(newest.isNotNull(), F.struct("newest.edition_id", "newest.id", "newest.words", "newest.facts_hash", "newest.cutoff_at")).alias("newest"),
        (newest["words"] == F.col("words")).alias("same_words"), (newest["facts_hash"] == F.col("facts_hash")).alias("same_facts"), (F.col("source_at") > newest["cutoff_at"]).alias("newer_source"),
        (F.col("follow_edition").eqNullSafe(newest["edition_id"]) & F.col("follow_story").eqNullSafe(newest["id"])).alias("follow_newest"),
        F.coalesce(target["n_prior"], F.lit(0)).alias("follow_targets"), (target["issue_id"] == F.col("issue_id")).alias("follow_same_issue"),
        F.when(F.col("high") != F.col("issue_title"), F.col("high")).otherwise(F.col("low")).alias("known_title"),
        F.coalesce(fixed["issue_id"] == F.col("issue_id"), F.lit(False)).alias("correction_found"), F.coalesce("recent", F.lit(False)).alias("recent"),
    )


def history_rules() -> dict[str, Column]:
    """Rules over :func:`with_history` that compare a story with others: for :func:`rules.violations`. Also needs delta (text) and stage."""
    follows = (F.col("n_matches") > 0) | F.col("follow_story").isNotNull()
    corrects = F.col("stage").isin("정정", "철회")
    return {
        "same_edition": ~F.col("repeats"),
        "delta": ~follows | (F.length(F.trim("delta")) >= 15),
        "newest_target": ~follows | (F.col("follow_newest") & (F.col("n_matches") > 0)),
        "new_words": F.col("newest").isNull() | ~F.col("same_words"),
        "new_facts": F.col("newest").isNull() | ~F.col("same_facts"),
        "new_evidence": F.col("newest").isNull() | F.col("newer_source"),
        "one_target": F.col("follow_story").isNull() | (F.col("follow_targets") == 1),
        "target_issue": F.col("follow_story").isNull() | F.coalesce(F.col("follow_same_issue"), F.col("follow_targets") != 1),
        "issue_title": F.col("known_title").isNull() | (F.col("known_title") == F.col("issue_title")),
        "correction": F.when(corrects, F.col("correction_found")).otherwise(F.col("correction_story").isNull()),
        "recent_repeat": ~F.col("recent"),
    }
