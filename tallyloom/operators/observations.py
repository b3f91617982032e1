"""Observed posts: one normalised row each, selection among aliases, holds, and disjoint status rows.

Unknown, zero and failure stay three things: a count that isn't proven is null, and a
flag that can't be told is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text, urls
from tallyloom.operators import views

# States of a capture, of a hold, and the pattern of a relative age.
CAPTURED = "observed"
STOPPED = ("failed", "blocked", "blocked_or_missing")
HOLD_REASON = "relative_age_crosses_window"
AGE = r"^\d+\s*(?:초|분|시간|일|개월|년)\s*전$"


def comment_totals(comments: DataFrame, post: str, start: Column, end: Column) -> DataFrame:
    """Per post from rows (post, cid, n, at, pos): the last row of an id counts (ties: later, then greater); repeats, conflicts, invalid counts, and counts by window.

    Two hash aggregations with map-side combining: a hot post is a row an id and task.
    """
    row = F.struct("n", "at")
    per = comments.groupBy(post, "cid").agg(F.max_by(row, F.struct("pos", "at", "n")).alias("last"), F.count("*").alias("seen"), (F.min(row) != F.max(row)).alias("differs"))
    known, n, at = F.col("cid").isNotNull(), F.col("last.n"), F.col("last.at")
    valid = n.isNotNull() & (n >= 0)
    return per.groupBy(post).agg(
        F.count_if(known).alias("n_comments"),
        F.sum(F.when(known, F.col("seen") - 1).otherwise(F.col("seen"))).alias("duplicate_rows"),
        F.count_if(known & F.col("differs")).alias("n_differing"),
        F.sum(F.when(~known, F.col("seen")).otherwise(0)).alias("n_without_id"),
        F.count_if(known & ~valid).alias("n_invalid"),
        F.sum(F.when(known & valid, n)).alias("k_sum"),
        F.count_if(known & (at < start)).alias("n_before"),
        F.count_if(known & at.between(start, end)).alias("n_within"),
        F.count_if(known & (at > end)).alias("n_after"),
    )


def exclusions(post_id: Column, title: Column, sources: Column) -> Column:
    """Codes of all titles: the tag for each source that has it, any other rule once."""
    titled = F.concat(F.array(F.struct(post_id.alias("id"), title.alias("title"))), F.transform(sources, lambda s: F.struct(s["id"].alias("id"), s["title"].alias("title"))))
    hits = F.flatten(F.transform(titled, lambda s: F.transform(text.classify_title(s["title"]), lambda h: F.struct(h["code"].alias("code"), F.when(h["code"] == text.SAFETY_RULES[0][0], s["id"]).alias("source_id")))))
    return F.array_distinct(hits)


def normalise(posts: DataFrame, comments: DataFrame, start: Column, end: Column, least: int = 11) -> DataFrame:
    """One row per post with its counts, evidence, completeness and candidacy.

    ``posts``: id, url, status, title, observed_at, listed_at, rows_given (were comment rows captured), all_selected, expected, evidence_at,
    sources (id, title), sources_expanded, sources_expected, media (type, url, complete, width, height). ``comments``: (id, cid, n, at, pos).
    A post that its own header proves to be outside the window is resolved: all counts and claims of it become null or false.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    status = F.col("status")
    df = posts.join(comment_totals(comments, "id", start, end), "id", "left")
    df = df.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_comments", "duplicate_rows", "n_differing", "n_without_id", "n_invalid", "n_before", "n_within", "n_after")})
    df = df.withColumns(
        {
            "canonical_id": urls.strip_revision(F.col("id")),
            "n_conflicts": F.col("n_differing") + F.col("n_without_id") + F.when(no(F.col("rows_given")), 0).otherwise(1),
            "observed_k": F.when(F.col("n_invalid") == 0, F.coalesce("k_sum", F.lit(0))),
            "in_window": F.col("listed_at").between(start, end),
            "exclusions": exclusions(F.col("id"), F.col("title"), F.col("sources")),
            "sources_complete": no(F.col("sources_expanded") & (F.size("sources") == F.col("sources_expected"))),
            "media_complete": no(F.col("media").isNotNull() & F.forall("media", _whole)),
            "outside": views.outside_header(status, F.col("id"), F.col("title"), F.col("observed_at"), F.col("listed_at"), urls.post_number(F.col("url")), start, end),
        }
    )
    sound = no(F.col("all_selected")) & (F.col("n_conflicts") == 0) & (F.col("n_invalid") == 0)
    df = df.withColumn("comments_complete", no(sound & (F.col("n_comments") == F.col("expected")))).withColumn("verified", no(F.col("comments_complete") & (status == CAPTURED)))
    context = no((status == CAPTURED) | (status.isin(*STOPPED) & F.col("evidence_at").isNotNull()))
    df = df.withColumn("trusted", F.col("verified") | no(sound & (F.col("n_comments") > 0) & context))
    enough = F.col("observed_k") >= least
    df = df.withColumn("qualified", F.when(F.col("verified"), enough).when(F.col("trusted") & enough, True))
    df = df.withColumn("basis", F.when(F.col("verified"), "exact_native_total").when(F.col("qualified"), "observed_lower_bound"))
    need = no(F.col("qualified"))
    df = df.withColumns(
        {
            "inspected": no((status == CAPTURED) & F.col("listed_at").isNotNull() & F.col("comments_complete") & (~need | (F.col("sources_complete") & F.col("media_complete")))),
            "candidate": need & no(F.col("in_window")) & (F.size("exclusions") == 0),
        }
    )
    held = F.col("candidate") & no(F.col("basis") == "observed_lower_bound")
    reasons = F.array_compact(F.array(F.lit("native_comment_total_unverified"), F.when(~F.col("sources_complete"), "source_list_unverified"), F.when(~F.col("media_complete"), "media_metadata_unverified")))
    out = F.col("outside")
    open_ = lambda c: F.when(~out, c)  # noqa: E731  null where the header settles the post
    settled = lambda c: ~out & c
    return df.select(
        "id", "canonical_id", "status", "in_window", "exclusions", "sources_complete", "media_complete", "outside", "duplicate_rows", "n_conflicts", "n_invalid",
        open_(F.when(F.col("verified"), F.col("observed_k"))).alias("k_count"),
        open_(F.when(F.col("verified"), F.col("n_comments"))).alias("comment_count"),
        open_(F.col("observed_k")).alias("observed_k"),
        open_(F.col("n_comments")).alias("observed_comments"),
        open_(F.when(F.col("trusted"), F.col("observed_k"))).alias("known_minimum"),
        *(open_(F.col(c)).alias(c) for c in ("n_before", "n_within", "n_after")),
        settled(F.col("comments_complete")).alias("comments_complete"),
        settled(F.col("verified")).alias("verified"),
        settled(F.col("trusted")).alias("trusted"),
        open_(F.col("qualified")).alias("qualified"),
        open_(F.col("basis")).alias("basis"),
        F.when(settled(no(~F.col("qualified"))), "literal_k_below_threshold").alias("threshold_exclusion"),
        settled(need).alias("media_check_required"),
        settled(F.col("candidate")).alias("candidate"),
        settled(held).alias("held"),
        F.when(settled(held), reasons).otherwise(F.array().cast("array<string>")).alias("hold_reasons"),
        (out | F.col("inspected")).alias("inspection_complete"),
        F.when(out, "exact_timestamp_outside_fixed_window").alias("window_exclusion"),
    )


def _whole(m: Column) -> Column:
    """A medium with its URL; images must be loaded, images and videos must have a size."""
    size = (m["width"] > 0) & (m["height"] > 0)
    return F.coalesce((m["url"] != "") & ((m["type"] != "image") | (m["complete"] & size)) & ((m["type"] != "video") | size), F.lit(False))


def selected(raw: DataFrame, key: str, complete: str, at: str) -> DataFrame:
    """The best observation of each canonical id (complete first, then latest), with how many there are, how many newer ones are incomplete, and the latest time."""
    w = Window.partitionBy(key)
    best = F.max(F.struct(F.col(complete).cast("int").alias("c"), F.col(at).alias("at"))).over(w)
    marked = raw.withColumn("_at", best["at"])
    rest = [c for c in raw.columns if c != key]
    per = marked.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct(F.col(complete).cast("int"), F.col(at))).alias("_r"),
        F.count("*").alias("n_observations"),
        F.count_if((F.col(at) > F.col("_at")) & ~F.col(complete)).alias("n_newer_incomplete"),
        F.max(at).alias("latest_at"),
    )
    return per.select(key, "_r.*", "n_observations", "n_newer_incomplete", "latest_at")


def own_url(url: Column, post_id: Column) -> Column:
    """The observed URL, if host, path and number are the post's; never made up."""
    own = F.regexp_replace(urls.host(url), "^www[.]", "") == "aagag.com"
    ok = urls.is_safe(url) & own & (F.rtrim(urls.part(url, 3), F.lit("/")) == "/issue") & (urls.post_number(url) == urls.bare_identity(post_id))
    return F.when(ok, url)


def temporal_hold(held: Column, reason: Column, in_window: Column, post_id: Column, evidence: Column) -> Column:
    """The evidence (id, page, phase, observed_at, age, url) of a post whose membership in the window is open; null where it proves nothing."""
    own = urls.bare_identity(evidence["id"]) == urls.bare_identity(post_id)
    ok = held & (reason == HOLD_REASON) & in_window.isNull() & evidence["observed_at"].isNotNull() & (evidence["phase"] == "initial") & own & (evidence["page"] >= 1) & evidence["age"].rlike(AGE) & own_url(evidence["url"], post_id).isNotNull()
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(*(evidence[c].alias(c) for c in ("id", "page", "phase", "observed_at", "age", "url"))))


def field_time(given: Column, value: Column, captured: Column, observed: Column) -> Column:
    """A field's own time where the row has the field, else the row's, if it was captured."""
    return F.when(given, value).when(captured, observed)


def status_rows(df: DataFrame, key: str, states: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(key, status, reason): each row has the first state whose condition holds, so that states are disjoint; rows in none are left out."""
    status, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (ok, why) in reversed(states.items()):
        ok = F.coalesce(ok, F.lit(False))
        status, reason = F.when(ok, name).otherwise(status), F.when(ok, why).otherwise(reason)
    return df.select(key, status.alias("status"), reason.alias("reason")).where(F.col("status").isNotNull())
