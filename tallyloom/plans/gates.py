"""Queries on publication gates: rows drawn from the driver's tables, with faults by arithmetic on their keys.

``_rows`` are columns that both engines read alike; a query packs them into the gate's
shape, its twin states the gate's rules over the plain columns. Each gives the number of
rows that break each rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import gates, rules
from tallyloom.plans.registry import query

_NOW = "TIMESTAMP '1998-01-01 09:00:00'"


def _now() -> Column:
    return F.expr("TIMESTAMP_NTZ'1998-01-01 09:00:00'")


def _twin(table: str, columns: dict[str, str], rule: dict[str, str]) -> str:
    """Rows of ``columns``; how many break each of the rules (those that can)."""
    rows = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    each = " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) AS n FROM r WHERE NOT coalesce({ok}, false)" for name, ok in rule.items())
    return f"WITH r AS (SELECT {rows} FROM {table}) SELECT rule, n FROM ({each}) WHERE n > 0"


def _frame(t, table: str, columns: dict[str, str]) -> DataFrame:
    return getattr(t, table).selectExpr(*(f"{v} AS {k}" for k, v in columns.items()))


def _counted(df: DataFrame, rule: gates.Rules) -> DataFrame:
    return rules.counts(rules.violations(df, "k", rule))


def _texts(**columns: str) -> list[Column]:
    """Constant text columns."""
    return [F.lit(v).alias(c) for c, v in columns.items()]


def _hours(c: str, n: int) -> str:
    return f"{c} + INTERVAL '{n}' HOUR"


_CHECKS = {
    "k": "o_orderkey",
    "id": "CASE WHEN o_orderkey % 11 = 0 THEN 'Bad Id' ELSE concat('check-', o_orderkey) END",
    "channel": "CASE WHEN o_orderkey % 7 = 0 THEN 'mail' WHEN o_orderkey % 2 = 0 THEN 'news' ELSE 'topics' END",
    "status": "CASE o_orderkey % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'empty' WHEN 2 THEN 'blocked' WHEN 3 THEN 'failed' WHEN 4 THEN 'partial' ELSE 'lost' END",
    "count": "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN -1 ELSE 3 END",
    "checked_at": "o_orderdate",
    "source": "CASE WHEN o_orderkey % 13 = 0 THEN '  ' ELSE o_orderpriority END",
    "note": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'seen' END",
}


@query(
    _twin(
        "orders",
        _CHECKS,
        {
            "id": "id LIKE 'check-%'",
            "channel": "channel IN ('community', 'topics', 'news')",
            "status": "status <> 'lost'",
            "time": f"checked_at <= {_NOW}",
            "source": "trim(source) <> ''",
            "note": "note IS NOT NULL",
            "count": "count IS NULL OR count >= 0",
            "empty_is_zero": "status <> 'empty' OR (count IS NOT NULL AND count = 0)",
            "failure_is_unknown": "status NOT IN ('blocked', 'failed') OR count IS NULL",
        },
    )
)
def check_gate(t):
    """Collection checks: zero results, unknown and failure are three things."""
    return _counted(_frame(t, "orders", _CHECKS), gates.check_record(_now()))


_SOURCES = {
    "k": "l_orderkey * 10 + l_linenumber",
    "url": "CASE WHEN l_partkey % 9 = 0 THEN 'https://localhost/x' WHEN l_partkey % 8 = 0 THEN concat('https://u:p@site', l_suppkey, '.com/a') ELSE concat('https://site', l_suppkey, '.com/a?b=', l_partkey) END",
    "other_url": "CASE WHEN l_partkey % 5 = 0 THEN concat('HTTPS://SITE', l_suppkey, '.com/a/?utm_source=z&b=', l_partkey, '#f') ELSE 'https://other.com/' END",
    "platform": "CASE l_linenumber % 4 WHEN 0 THEN 'instagram' WHEN 1 THEN 'x' WHEN 2 THEN 'other' ELSE 'forum' END",
    "region": "CASE WHEN l_suppkey % 3 = 0 THEN 'KR' ELSE 'unknown' END",
    "region_url": "CASE WHEN l_suppkey % 2 = 0 THEN 'https://trends.example.com/kr' ELSE NULL END",
    "verified_at": "l_shipdate",
    "published_at": f"CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE {_hours('l_shipdate', -5)} END",
    "period_start": "CASE WHEN l_partkey % 3 = 0 THEN l_shipdate ELSE NULL END",
    "period_end": f"CASE WHEN l_partkey % 6 = 0 THEN {_hours('l_shipdate', -1)} ELSE NULL END",
    "n_quotes": "l_linenumber",
}


@query(
    _twin(
        "lineitem",
        _SOURCES,
        {
            "source_url": "url NOT LIKE 'https://localhost%' AND url NOT LIKE '%@%'",
            "source_unique": "NOT (other_url LIKE 'HTTPS%' AND url LIKE '%b=%')",
            "source_verified": f"verified_at <= {_NOW}",
            "source_platform": "platform <> 'forum'",
            "source_region": "CASE WHEN region = 'KR' THEN region_url IS NOT NULL ELSE region_url IS NULL END",
            "source_auxiliary": "platform <> 'instagram' OR region = 'unknown'",
            "source_period": "CASE WHEN period_start IS NULL THEN period_end IS NULL ELSE period_start < period_end AND period_end <= verified_at END",
            "source_words": "3 + 5 * n_quotes <= 25",
        },
    )
)
def source_gate(t):
    """Source lists: public URLs once each, regions with evidence, periods in order, short quotations."""
    rows = _frame(t, "lineitem", _SOURCES)
    quotes = F.array_repeat(F.lit("five words of a quotation"), F.col("n_quotes").cast("int"))
    own = F.struct("url", *_texts(name="Site", title="Three plain words", limitations="none"), "platform", "region", "region_url", "verified_at", "published_at", "period_start", "period_end", quotes.alias("quotes"))
    none = F.lit(None)
    other = F.struct(
        F.col("other_url").alias("url"), *_texts(name="Other", title="Title", limitations="none", platform="other", region="unknown"), none.cast("string").alias("region_url"), F.expr("TIMESTAMP_NTZ'1992-01-01 00:00:00'").alias("verified_at"),
        *(none.cast("timestamp_ntz").alias(c) for c in ("published_at", "period_start", "period_end")), F.array().cast("array<string>").alias("quotes"),
    )
    fixed = F.when(F.col("other_url").startswith("HTTPS"), F.struct(F.lower(other["url"]).alias("url"), *(other[c].alias(c) for c in ("name", "title", "limitations", "platform", "region", "region_url", "verified_at", "published_at", "period_start", "period_end", "quotes")))).otherwise(other)
    return _counted(rows.select("k", F.array(own, fixed).alias("sources")), gates.source_list(F.col("sources"), _now()))


_ITEMS = {
    "k": "o_orderkey",
    "id": "CASE WHEN o_orderkey % 11 = 0 THEN '-bad' ELSE concat('item-', o_orderkey) END",
    "kind": "CASE o_orderkey % 3 WHEN 0 THEN 'topic' WHEN 1 THEN 'community' ELSE 'advert' END",
    "title": "CASE WHEN o_orderkey % 10 = 0 THEN 'ㅇㅎ tagged' ELSE 'Plain title' END",
    "summary": "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'What happened' END",
    "safety_checked": "o_orderkey % 5 <> 0",
    "rights_checked": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE true END",
    "first_at": "o_orderdate",
    "last_at": f"CASE WHEN o_orderkey % 9 = 0 THEN {_hours('o_orderdate', -2)} ELSE {_hours('o_orderdate', 2)} END",
    "expected_revision": "o_orderkey % 6 - 1",
    "value": "CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN CAST(-1 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END",
}


@query(
    _twin(
        "orders",
        _ITEMS,
        {
            "id": "id LIKE 'item-%'",
            "kind": "kind <> 'advert'",
            "summary": "CASE WHEN kind = 'community' THEN summary = '' ELSE summary <> '' END",
            "reviewed": "safety_checked AND rights_checked",
            "times": f"first_at <= last_at AND last_at <= {_NOW}",
            "revision": "expected_revision >= 0",
            "tags": "title NOT LIKE 'ㅇㅎ%'",
            "observed": "last_at >= first_at",
            "value": "value IS NULL OR (NOT isnan(value) AND value >= 0)",
            "source_verified": "last_at >= TIMESTAMP '1992-06-01 00:00:00'",
        },
    )
)
def live_item_gate(t):
    """Revisioned items: reviewed, in order of time, observed at verified sources."""
    url = F.lit("https://aagag.com/issue/?idx=5")
    null = F.lit(None)
    source = F.struct(
        url.alias("url"), *_texts(name="Site", title="Title", limitations="none", platform="aagag", region="unknown"), null.cast("string").alias("region_url"), F.expr("TIMESTAMP_NTZ'1992-06-01 00:00:00'").alias("verified_at"),
        *(null.cast("timestamp_ntz").alias(c) for c in ("published_at", "period_start", "period_end")), F.array().cast("array<string>").alias("quotes"),
    )
    seen = F.struct(url.alias("source_url"), F.col("first_at").alias("observed_at"), *_texts(metric="views", unit="count", scope="site"), "value")
    community = F.col("kind") == "community"
    rows = _frame(t, "orders", _ITEMS).select(
        "*", *_texts(topic_key="topic", limitations="none", reason="of interest"), url.alias("canonical_url"), F.array(source).alias("sources"), F.array(seen).alias("observations"),
        F.when(community, F.col("id")).alias("content_id"), F.when(community, F.col("title")).alias("content_title"),
    )
    return _counted(rows, gates.live_item(_now()))


_POSTS = {
    "k": "c_custkey",
    "id": "CASE WHEN c_custkey % 10 = 0 THEN 'aagag-1' ELSE concat('aagag-', c_custkey) END",
    "canonical_url": "concat('https://aagag.com/issue/?idx=', c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '_2' ELSE '' END)",
    "age_hours": "CAST(c_custkey % 30 AS INT)",
    "verified": "c_custkey % 7 <> 0",
    "method": "CASE WHEN c_custkey % 3 = 0 THEN 'aagag-otime' WHEN c_custkey % 3 = 1 THEN 'aagag-explicit-publication' ELSE 'guess' END",
    "off": "CASE WHEN c_custkey % 4 = 0 THEN 5 ELSE 0 END",
    "reported": "CAST(2 + CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS INT)",
    "laughs": "CAST(c_custkey % 12 AS INT)",
    "n_words": "CAST(c_custkey % 15 AS INT)",
    "portal": "CASE WHEN c_custkey % 8 = 0 THEN 'https://example.com/p' ELSE 'https://x.com/p' END",
}


@query(
    _twin(
        "customer",
        _POSTS,
        {
            "id": "id = concat('aagag-', k)",
            "proof": "verified AND method <> 'guess' AND id = concat('aagag-', k)",
            "fresh": "age_hours < 24",
            "proof_epoch": "method <> 'aagag-otime' OR off = 0",
            "comments_of_post": "id = concat('aagag-', k)",
            "comments_total": "reported = 2",
            "threshold": "laughs + 4 >= 10",
            "quoted_words": "2 + n_words * 2 <= 25",
            "page_words": "2 + 2 + n_words * 2 <= 25",
            "portals": "portal LIKE 'https://x.com%'",
        },
    )
)
def rolling_item_gate(t):
    """Rolling posts: exact publication evidence, reconciled comments, one quotation budget for a page."""
    now = _now()
    rows = _frame(t, "customer", _POSTS).withColumn("published_at", now - F.make_dt_interval(hours="age_hours")).withColumn("first_at", now).withColumn("last_at", now)
    epoch = (F.unix_timestamp("published_at") + F.col("off")).cast("string")
    proof = F.struct("method", F.col("canonical_url").alias("source_url"), F.col("published_at").alias("value"), F.when(F.col("method") == "aagag-otime", epoch).otherwise("shown").alias("raw"), now.alias("observed_at"), "verified")
    cell = lambda i, n: F.struct(F.lit(i).alias("id"), n.cast("long").alias("n"))
    native = F.struct(F.col("canonical_url").alias("source_url"), now.alias("observed_at"), "reported", F.array(cell("1", F.col("laughs")), cell("2", F.lit(4)), cell("2", F.lit(4))).alias("rows"))
    review = F.struct(F.lit(True).alias("safety"), F.lit(True).alias("rights"), now.alias("verified_at"), F.lit("looked at").alias("note"))
    source = F.struct(F.col("canonical_url").alias("url"), *_texts(name="Site", title="Source title"), now.alias("verified_at"), F.col("published_at"), F.array().cast("array<string>").alias("quotes"))
    quote = F.struct(F.lit("1").alias("id"), F.array_join(F.array_repeat(F.lit("two words"), F.col("n_words")), " ").alias("text"))
    content = F.struct(F.lit("").alias("original_text"), F.array(quote).alias("quotes"), F.array("portal").alias("portal_links"), F.array().cast("array<string>").alias("signals"))
    rows = rows.select("*", F.lit(0).alias("expected_revision"), proof.alias("proof"), native.alias("comments"), review.alias("review"), *_texts(title="Post title", limitations="none"), F.array(source).alias("sources"), content.alias("content"))
    return _counted(rows, gates.rolling_item(now))


_IMAGES = {
    "k": "p_partkey",
    "first_url": "CASE WHEN p_partkey % 5 = 0 THEN 'https://127.0.0.1/a.png' ELSE concat('https://img.example.com/', p_size, '.png#top') END",
    "second_url": "CASE WHEN p_partkey % 3 = 0 THEN concat('HTTPS://IMG.EXAMPLE.COM/', p_size, '.png') ELSE 'https://img.example.com/other.png' END",
    "width": "CAST(p_size % 10 AS BIGINT)",
    "source_url": "CASE WHEN p_partkey % 4 = 0 THEN 'https://b.example.com/' ELSE 'https://a.example.com/' END",
}


@query(
    _twin(
        "part",
        _IMAGES,
        {
            "image_source": "source_url LIKE 'https://a.%'",
            "image_host": "first_url NOT LIKE '%127%'",
            "image_size": "width >= 1",
            "image_unique": "NOT (first_url LIKE '%img%' AND second_url LIKE 'HTTPS%')",
        },
    )
)
def image_gate(t):
    """Body images: public hosts, positive sizes, unique without their fragment."""
    image = lambda u: F.struct(F.col(u).alias("url"), "width", F.lit(3).cast("long").alias("height"))
    rows = _frame(t, "part", _IMAGES).select("k", "source_url", F.array(image("first_url"), image("second_url")).alias("images"))
    return _counted(rows, gates.body_images(F.col("images"), F.col("source_url"), F.array(F.lit("https://a.example.com/"))))


_ENTRIES = {
    "k": "o_orderkey",
    "issue_id": "CASE WHEN o_orderkey % 12 = 0 THEN 'No Slug' ELSE concat('issue-', o_custkey) END",
    "stage": "CASE o_orderkey % 4 WHEN 0 THEN '예정' WHEN 1 THEN '정정' ELSE '확정' END",
    "change": "CASE WHEN o_orderkey % 9 = 0 THEN 'too short' ELSE 'A change that is long enough' END",
    "event_date": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END",
    "event_end": "CASE WHEN o_orderkey % 7 = 0 THEN DATE '1995-01-01' ELSE NULL END",
    "event_zone": "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'Asia/Seoul' END",
    "known_title": "CASE WHEN o_orderkey % 8 = 0 THEN 'Another title' WHEN o_orderkey % 8 = 1 THEN 'Title' ELSE NULL END",
    "correction_of": "CASE WHEN o_orderkey % 6 = 0 THEN 'item-1' ELSE NULL END",
    "correction_found": "o_orderkey % 3 = 0",
    "follow_up": "CASE WHEN o_orderkey % 2 = 0 THEN 'item-2' ELSE NULL END",
    "follow_up_targets": "o_orderkey % 3",
}


@query(
    _twin(
        "orders",
        _ENTRIES,
        {
            "issue": "issue_id LIKE 'issue-%'",
            "change": "length(change) >= 15",
            "unknown_stays_unknown": "event_date IS NOT NULL OR (event_end IS NULL AND event_zone IS NULL)",
            "zone": "event_date IS NULL OR event_zone IS NOT NULL",
            "order": "event_date IS NULL OR coalesce(event_end, event_date) >= event_date",
            "not_ahead": "event_date IS NULL OR stage = '예정' OR (event_zone IS NOT NULL AND coalesce(event_end, event_date) <= DATE '1998-01-01')",
            "issue_title_kept": "known_title IS NULL OR known_title = 'Title'",
            "correction": "CASE WHEN stage = '정정' THEN correction_found ELSE correction_of IS NULL END",
            "follow_up": "follow_up IS NULL OR follow_up_targets = 1",
        },
    )
)
def timeline_gate(t):
    """Timeline entries: unknown dates stay unknown, nothing ahead is told as done, corrections find their target."""
    rows = _frame(t, "orders", _ENTRIES).select("*", *_texts(issue_title="Title"), F.lit(None).cast("timestamp").alias("event_at"), F.lit(None).cast("boolean").alias("follow_up_same_issue"))
    return _counted(rows, gates.timeline_entry(F.expr("TIMESTAMP'1998-01-01 00:00:00'")))


_HEADS = {
    "k": "o_orderkey",
    "date": "CASE WHEN o_orderkey % 20 = 0 THEN '1996-02-30' ELSE '2026-10-12' END",
    "edition": "CASE o_orderkey % 5 WHEN 0 THEN 'am' WHEN 1 THEN 'noon' ELSE 'pm' END",
    "id_tail": "CASE WHEN o_orderkey % 7 = 0 THEN 'am' ELSE 'pm' END",
    "early": "CAST(o_orderkey % 3 AS INT)",
    "made_after": "CAST(o_orderkey % 4 - 1 AS INT)",
    "n_overview": "CAST(o_orderkey % 6 AS INT)",
    "stress": "CASE o_orderkey % 8 WHEN 0 THEN 'absent' WHEN 1 THEN NULL ELSE 'paragraph' END",
    "n_stories": "CAST(o_orderkey % 25 AS INT)",
    "n_story_ids": "CAST(o_orderkey % 25 - CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS INT)",
    "n_events": "CAST(o_orderkey % 8 AS INT)",
}


def _heads(t) -> DataFrame:
    due = F.when(F.col("edition") == "am", F.lit(9)).otherwise(F.lit(21))
    start = F.to_timestamp_ntz(F.lit("2026-10-12 00:00:00"))
    cutoff = start + F.make_dt_interval(hours=due) - F.make_dt_interval(mins=F.col("early") * 30)
    made = cutoff + F.make_dt_interval(mins=F.col("made_after") * 30)
    words = F.array_repeat(F.lit("A paragraph of some length"), F.col("n_overview"))
    return _frame(t, "orders", _HEADS).select(
        "*", F.concat_ws("-", "date", "id_tail").alias("id"), F.lit(1).alias("version"), F.lit("Asia/Seoul").alias("zone"), cutoff.alias("cutoff_at"), made.alias("generated_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"), F.lit("Intro").alias("intro"), words.alias("overview"), F.when(F.col("stress").isNotNull(), F.array("stress")).alias("emphasis"),
    )


@query(
    _twin(
        "orders",
        _HEADS,
        {
            "head": "edition <> 'noon'",
            "id": "edition = id_tail",
            "cutoff": "early = 0 AND date = '2026-10-12'",
            "generated": "made_after >= 0",
            "overview": "n_overview BETWEEN 2 AND 4",
            "emphasis": "stress IS NULL OR (stress = 'paragraph' AND n_overview > 0)",
            "stories": "n_stories > 0 AND n_stories = n_story_ids",
            "events": "n_events <= 6",
        },
    )
)
def edition_head_gate(t):
    """Editions: identity, cut-off by contract version, order of times, overview, unique stories."""
    return _counted(_heads(t), gates.edition(F.expr("TIMESTAMP_NTZ'2026-10-13 00:00:00'")))


@query(
    _twin(
        "orders",
        _HEADS,
        {
            "head": "edition <> 'noon' AND date = '2026-10-12'",
            "id": "edition = id_tail",
            "cutoff": "early = 0 AND date = '2026-10-12' AND edition <> 'am' AND id_tail = 'pm' OR early = 0 AND date = '2026-10-12' AND edition = 'am' AND id_tail = 'am'",
            "generated": "made_after >= 0",
            "overview": "n_overview BETWEEN 1 AND 4",
            "stories": "n_stories BETWEEN 3 AND 20 AND n_stories = n_story_ids",
        },
    )
)
def community_head_gate(t):
    """Community editions: 3 to 20 unique stories, cut-off at the edition's own hour."""
    return _counted(_heads(t), gates.community_edition())


_STORIES = {
    "k": "l_orderkey * 10 + l_linenumber",
    "edition_id": "CASE WHEN l_orderkey % 2 = 0 THEN '2026-10-20-am' ELSE '2026-10-12-pm' END",
    "id": "CASE WHEN l_partkey % 19 = 0 THEN 'Not A Slug' ELSE concat('s-', l_partkey) END",
    "status": "CASE WHEN l_partkey % 6 = 0 THEN '소문' ELSE '확정' END",
    "n_summary": "CAST(l_linenumber AS INT)",
    "stress": "CASE WHEN l_suppkey % 5 = 0 THEN 'absent' ELSE 'explains' END",
    "n_facts": "CAST(l_suppkey % 3 + 1 AS INT)",
    "language": "CASE WHEN l_partkey % 4 = 0 THEN 'en' ELSE 'ko' END",
    "age_hours": "CAST(l_partkey % 90 AS INT)",
    "verified_before": "CAST(l_partkey % 9 AS INT)",
    "fallback_note": "CASE WHEN l_suppkey % 2 = 0 THEN 'older' ELSE NULL END",
    "n_matches": "CAST(l_linenumber % 2 AS INT)",
    "delta": "CASE WHEN l_partkey % 7 = 0 THEN 'short' WHEN l_partkey % 7 < 4 THEN 'A substantive difference' ELSE NULL END",
    "same_facts": "l_partkey % 5 = 0",
    "reliability": "CAST(50 + l_partkey % 60 AS DOUBLE)",
    "importance": "CAST(50 + l_suppkey % 50 AS DOUBLE)",
    "placement": "CASE l_linenumber % 4 WHEN 0 THEN 'lead' WHEN 1 THEN 'additional' WHEN 2 THEN NULL ELSE 'top' END",
    "other_rank": "CAST(l_linenumber % 4 AS INT)",
}
_FOLLOWS = "(n_matches > 0 OR delta IS NOT NULL)"
_SCORE = "(CAST(importance AS DECIMAL(10,2)) * CAST(0.35 AS DECIMAL(4,2)) + CAST(reliability AS DECIMAL(10,2)) * CAST(0.10 AS DECIMAL(4,2)) + 50 * (0.20 + 0.10 + 0.25))"


@query(
    _twin(
        "lineitem",
        _STORIES,
        {
            "id": "id LIKE 's-%'",
            "status": "status <> '소문'",
            "summary": "n_summary BETWEEN 2 AND 6",
            "emphasis": "stress = 'explains'",
            "facts": "n_facts >= 2",
            "sources": "language = 'ko'",
            "sources_in_time": "verified_before <= 6",
            "age": "age_hours <= 72",
            "older_labelled": "age_hours <= 21 OR fallback_note IS NOT NULL",
            "follow_up": f"NOT {_FOLLOWS} OR (delta IS NOT NULL AND delta <> 'short')",
            "follow_up_is_new": f"NOT {_FOLLOWS} OR NOT same_facts",
            "scores": "reliability <= 100",
            "placement": "placement IS NULL OR placement <> 'top'",
            "lead": f"placement IS NULL OR placement <> 'lead' OR (reliability >= 70 AND (edition_id = '2026-10-20-am' OR (importance >= 70 AND {_SCORE} >= 65)))",
            "alternatives": "other_rank IN (2, 3)",
        },
    )
)
def story_gate(t):
    """Stories of an edition: evidence, freshness, follow-ups that bring something new, scores and leads."""
    cutoff = F.expr("TIMESTAMP_NTZ'2026-10-20 21:00:00'")
    made = cutoff + F.expr("INTERVAL 9 HOURS")
    published = cutoff - F.make_dt_interval(hours="age_hours")
    none = F.lit(None)
    rows = _frame(t, "lineitem", _STORIES)
    source = lambda url: F.struct(F.lit(url).alias("url"), F.col("language"), published.alias("published_at"), (made - F.make_dt_interval(hours="verified_before")).alias("verified_at"))
    paragraph = F.lit("A paragraph that explains it all")
    facts = F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.col("n_facts")), lambda i: i.cast("string")), F.array_repeat(F.lit("v"), F.col("n_facts")))
    scores = F.struct(F.col("importance"), F.lit(50.0).alias("domestic"), F.col("reliability"), F.lit(50.0).alias("interest"), F.lit(50.0).alias("recency"))
    other = F.struct(F.col("other_rank").alias("rank"), *_texts(title="Other", name="Site", url="https://example.com/o"))
    rows = rows.select(
        "*", *_texts(topic_key="t", category="c", title="Title", event_note="noted", changed="changed", matters="matters", uncertainty="none", score_reason="because", own_url="https://example.com/own"),
        F.array_repeat(paragraph, F.col("n_summary")).alias("summary"), F.array("stress").alias("emphasis"), facts.alias("facts"), F.array(source("https://example.com/1")).alias("sources"), F.array(source("https://example.com/2")).alias("related"),
        published.alias("published_at"), scores.alias("scores"), F.array(other).alias("alternatives"), F.lit(False).alias("same_words"), F.lit(True).alias("newer_source"), none.alias("unused"),
    )
    return _counted(rows, gates.edition_story(cutoff, made))


_COMMUNITY = {
    "k": "c_custkey",
    "category": "CASE WHEN c_mktsegment = 'BUILDING' THEN 'humour' WHEN c_mktsegment = 'MACHINERY' THEN 'retired' ELSE 'talk' END",
    "title": "CASE WHEN c_custkey % 6 = 0 THEN 'ㅎㅂ title' ELSE 'Plain title' END",
    "k_count": "CAST(c_nationkey AS BIGINT) - 1",
    "n_words": "CAST(c_custkey % 30 AS INT)",
    "age_hours": "CAST(c_custkey % 40 AS INT)",
    "portal": "CASE WHEN c_custkey % 4 = 0 THEN 'https://instagram.com.evil.net/p' ELSE 'https://www.instagram.com/p' END",
    "second_name": "CASE WHEN c_custkey % 5 = 0 THEN 'one' ELSE 'two' END",
}


@query(
    _twin(
        "customer",
        _COMMUNITY,
        {
            "category": "category <> 'retired'",
            "tags": "title = 'Plain title'",
            "threshold": "category <> 'humour' OR k_count >= 11",
            "counts": "k_count >= 0",
            "words": "2 + n_words <= 25",
            "quotes": "n_words > 0",
            "source_age": "age_hours BETWEEN 12 AND 24",
            "portals": "portal LIKE 'https://www.%'",
            "breakdown": "second_name = 'two'",
        },
    )
)
def community_story_gate(t):
    """Community stories: active categories, the literal threshold for humour, one quotation budget, source age."""
    cutoff = F.expr("TIMESTAMP_NTZ'2026-10-20 21:00:00'")
    source = F.struct(*_texts(url="https://example.com/1", name="Site", title="Source"), cutoff.alias("verified_at"), (cutoff - F.make_dt_interval(hours="age_hours")).alias("published_at"))
    quote = F.struct(F.lit("1").alias("id"), F.array_join(F.array_repeat(F.lit("word"), F.col("n_words")), " ").alias("text"))
    part = lambda n: F.struct(n.alias("name"), F.lit(2).alias("count"))
    rows = _frame(t, "customer", _COMMUNITY).select(
        "*", *_texts(topic_key="t", reason="r", popularity="p", verification="v"), F.lit(3).cast("long").alias("n_comments"), cutoff.alias("comments_at"), F.array(quote).alias("quotes"), F.lit(None).cast("string").alias("original_text"),
        F.array().cast("array<string>").alias("signals"), F.array(source).alias("sources"), F.array("portal").alias("portal_links"), F.array(part(F.lit("one")), part(F.col("second_name"))).alias("breakdown"),
    )
    return _counted(rows, gates.community_story(cutoff, cutoff, ("humour", "talk"), "humour"))


_PLACES = {
    "k": "p_partkey",
    "repo": "CASE WHEN p_partkey % 9 = 0 THEN 'no-owner' ELSE concat('owner/repo', p_size) END",
    "image_repo": "CASE WHEN p_partkey % 5 = 0 THEN 'owner/other' WHEN p_partkey % 9 = 0 THEN 'no-owner' ELSE concat('owner/repo', p_size) END",
    "place": "CAST(p_partkey % 10 + 1 AS INT)",
    "rank": "CAST(CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE p_partkey % 10 + 1 END AS INT)",
    "stars": "CAST(p_size - 3 AS BIGINT)",
    "facts_checked": "p_partkey % 4 <> 0",
    "stress": "CASE WHEN p_partkey % 6 = 0 THEN 'absent' ELSE 'useful' END",
    "image_file": "CASE WHEN p_partkey % 8 = 0 THEN '../a.png' ELSE 'a.png' END",
    "image_sha256": "CASE WHEN p_partkey % 3 = 0 THEN 'aa' ELSE 'bb' END",
}


@query(
    _twin(
        "part",
        _PLACES,
        {
            "repo": "repo LIKE 'owner/%'",
            "order": "rank = place AND image_repo = repo",
            "stars": "stars >= 0",
            "reviewed": "facts_checked",
            "emphasis": "stress = 'useful'",
            "image": "image_file = 'a.png' AND image_sha256 = 'bb'",
        },
    )
)
def ranking_gate(t):
    """Places of a reviewed ranking: one repository through all lists, images unchanged since review."""
    rows = _frame(t, "part", _PLACES).select(
        "*", F.col("repo").alias("analysis_repo"), F.col("repo").alias("review_repo"), F.lit(True).alias("image_checked"), F.lit("bb").alias("image_digest"), F.array("stress").alias("emphasis"),
        *_texts(notes="n", title="t", summary="a useful thing", use_case="u", requirements="r", alt="a", caption="c", image_url="https://example.com/i"), F.array(F.lit("e")).alias("explanation"), F.array(F.struct(*_texts(label="l", url="https://example.com"))).alias("sources"),
    )
    return _counted(rows, gates.ranking_item())


_RANKINGS = {
    "k": "s_suppkey",
    "date": "CASE WHEN s_suppkey % 9 = 0 THEN '2026-13-01' ELSE '2026-10-12' END",
    "captured_hour": "CAST(s_suppkey % 24 AS INT)",
    "period": "CASE WHEN s_suppkey % 5 = 0 THEN 'weekly' ELSE 'daily' END",
    "approved": "CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE true END",
    "image_digest": "CASE WHEN s_suppkey % 4 = 0 THEN 'new' ELSE 'old' END",
    "n_repos": "CAST(10 - CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS INT)",
}


@query(
    _twin(
        "supplier",
        _RANKINGS,
        {
            "dates": "date = '2026-10-12' AND captured_hour < 15",
            "scope": "period = 'daily'",
            "approved": "approved",
            "unchanged": "image_digest = 'old'",
            "ten": "n_repos = 10",
        },
    )
)
def ranking_head_gate(t):
    """Rankings: dates agree in Korea, review covers these very parts, exactly ten."""
    captured = F.expr("TIMESTAMP'2026-10-12 00:00:00'") + F.make_dt_interval(hours="captured_hour")
    pair = lambda v: F.create_map(F.lit("snapshot"), F.lit("same"), F.lit("images"), v)
    rows = _frame(t, "supplier", _RANKINGS).select(
        "*", F.col("date").alias("analysis_date"), F.col("date").alias("review_date"), F.lit(gates.RANKING_URL).alias("url"), F.lit("all").alias("language"), captured.alias("captured_at"), F.lit(True).alias("complete"), F.lit("Intro").alias("intro"),
        pair(F.col("image_digest")).alias("digests"), pair(F.lit("old")).alias("reviewed"), F.lit(10).alias("n_items"), F.lit(10).alias("n_reviews"),
    )
    return _counted(rows, gates.ranking_edition())


_HANDOFFS = {
    "k": "o_orderkey",
    "edition": "CASE WHEN o_orderkey % 2 = 0 THEN '2026-10-12-am' ELSE '2026-10-12-pm' END",
    "cutoff_at": "TIMESTAMP '2026-10-12 09:00:00'",
    "operation_id": "CASE WHEN o_orderkey % 5 = 0 THEN 'publish' ELSE concat('publish-news-', CASE WHEN o_orderkey % 2 = 0 THEN '2026-10-12-am' ELSE '2026-10-12-pm' END) END",
    "payload": "o_orderpriority",
    "reviewed_payload": "CASE WHEN o_orderkey % 3 = 0 THEN 'changed since' ELSE o_orderpriority END",
    "completed_at": "o_orderdate",
    "n_checks": "CAST(4 - o_orderkey % 4 / 3 AS INT)",
    "supported": "o_orderkey % 7 <> 0",
    "cited": "o_orderstatus",
}


@query(
    _twin(
        "orders",
        _HANDOFFS | {"n_checks": "CAST(floor(4 - (o_orderkey % 4) / 3) AS INT)"},
        {
            "cutoff": "edition = '2026-10-12-am'",
            "operation": "operation_id <> 'publish'",
            "payload": "sha256(payload) = sha256(reviewed_payload)",
            "times": f"completed_at <= {_NOW}",
            "checks": "n_checks = 4",
            "sources": "supported",
            "cited": "cited IN ('F', 'O')",
        },
    )
)
def handoff_gate(t):
    """Handoffs: the review covers this payload and history, all sources are open and cited ones reviewed."""
    rows = _frame(t, "orders", _HANDOFFS | {"n_checks": "CAST(floor(4 - (o_orderkey % 4) / 3) AS INT)", "cutoff_at": "TIMESTAMP_NTZ '2026-10-12 09:00:00'"}).select(
        "k", "edition", "cutoff_at", "operation_id", F.col("edition").alias("review_edition"), F.lit(True).alias("approved"), "payload", F.sha2("reviewed_payload", 256).alias("payload_sha256"), F.lit("h").alias("history"), F.sha2(F.lit("h"), 256).alias("history_sha256"),
        "completed_at", F.col("completed_at").alias("verified_at"), F.array_repeat(F.lit(True), F.col("n_checks")).alias("checks"), F.array(F.struct(F.lit(True).alias("accessible"), "supported")).alias("sources"), F.array("cited").alias("cited"), F.array(F.lit("F"), F.lit("O")).alias("reviewed_urls"),
    )
    return _counted(rows, gates.handoff(_now()))


_STATES = {
    "k": "o_orderkey",
    "extra": "CASE WHEN o_orderkey % 6 = 0 THEN 'secret' ELSE 'window' END",
    "run_key": "CASE WHEN o_orderkey % 5 = 0 THEN 'short' ELSE sha256(o_orderpriority) END",
    "window_start": "o_orderdate",
    "window_end": f"CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate ELSE {_hours('o_orderdate', 24)} END",
    "revision": "o_orderkey % 4 - 1",
    "seen": "CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN -1 ELSE 5 END",
    "covered": "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE true END",
    "phase": "CASE o_orderkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'ready' ELSE 'asleep' END",
    "lease_owner": "CASE WHEN o_orderkey % 2 = 0 THEN 'node-1' ELSE NULL END",
}


@query(
    _twin(
        "orders",
        _STATES,
        {
            "fields": "extra = 'window'",
            "digests": "length(run_key) = 64",
            "window": "window_start < window_end",
            "revision": "revision >= 0",
            "progress": "seen IS NULL OR seen >= 0",
            "coverage": "covered IS NOT NULL",
            "phase": "phase <> 'asleep' AND (phase = 'running') = (lease_owner IS NOT NULL)",
        },
    )
)
def projection_gate(t):
    """Remote projections: exactly the known fields, unknown counts null, a lease only while running."""
    columns = _STATES | {"run_key": "CASE WHEN o_orderkey % 5 = 0 THEN 'short' ELSE sha2(o_orderpriority, 256) END"}
    rows = _frame(t, "orders", columns).select(
        "*", F.array(F.lit("runKey"), F.col("extra")).alias("fields"), F.array(F.lit("runKey"), F.lit("window")).alias("known"), F.sha2(F.lit("a"), 256).alias("source_sha256"), F.sha2(F.lit("b"), 256).alias("evidence_sha256"),
        F.col("window_start").alias("checkpoint_at"), F.array("seen").alias("progress"), F.array("covered").alias("coverage"), F.col("window_end").alias("lease_until"), F.lit(None).cast("string").alias("outcome"),
    )
    return _counted(rows, gates.projection())


_STORED = {
    "k": "p_partkey",
    "kind": "CASE WHEN p_partkey % 4 = 0 THEN 'advert' ELSE 'topic' END",
    "title": "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_name END",
    "region": "CASE WHEN p_size % 5 = 0 THEN 'US' ELSE 'KR' END",
    "value": "CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST('NaN' AS DOUBLE) ELSE p_retailprice END",
    "width": "p_size % 7",
}


@query(
    _twin(
        "part",
        _STORED,
        {
            "item": "kind <> 'advert' AND title IS NOT NULL",
            "sources": "region <> 'US'",
            "observations": "value IS NULL OR NOT isnan(value)",
            "images": "width > 0",
        },
    )
)
def reader_gate(t):
    """Stored items as a reader checks them before use."""
    now, url = _now(), F.lit("https://example.com/a")
    rows = _frame(t, "part", _STORED).select(
        "*", F.col("k").cast("string").alias("id"), *(now.alias(c) for c in ("first_at", "last_at", "recorded_at")),
        F.array(F.struct(url.alias("url"), now.alias("verified_at"), "region", F.lit(None).cast("string").alias("region_url"))).alias("sources"),
        F.array(F.struct(url.alias("source_url"), now.alias("observed_at"), F.col("value").cast("double").alias("value"))).alias("observations"), F.array(F.struct(url.alias("url"), "width", F.lit(2).alias("height"))).alias("images"),
    )
    return _counted(rows, gates.reader_item())


_MEDIA = {
    "k": "doc_id",
    "text": "text",
    "image_url": "CASE doc_id % 6 WHEN 0 THEN 'ftp://img.example.com/a' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE concat('https://img.example.com/', n_chars) END",
    "video_url": "CASE WHEN doc_id % 9 = 0 THEN 'https://localhost/v' ELSE NULL END",
    "poster_url": "CASE WHEN doc_id % 8 = 0 THEN 'no url' ELSE 'https://img.example.com/p' END",
    "shown": "doc_id % 3 > 0",
    "width": "CAST(n_chars % 7 AS BIGINT)",
    "images_source": "CASE WHEN doc_id % 5 = 0 THEN 'https://other.example.com/' ELSE 'https://a.example.com/' END",
    "late": "CAST(n_chars % 4 AS INT)",
}


@query(
    _twin(
        "documents",
        _MEDIA,
        {
            "original_text": "text IS NULL OR length(text) <= 1000",
            "source_quotes": "2 * least(length(text), 700) <= 1000",
            "image_url": "coalesce(image_url, '') = '' OR starts_with(image_url, 'https://img.example.com/')",
            "video_url": "video_url IS NULL",
            "poster_url": "poster_url <> 'no url'",
            "image_source": "NOT shown OR images_source = 'https://a.example.com/'",
            "image_size": "NOT shown OR width > 0",
            "image_unique": "NOT shown OR width <> 3",
            "images_verified": "NOT shown OR late <= 2",
        },
    )
)
def rolling_media_gate(t):
    """What rolling posts quote and show: lengths of quotations (the documents' own texts), media URLs, body images."""
    last = _now()
    image = lambda url: F.struct(url.alias("url"), F.col("width"), F.lit(3).cast("long").alias("height"))
    second = F.concat(F.lit("https://img.example.com/b"), F.when(F.col("width") == 3, "").otherwise("2"))
    images = F.when(F.col("shown"), F.array(image(F.lit("https://img.example.com/b")), image(second)))
    quote = F.substring("text", 1, 700)
    source = F.struct(F.lit("https://a.example.com/").alias("url"), F.array(quote, quote).alias("quotes"))
    rows = _frame(t, "documents", _MEDIA).select("k", F.col("text").alias("original_text"), F.array(source).alias("sources"), "image_url", "video_url", "poster_url", images.alias("images"), "images_source", (last + F.make_dt_interval(hours=F.col("late") - 2)).alias("images_at"))
    return _counted(rows, gates.rolling_media(last))


_DATED = {
    "k": "event_id",
    "ts": "ts",
    "dated": "event_id % 2 = 0",
    "zone": "CASE WHEN event_id % 7 = 0 THEN 'UTC' WHEN event_id % 11 = 0 THEN NULL ELSE 'Asia/Seoul' END",
    "broken": "event_id % 13 = 0",
    "backed": "event_id % 5 <> 0",
    "note": "CASE WHEN event_id % 3 = 0 THEN 'older' ELSE NULL END",
}
_START = "CASE WHEN dated THEN CASE WHEN broken THEN NULL ELSE date_trunc('day', ts) END ELSE ts END"


@query(
    _twin(
        "events",
        _DATED,
        {
            "time_backed": "dated OR backed",
            "date_given": "NOT dated OR NOT broken",
            "date_zone": "NOT dated OR zone = 'Asia/Seoul'",
            "date_backed": "NOT dated OR (backed AND zone = 'Asia/Seoul')",
            "date_over": "NOT dated OR (NOT broken AND date_trunc('day', ts) + INTERVAL 1 DAY <= TIMESTAMP '2024-01-15 21:00:00')",
            "not_ahead": f"{_START} <= TIMESTAMP '2024-01-15 21:00:00'",
            "not_old": f"{_START} >= TIMESTAMP '2024-01-12 21:00:00'",
            "older_labelled": f"coalesce({_START} >= TIMESTAMP '2024-01-15 00:00:00', false) OR note IS NOT NULL",
        },
    )
)
def dated_story_gate(t):
    """Stories with a time or only a date: backed by a source, over by the cut-off, at most three days old, labelled if older than the day."""
    day = F.when(F.col("broken"), F.lit("2024-02-30")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    null = F.lit(None)
    own = F.struct(F.when(F.col("backed"), F.col("ts")).alias("published_at"), F.when(F.col("backed"), day).otherwise("2020-01-01").alias("published_date"), F.col("zone").alias("published_zone"))
    rows = _frame(t, "events", _DATED).select("k", F.when(~F.col("dated"), F.col("ts")).alias("published_at"), F.when(F.col("dated"), day).alias("published_date"), F.when(F.col("dated"), F.col("zone")).alias("published_zone"), F.array(own).alias("sources"), F.coalesce("note", null).alias("fallback_note"))
    return _counted(rows, gates.story_dates(F.expr("TIMESTAMP_NTZ'2024-01-15 21:00:00'")))


_ANNOUNCED = {
    "k": "event_id",
    "ts": "ts",
    "half": "CASE WHEN event_id % 2 = 0 THEN 'am' ELSE 'pm' END",
    "title": "CASE WHEN event_id % 9 = 0 THEN '  ' ELSE event_type END",
    "timed": "event_id % 4 <> 0",
    "note": "CASE WHEN event_id % 8 = 0 THEN 'evening' ELSE NULL END",
    "url": "CASE WHEN event_id % 6 = 0 THEN 'https://me@example.com/' ELSE 'https://example.com/e' END",
    "early": "CAST(event_id % 5 AS INT)",
    "word": "CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END",
}
_TARGET = "(CASE WHEN half = 'am' THEN DATE '2024-01-15' ELSE DATE '2024-01-16' END)"
_OPENS = "(CASE WHEN half = 'am' THEN TIMESTAMP '2024-01-15 09:00:00' ELSE TIMESTAMP '2024-01-15 21:00:00' END)"


@query(
    _twin(
        "events",
        _ANNOUNCED,
        {
            "event_date": f"CAST(ts AS DATE) = {_TARGET}",
            "event_texts": "trim(title) <> ''",
            "event_ahead": f"NOT timed OR (ts > {_OPENS} AND CAST(ts AS DATE) = {_TARGET})",
            "event_time_known": "timed OR note IS NOT NULL",
            "event_source": "url = 'https://example.com/e' AND early <= 3",
            "keywords": "word <> ''",
        },
    )
)
def announced_event_gate(t):
    """Events that an edition announces, and its keywords: on the day that it is for, still ahead, from a source checked in time."""
    stamp = lambda s: F.expr(f"TIMESTAMP_NTZ'{s}'")
    scheduled = F.when(F.col("half") == "am", stamp("2024-01-15 09:00:00")).otherwise(stamp("2024-01-15 21:00:00"))
    made = scheduled + F.expr("INTERVAL 3 HOURS")
    source = F.struct("url", scheduled.alias("published_at"), (made - F.make_dt_interval(hours="early")).alias("verified_at"))
    rows = _frame(t, "events", _ANNOUNCED).select("k", "half", F.date_format("ts", "yyyy-MM-dd").alias("date"), "title", F.lit("detail").alias("detail"), F.when(F.col("timed"), F.col("ts")).alias("event_at"), F.col("note").alias("time_note"), source.alias("source"), F.array("word").alias("keywords"))
    return _counted(rows, gates.edition_event(F.lit("2024-01-15").cast("date"), F.col("half"), scheduled, made, scheduled) | gates.keywords())
