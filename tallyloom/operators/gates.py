"""Publication gates as tables of rules over typed rows, for :mod:`tallyloom.operators.rules`.

Each function returns ``{rule name: condition}`` for rows of the shape named in its
docstring; a row passes a gate if it breaks no rule, and an unknown condition is broken.
Clocks and cut-offs are arguments. Nested lists are checked in place, so a gate is one
map over its rows; rules between rows (unique ids, unique URLs of a batch) are aggregates
of :func:`rules.group_violations`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions import text, times, urls
from tallyloom.operators import ordering

# The states, kinds and names that gates accept.
CHANNELS = ("community", "topics", "news")
CHECK_STATES = ("ok", "empty", "blocked", "failed", "partial")
ROLLING_STATES = ("ok", "empty", "partial", "blocked", "challenge", "failed", "stopped")
FAILED_STATES = ("blocked", "challenge", "failed", "stopped")
FACT_STATES = ("확정", "예정", "검토", "보도", "주장", "분석")
STAGES_AHEAD = ("예정", "검토")
STAGES_OF_CORRECTION = ("정정", "철회")
PLATFORMS = ("aagag", "community", "dcinside", "instagram", "x", "other")
REGIONS = ("KR", "unknown")
PLACEMENTS = ("lead", "additional")
PORTALS = ("instagram.com", "www.instagram.com", "x.com", "twitter.com")
PROOFS = ("aagag-otime", "aagag-explicit-publication")
PHASES = ("ready", "running", "paused_requires_review", "evidence_missing", "terminal")
OUTCOMES = ("checkpointed", "queue_exhausted", "title_review_required", "paused", "failed", "evidence_missing")
KINDS = ("topic", "community")
RANKING_URL = "https://github.com/trending?since=daily"
LIMIT_WORDS = 25
SAFE_INTEGER = (1 << 53) - 1
LEAD_RULE_CHANGED = "2026-10-19-pm"

Rules = dict[str, Column]


# The longest quotation of a page.
QUOTED_CHARACTERS = 1000


def given(c: Column) -> Column:
    """Text that isn't blank."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def every(items: Column, rule: Callable[[Column], Column]) -> Column:
    """All elements obey; none at all do too. An unknown answer is no."""
    return F.forall(items, lambda x: F.coalesce(rule(x), F.lit(False)))


def distinct(items: Column) -> Column:
    # The items are made once for both sizes.
    return F.get(F.transform(F.array(items), lambda x: F.size(F.array_distinct(x)) == F.size(x)), F.lit(0))


def within_words(texts: Column, most: int = LIMIT_WORDS) -> Column:
    return F.aggregate(texts, F.lit(0), lambda n, t: n + text.word_count(F.coalesce(t, F.lit("")))) <= most


def count_or_unknown(c: Column) -> Column:
    return c.isNull() | c.between(0, SAFE_INTEGER)


def check_record(now: Column, states: tuple[str, ...] = CHECK_STATES) -> Rules:
    """A collection check: id, channel, status, count, checked_at, source, note. Zero, unknown and failure differ."""
    status, n = F.col("status"), F.col("count")
    return {
        "id": text.is_slug(F.col("id")),
        "channel": F.col("channel").isin(*CHANNELS),
        "status": status.isin(*states),
        "time": F.col("checked_at") <= now,
        "source": text.present(F.col("source"), 200),
        "note": text.present(F.col("note")),
        "count": count_or_unknown(n),
        "empty_is_zero": (status != "empty") | n.eqNullSafe(0),
        "failure_is_unknown": ~status.isin(*FAILED_STATES) | n.isNull(),
    }


def source_list(sources: Column, verified_by: Column) -> Rules:
    """``sources``: array of (url, name, title, limitations, platform, region, region_url, verified_at, published_at, period_start, period_end, quotes)."""
    key = F.transform(sources, lambda s: urls.canonical_sorted(s["url"]))
    return {
        "sources": F.size(sources) > 0,
        "source_url": every(sources, lambda s: urls.is_public(s["url"])),
        "source_unique": distinct(key),
        "source_text": every(sources, lambda s: text.present(s["name"], 120) & text.present(s["title"], 300) & text.present(s["limitations"])),
        "source_verified": every(sources, lambda s: s["verified_at"] <= verified_by),
        "source_published": every(sources, lambda s: s["published_at"].isNull() | (s["published_at"] <= s["verified_at"])),
        "source_platform": every(sources, lambda s: s["platform"].isin(*PLATFORMS)),
        "source_region": every(sources, lambda s: F.when(s["region"] == "KR", urls.is_public(s["region_url"])).otherwise((s["region"] == "unknown") & s["region_url"].isNull())),
        "source_auxiliary": every(sources, lambda s: (s["platform"] != "instagram") | (s["region"] == "unknown")),
        "source_period": every(sources, lambda s: F.when(s["period_start"].isNull(), s["period_end"].isNull()).otherwise((s["period_start"] < s["period_end"]) & (s["period_end"] <= s["verified_at"]))),
        "source_words": every(sources, lambda s: within_words(F.concat(F.array(s["title"]), F.coalesce(s["quotes"], F.array().cast("array<string>"))))),
    }


def live_item(now: Column) -> Rules:
    """A revisioned item: id, kind, topic_key, title, summary, limitations, reason, safety_checked, rights_checked, first_at, last_at,
    expected_revision, canonical_url, sources, observations (source_url, observed_at, metric, unit, scope, value), content_id, content_title."""
    key = F.transform("sources", lambda s: urls.canonical_sorted(s["url"]))
    community, c = F.col("kind") == "community", F.col("canonical_url")
    o = F.col("observations")
    return {
        "id": text.is_slug(F.col("id")),
        "kind": F.col("kind").isin(*KINDS),
        "topic": text.present(F.col("topic_key"), 200),
        "title": text.present(F.col("title"), 300),
        "summary": F.when(community, F.col("summary") == "").otherwise(text.present(F.col("summary"))),
        "reasons": text.present(F.col("limitations")) & text.present(F.col("reason")),
        "reviewed": F.col("safety_checked") & F.col("rights_checked"),
        "times": (F.col("first_at") <= F.col("last_at")) & (F.col("last_at") <= now),
        "revision": F.col("expected_revision") >= 0,
        "canonical_is_source": c.isNull() | F.array_contains(key, urls.canonical_sorted(c)),
        "tags": every(F.concat(F.array("title"), F.transform("sources", lambda s: s["title"])), lambda t: ~text.has_tag(t)),
        "observed": every(o, lambda x: F.array_contains(key, urls.canonical_sorted(x["source_url"])) & x["observed_at"].between(F.col("first_at"), F.col("last_at"))),
        "metric": every(o, lambda x: text.present(x["metric"], 600) & text.present(x["unit"], 600) & text.present(x["scope"], 600)),
        "value": every(o, lambda x: x["value"].isNull() | ((x["value"] >= 0) & ~F.isnan(x["value"]) & (x["value"] < float("inf")))),
        "content": F.when(community, (F.col("content_id") == F.col("id")) & (F.col("content_title") == F.col("title")) & (F.regexp_replace(urls.host(c), "^www[.]", "") == "aagag.com")).otherwise(F.col("content_id").isNull()),
        **source_list(F.col("sources"), F.col("last_at")),
    }


def rolling_item(now: Column, least: int = 10) -> Rules:
    """A rolling post: id, canonical_url, expected_revision, published_at, first_at, last_at, proof (method, source_url, value, raw, observed_at, verified),
    comments (source_url, observed_at, reported, rows of (id, n)), review (safety, rights, verified_at, note), title, limitations,
    sources (url, name, title, verified_at, published_at, quotes), content (original_text, quotes of (id, text), portal_links, signals)."""
    first, last, published = F.col("first_at"), F.col("last_at"), F.col("published_at")
    proof, native, review, content = F.col("proof"), F.col("comments"), F.col("review"), F.col("content")
    rows = native["rows"]
    none = F.array().cast("array<string>")
    quoted = F.coalesce(F.transform(content["quotes"], lambda q: q["text"]), none)
    original = F.array(F.coalesce(content["original_text"], F.lit("")))
    own = F.filter("sources", lambda s: s["url"] == F.col("canonical_url"))
    own_texts = F.flatten(F.transform(own, lambda s: F.concat(F.array(s["title"]), F.coalesce(s["quotes"], none))))
    return {
        "id": F.col("id") == urls.post_identity(F.col("canonical_url")),
        "revision": F.col("expected_revision") >= 0,
        "times": (published <= first) & (first <= last) & (last <= now),
        "fresh": times.fresh(published, now),
        "proof": proof["verified"] & proof["method"].isin(*PROOFS) & (urls.post_identity(proof["source_url"]) == F.col("id")) & (proof["value"] == published),
        "proof_time": proof["observed_at"].between(published, last) & text.present(proof["raw"], 500),
        "proof_epoch": (proof["method"] != "aagag-otime") | (F.abs(F.try_to_number(F.regexp_extract(proof["raw"], r"^(\d+)(?:\.\d+)?$", 1), F.lit("999999999999")) - F.unix_timestamp(published)) < 1),
        "comments_of_post": (urls.post_identity(native["source_url"]) == F.col("id")) & native["observed_at"].between(first, last),
        "comments_total": (native["reported"] == F.size(F.array_distinct(F.transform(rows, lambda r: r["id"])))) & (F.size(F.array_distinct(rows)) == native["reported"]),
        "threshold": F.aggregate(F.array_distinct(rows), F.lit(0).cast("long"), lambda n, r: n + r["n"]) >= least,
        "reviewed": review["safety"] & review["rights"] & review["verified_at"].between(first, last) & text.present(review["note"]),
        "texts": text.present(F.col("title"), 300) & text.present(F.col("limitations")),
        "sources": (F.size("sources") > 0) & (F.size(own) == 1),
        "source_unique": distinct(F.transform("sources", lambda s: s["url"])),
        "source_text": every(F.col("sources"), lambda s: urls.is_public(s["url"]) & text.present(s["name"], 120) & text.present(s["title"], 300)),
        "source_times": every(F.col("sources"), lambda s: (s["verified_at"] <= last) & (s["published_at"].isNull() | (s["published_at"] <= s["verified_at"]))),
        "source_words": every(F.col("sources"), lambda s: within_words(F.concat(F.array(s["title"]), F.coalesce(s["quotes"], none)))),
        "safety": every(F.concat(F.array("title"), F.transform("sources", lambda s: s["title"]), original), lambda t: ~text.is_unsafe(F.regexp_replace(t, "​", ""))),
        "quotes": distinct(F.coalesce(F.transform(content["quotes"], lambda q: q["id"]), none)) & every(quoted, lambda t: F.length(t) <= 500),
        "quoted_words": within_words(F.concat(F.array("title"), original, quoted)),
        "page_words": text.quoted_words(F.concat(F.array("title"), own_texts, original, quoted)) <= LIMIT_WORDS,
        "signals": F.coalesce(F.size(content["signals"]) <= 0, F.lit(True)),
        "portals": every(F.coalesce(content["portal_links"], none), lambda u: urls.is_public(u) & urls.host(u).isin(*PORTALS)),
    }


def rolling_media(last: Column) -> Rules:
    """What a rolling post quotes and shows: original_text, sources (url, quotes), image_url, video_url, poster_url, images (url, width, height; null: none),
    images_source, images_at. Lengths count characters; a media URL may be null or empty."""
    none = F.array().cast("array<string>")
    size = lambda texts: F.aggregate(F.coalesce(texts, none), F.lit(0), lambda n, q: n + F.length(q))
    optional = lambda c: F.coalesce(F.col(c) == "", F.lit(True)) | urls.is_public(F.col(c))
    shown = F.col("images").isNotNull()
    return {
        "original_text": F.coalesce(F.length("original_text"), F.lit(0)) <= QUOTED_CHARACTERS,
        "source_quotes": every(F.col("sources"), lambda s: size(s["quotes"]) <= QUOTED_CHARACTERS),
        "image_url": optional("image_url"),
        "video_url": optional("video_url"),
        "poster_url": optional("poster_url"),
        **{name: ~shown | F.coalesce(rule, F.lit(False)) for name, rule in body_images(F.col("images"), F.col("images_source"), F.transform("sources", lambda s: s["url"])).items()},
        "images_verified": ~shown | (F.col("images_at") <= last),
    }


def story_dates(cutoff: Column) -> Rules:
    """When a story was published: published_at, or else published_date (text) and published_zone; sources (published_at, published_date, published_zone), fallback_note.

    A date alone counts from its start where age is judged, and must be over by the cut-off."""
    at, day, zone = F.col("published_at"), times.real_date(F.col("published_date")), F.col("published_zone")
    start = F.coalesce(at, day.cast("timestamp_ntz"))
    backed = lambda s: F.coalesce(s["published_at"] == at, F.lit(False))
    dated = lambda s: F.coalesce((s["published_date"] == F.col("published_date")) & (s["published_zone"] == times.ZONE), F.lit(False))
    only = at.isNull()
    return {
        "time_backed": only | F.exists("sources", backed),
        "date_given": ~only | day.isNotNull(),
        "date_zone": ~only | (zone == times.ZONE),
        "date_backed": ~only | F.exists("sources", dated),
        "date_over": ~only | times.date_wholly_before(day, cutoff),
        "not_ahead": start <= cutoff,
        "not_old": start >= cutoff - F.expr("INTERVAL 72 HOURS"),
        "older_labelled": (F.to_date(start) >= F.to_date(cutoff)) | given(F.col("fallback_note")),
    }


def edition_event(day: Column, half: Column, scheduled: Column, generated: Column, cutoff: Column) -> Rules:
    """An event that an edition announces: date (text), title, detail, event_at, time_note, source (url, published_at, verified_at). A morning's events are
    that day's, an evening's the next day's."""
    target = F.when(half == "am", day).otherwise(F.date_add(day, 1))
    at, source = F.col("event_at"), F.col("source")
    return {
        "event_date": times.real_date(F.col("date")) == target,
        "event_texts": given(F.col("title")) & given(F.col("detail")),
        "event_ahead": at.isNull() | ((at > scheduled) & (F.to_date(at) == target)),
        "event_time_known": at.isNotNull() | given(F.col("time_note")),
        "event_source": urls.canonical_ordered(source["url"]).isNotNull() & times.verified_in_time(source["verified_at"], source["published_at"], generated, cutoff, single_run=True),
    }


def keywords() -> Rules:
    """An edition's keywords, if it has any: texts that aren't empty."""
    return {"keywords": F.col("keywords").isNull() | every(F.col("keywords"), lambda k: k != "")}


def body_images(images: Column, source_url: Column, sources: Column) -> Rules:
    """``images``: array of (url, width, height); ``sources``: the verified URLs."""
    return {
        "image_source": F.array_contains(sources, source_url),
        "image_host": every(images, lambda i: urls.is_public(i["url"])),
        "image_size": every(images, lambda i: i["width"].between(1, SAFE_INTEGER) & i["height"].between(1, SAFE_INTEGER)),
        "image_unique": distinct(F.transform(images, lambda i: urls.image_key(i["url"]))),
    }


def timeline_entry(cutoff: Column) -> Rules:
    """A story's timeline: issue_id, issue_title, stage, change, event_date, event_end, event_zone, event_at (instant), known_title (of the issue so far,
    null if new), correction_of, correction_found, follow_up, follow_up_targets, follow_up_same_issue."""
    start, zone = F.col("event_date"), F.col("event_zone")
    end = F.coalesce("event_end", "event_date")
    known = start.isNotNull()
    local = lambda t: F.to_date(F.from_utc_timestamp(t, zone))
    return {
        "issue": text.is_slug(F.col("issue_id")) & given(F.col("issue_title")),
        "change": F.length(F.trim("change")) >= 15,
        "unknown_stays_unknown": known | (F.col("event_end").isNull() & zone.isNull() & F.col("event_at").isNull()),
        "zone": ~known | given(zone),
        "order": ~known | (end >= start),
        "not_ahead": ~known | F.col("stage").isin(*STAGES_AHEAD) | (end <= local(cutoff)),
        "event_time": ~known | F.col("event_at").isNull() | local(F.col("event_at")).between(start, end),
        "issue_title_kept": F.col("known_title").isNull() | (F.col("known_title") == F.col("issue_title")),
        "correction": F.when(F.col("stage").isin(*STAGES_OF_CORRECTION), F.col("correction_found")).otherwise(F.col("correction_of").isNull()),
        "follow_up": F.col("follow_up").isNull() | ((F.col("follow_up_targets") == 1) & F.coalesce(F.col("follow_up_same_issue"), F.lit(True))),
    }


def edition(now: Column) -> Rules:
    """An edition's head: id, date, edition, zone, version, cutoff_at, generated_at, updated_at, intro, overview, emphasis, n_stories, n_story_ids, n_events."""
    cutoff, made = F.col("cutoff_at"), F.col("generated_at")
    day = times.real_date(F.col("date"))
    return {
        "head": (F.col("version") == 1) & (F.col("zone") == times.ZONE) & F.col("edition").isin("am", "pm"),
        "id": F.col("id") == F.concat_ws("-", "date", "edition"),
        "cutoff": cutoff == times.cutoff_time(day, F.col("edition")),
        "generated": made.between(cutoff, now),
        "updated": F.coalesce(F.col("updated_at"), made).between(made, now),
        "intro": given(F.col("intro")),
        "overview": F.size("overview").between(2, 4) & every(F.col("overview"), lambda p: F.length(F.trim(p)) >= 15),
        "emphasis": F.col("emphasis").isNull() | text.phrases_occur(F.col("emphasis"), F.col("overview"), 1, 12),
        "stories": (F.col("n_stories") > 0) & (F.col("n_stories") == F.col("n_story_ids")),
        "events": F.coalesce("n_events", F.lit(0)) <= 6,
    }


def edition_story(cutoff: Column, generated: Column) -> Rules:
    """A story of an edition: edition_id, id, topic_key, category, title, status, event_note, changed, matters, uncertainty, summary, emphasis, facts (map),
    sources and related (url, language, published_at, verified_at), published_at, fallback_note, scores (importance, domestic, reliability, interest, recency),
    score_reason, placement, alternatives (rank, title, name, url), own_url, n_matches, delta, same_words, same_facts, newer_source."""
    day = lambda t: F.to_date(t)
    published, scores, others = F.col("published_at"), F.col("scores"), F.col("alternatives")
    high = lambda c, n: scores[c] >= n
    total = ordering.score({k: scores[k] for k in ordering.WEIGHTS})
    follows = (F.col("n_matches") > 0) | F.col("delta").isNotNull()
    in_time = lambda s: times.verified_in_time(s["verified_at"], s["published_at"], generated, cutoff, single_run=True)
    return {
        "id": text.is_slug(F.col("id")),
        "texts": given(F.col("topic_key")) & given(F.col("category")) & given(F.col("title")) & given(F.col("event_note")) & given(F.col("changed")) & given(F.col("matters")) & given(F.col("uncertainty")),
        "status": F.col("status").isin(*FACT_STATES),
        "summary": F.size("summary").between(2, 6) & every(F.col("summary"), lambda p: F.length(F.trim(p)) >= 15),
        "emphasis": text.phrases_occur(F.col("emphasis"), F.col("summary"), 1, 6),
        "facts": (F.size("facts") >= 2) & every(F.map_values("facts"), lambda v: v != ""),
        "sources": (F.size("sources") > 0) & F.exists("sources", lambda s: s["language"] == "ko"),
        "sources_in_time": every(F.concat("sources", "related"), in_time),
        "related": F.size("related").between(1, 3) & distinct(F.transform("related", lambda s: urls.canonical_ordered(s["url"]))),
        "backed": F.exists("sources", lambda s: F.coalesce(s["published_at"] == published, F.lit(False))),
        "age": published.between(cutoff - F.expr("INTERVAL 72 HOURS"), cutoff),
        "older_labelled": (day(published) >= day(cutoff)) | given(F.col("fallback_note")),
        "follow_up": ~follows | (F.length(F.trim("delta")) >= 15),
        "follow_up_is_new": ~follows | (~F.col("same_words") & ~F.col("same_facts") & F.col("newer_source")),
        "scores": every(F.array(*(scores[k] for k in ordering.WEIGHTS)), lambda v: v.between(0, 100)) & given(F.col("score_reason")),
        "alternatives": (F.size(others) <= 2) & every(others, lambda a: a["rank"].isin(2, 3) & given(a["title"]) & given(a["name"]) & urls.is_safe(a["url"]) & ~a["url"].eqNullSafe(F.col("own_url"))),
        "alternatives_unique": distinct(F.transform(others, lambda a: a["rank"])) & distinct(F.transform(others, lambda a: a["url"])),
        "placement": F.col("placement").isNull() | F.col("placement").isin(*PLACEMENTS),
        "lead": ~F.coalesce(F.col("placement") == "lead", F.lit(False)) | (high("reliability", 70) & ((F.col("edition_id") >= LEAD_RULE_CHANGED) | (high("importance", 70) & (total >= 65)))),
    }


def community_edition() -> Rules:
    """A community edition's head: id, date, edition, zone, version, cutoff_at, generated_at, overview, n_stories, n_story_ids."""
    return {
        "head": F.col("version").isin(1, 2) & (F.col("zone") == times.ZONE) & F.col("edition").isin("am", "pm") & times.real_date(F.col("date")).isNotNull(),
        "id": F.col("id") == F.concat_ws("-", "date", "edition"),
        "cutoff": F.col("cutoff_at") == times.deadline(F.col("id")),
        "generated": F.col("generated_at") >= F.col("cutoff_at"),
        "overview": F.when(F.col("version") == 2, F.size("overview") == 0).otherwise(F.size("overview").between(1, 4) & every(F.col("overview"), given)),
        "stories": F.col("n_stories").between(3, 20) & (F.col("n_stories") == F.col("n_story_ids")),
    }


def community_story(cutoff: Column, generated: Column, categories: tuple[str, ...], humour: str, least: int = 11) -> Rules:
    """A story of a community edition (version 2): category, topic_key, title, reason, popularity, verification, k_count, n_comments, comments_at, quotes (id, text),
    original_text, signals, sources (url, name, title, verified_at, published_at), portal_links, breakdown (name, count)."""
    none = F.array().cast("array<string>")
    quotes = F.coalesce(F.transform("quotes", lambda q: q["text"]), none)
    return {
        "category": F.col("category").isin(*categories),
        "texts": given(F.col("topic_key")) & given(F.col("title")) & given(F.col("reason")) & given(F.col("popularity")) & given(F.col("verification")),
        "tags": every(F.concat(F.array("title"), F.transform("sources", lambda s: s["title"])), lambda t: ~text.has_tag(t)),
        "signals": F.coalesce(F.size("signals") <= 0, F.lit(True)),
        "threshold": (F.col("category") != humour) | (F.col("k_count") >= least),
        "counts": F.col("k_count").between(0, SAFE_INTEGER) & F.col("n_comments").between(0, SAFE_INTEGER) & (F.col("comments_at") <= generated),
        "quotes": distinct(F.coalesce(F.transform("quotes", lambda q: q["id"]), none)) & every(quotes, given),
        "words": within_words(F.concat(F.array("title", F.coalesce("original_text", F.lit(""))), quotes)),
        "sources": (F.size("sources") > 0) & every(F.col("sources"), lambda s: urls.is_public(s["url"]) & given(s["name"]) & given(s["title"]) & (s["verified_at"] <= generated)),
        "source_age": every(F.col("sources"), lambda s: s["published_at"].isNull() | times.age_between(s["published_at"], cutoff)),
        "portals": every(F.coalesce("portal_links", none), lambda u: urls.is_public(u) & urls.host(u).rlike(r"(^|\.)(instagram|x|twitter)\.com$")),
        "breakdown": F.col("breakdown").isNull() | ((F.size("breakdown") > 0) & distinct(F.transform("breakdown", lambda b: b["name"])) & every(F.col("breakdown"), lambda b: given(b["name"]) & (b["count"] > 0))),
    }


def ranking_item() -> Rules:
    """A place of a reviewed ranking: rank, place, repo, analysis_repo, image_repo, review_repo, stars, facts_checked, image_checked, notes, title, summary,
    use_case, requirements, explanation, emphasis, sources (label, url), image_file, image_sha256, image_digest, alt, caption, image_url."""
    repo = F.col("repo")
    return {
        "repo": repo.rlike(r"^[\w.-]+/[\w.-]+$"),
        "order": (F.col("rank") == F.col("place")) & (F.col("analysis_repo") == repo) & (F.col("image_repo") == repo) & (F.col("review_repo") == repo),
        "stars": F.col("stars").between(0, SAFE_INTEGER),
        "reviewed": F.col("facts_checked") & F.col("image_checked") & given(F.col("notes")),
        "texts": given(F.col("title")) & given(F.col("summary")) & given(F.col("use_case")) & given(F.col("requirements")),
        "emphasis": (F.size("emphasis") <= 3) & every(F.col("emphasis"), lambda p: given(p) & (F.contains(F.col("summary"), p) | F.contains(F.col("requirements"), p))),
        "explanation": (F.size("explanation") > 0) & every(F.col("explanation"), given),
        "sources": (F.size("sources") > 0) & every(F.col("sources"), lambda s: given(s["label"]) & s["url"].startswith("https://")),
        "image": F.col("image_file").rlike(r"^[\w-]+\.(png|jpg|webp)$") & (F.col("image_sha256") == F.col("image_digest")),
        "credit": given(F.col("alt")) & given(F.col("caption")) & F.col("image_url").startswith("https://"),
    }


def ranking_edition() -> Rules:
    """A ranking's head: date, analysis_date, review_date, url, period, language, captured_at (instant), approved, complete, intro, digests and reviewed (maps of
    part to SHA-256), n_items, n_repos, n_reviews."""
    day = times.real_date(F.col("date"))
    return {
        "dates": day.isNotNull() & (F.col("analysis_date") == F.col("date")) & (F.col("review_date") == F.col("date")) & (F.to_date(times.korean(F.col("captured_at"))) == day),
        "scope": (F.col("url") == RANKING_URL) & (F.col("period") == "daily") & (F.col("language") == "all"),
        "approved": F.col("approved") & F.col("complete"),
        "unchanged": (F.size("digests") > 0) & every(F.map_entries("digests"), lambda e: F.col("reviewed")[e["key"]] == e["value"]),
        "intro": given(F.col("intro")),
        "ten": (F.col("n_items") == 10) & (F.col("n_repos") == 10) & (F.col("n_reviews") == 10),
    }


def handoff(now: Column) -> Rules:
    """A reviewed handoff: edition, cutoff_at, operation_id, review_edition, approved, payload, payload_sha256, history, history_sha256, completed_at, verified_at,
    checks (array of boolean), sources (accessible, supported), cited (URLs), reviewed_urls."""
    return {
        "cutoff": F.col("cutoff_at") == times.deadline(F.col("edition")),
        "operation": F.col("operation_id") == F.concat(F.lit("publish-news-"), "edition"),
        "approved": (F.col("review_edition") == F.col("edition")) & F.col("approved"),
        "payload": F.col("payload_sha256") == F.sha2("payload", 256),
        "history": F.col("history_sha256") == F.sha2("history", 256),
        "times": (F.col("completed_at") <= now) & (F.col("verified_at") <= now),
        "checks": (F.size("checks") == 4) & every(F.col("checks"), lambda c: c),
        "sources": (F.size("sources") > 0) & every(F.col("sources"), lambda s: s["accessible"] & s["supported"]),
        "cited": F.size(F.array_except("cited", "reviewed_urls")) == 0,
    }


def projection() -> Rules:
    """A remote state's projection: run_key, source_sha256, evidence_sha256, window_start, window_end, checkpoint_at, revision, progress (array of counts),
    coverage (array of boolean), phase, lease_owner, lease_until, outcome, fields (names found), known (names allowed)."""
    digest = lambda c: F.col(c).rlike("^[a-f0-9]{64}$")
    leased = F.col("lease_owner").isNotNull()
    return {
        "fields": (F.size(F.array_except("fields", "known")) == 0) & (F.size(F.array_except("known", "fields")) == 0),
        "digests": digest("run_key") & digest("source_sha256") & digest("evidence_sha256"),
        "window": F.col("window_start") < F.col("window_end"),
        "checkpoint": F.col("checkpoint_at").isNotNull(),
        "revision": F.col("revision") >= 0,
        "progress": F.forall("progress", count_or_unknown),
        "coverage": every(F.col("coverage"), lambda c: c.isNotNull()),
        "phase": F.col("phase").isin(*PHASES) & ((F.col("phase") == "running") == leased),
        "lease": ~leased | (F.col("lease_owner").rlike(r"^[A-Za-z0-9_.-]{1,100}$") & F.col("lease_until").isNotNull()),
        "outcome": F.col("outcome").isNull() | F.col("outcome").isin(*OUTCOMES),
    }


def reader_item() -> Rules:
    """What a reader trusts of a stored item: id, kind, title, first_at, last_at, recorded_at, sources (url, verified_at, region, region_url),
    observations (source_url, observed_at, value), images (url, width, height)."""
    return {
        "item": F.col("id").isNotNull() & F.col("kind").isin(*KINDS) & F.col("title").isNotNull(),
        "times": F.col("first_at").isNotNull() & F.col("last_at").isNotNull() & F.col("recorded_at").isNotNull(),
        "sources": (F.size("sources") > 0) & every(F.col("sources"), lambda s: urls.is_public(s["url"]) & s["verified_at"].isNotNull() & s["region"].isin(*REGIONS) & (s["region_url"].isNull() | urls.is_public(s["region_url"]))),
        "observations": every(F.col("observations"), lambda o: urls.is_public(o["source_url"]) & o["observed_at"].isNotNull() & (o["value"].isNull() | ~F.isnan(o["value"]))),
        "images": F.col("images").isNull() | (every(F.col("images"), lambda i: urls.is_public(i["url"]) & (i["width"] > 0) & (i["height"] > 0)) & distinct(F.transform("images", lambda i: urls.image_key(i["url"])))),
    }
