"""Queries on observed posts and on publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text, times, urls
from tallyloom.operators import counting, observations, ordering, publication, views
from tallyloom.plans.registry import query
from tallyloom.sinks import writers
from tallyloom.sources import readers

_START, _END = "TIMESTAMP '1995-01-01 00:00:00'", "TIMESTAMP '1996-12-31 00:00:00'"


def _ntz(t: str):
    return F.expr(t.replace("TIMESTAMP", "TIMESTAMP_NTZ"))


_POSTS = f"""p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'outside_window' WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'observed' END AS status,
 CASE WHEN o_orderkey % 11 = 0 THEN '비키니 title' WHEN o_orderkey % 13 = 0 THEN 'ㅇㅎ title' ELSE 'title' END AS title, CASE WHEN o_orderkey % 14 <> 0 THEN o_orderdate END AS listed_at, o_orderkey % 17 <> 0 AS rows_given, o_orderkey % 6 <> 0 AS all_selected,
 o_orderkey % 7 AS drift, CASE WHEN o_orderkey % 10 = 0 THEN o_orderdate END AS evidence_at, o_orderkey % 4 <> 0 AS sources_expanded, o_orderkey % 8 AS width FROM orders)"""
_TOTALS = f"""l AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber % 6 = 0 THEN NULL ELSE l_partkey % 5 END AS cid, CASE WHEN l_suppkey % 50 = 0 THEN -1 ELSE l_partkey % 5 + l_linenumber // 7 END AS n, l_shipdate AS tm, l_linenumber * 1000000 + l_partkey AS pos FROM lineitem),
g AS (SELECT id, cid, arg_max(n, (pos, tm, n)) AS n, arg_max(tm, (pos, tm, n)) AS tm, count(*) AS seen, count(DISTINCT (n, tm)) > 1 AS differs FROM l GROUP BY id, cid),
c AS (SELECT id, count(cid) AS n_comments, sum(CASE WHEN cid IS NULL THEN seen ELSE seen - 1 END) AS dup, sum(CASE WHEN cid IS NOT NULL AND differs THEN 1 ELSE 0 END) + sum(CASE WHEN cid IS NULL THEN seen ELSE 0 END) AS conflicts,
 sum(CASE WHEN cid IS NOT NULL AND n < 0 THEN 1 ELSE 0 END) AS invalid, coalesce(sum(CASE WHEN cid IS NOT NULL AND n >= 0 THEN n END), 0) AS k, sum(CASE WHEN cid IS NOT NULL AND tm < {_START} THEN 1 ELSE 0 END) AS n_before,
 sum(CASE WHEN cid IS NOT NULL AND tm BETWEEN {_START} AND {_END} THEN 1 ELSE 0 END) AS n_within, sum(CASE WHEN cid IS NOT NULL AND tm > {_END} THEN 1 ELSE 0 END) AS n_after FROM g GROUP BY id)"""


@query(f"""
WITH {_POSTS}, {_TOTALS},
a AS (SELECT p.*, n_comments, dup, conflicts + CASE WHEN rows_given THEN 0 ELSE 1 END AS conflicts, invalid, n_before, n_within, n_after, CASE WHEN invalid = 0 THEN k END AS k, coalesce(listed_at BETWEEN {_START} AND {_END}, false) AS inside,
 status = 'outside_window' AND listed_at IS NOT NULL AND NOT listed_at BETWEEN {_START} AND {_END} AS outside FROM p JOIN c USING (id)),
b AS (SELECT *, all_selected AND conflicts = 0 AND invalid = 0 AS sound FROM a),
d AS (SELECT *, sound AND drift <> 0 AS complete, sound AND drift <> 0 AND status = 'observed' AS verified, sound AND n_comments > 0 AND (status = 'observed' OR (status = 'failed' AND evidence_at IS NOT NULL)) AS lower FROM b),
e AS (SELECT *, verified OR lower AS trusted, CASE WHEN verified THEN k >= 2 WHEN lower AND k >= 2 THEN true END AS qualified FROM d),
f AS (SELECT *, coalesce(qualified, false) AND inside AND title = 'title' AS candidate, sources_expanded AND drift <> 1 AS sources_ok, width > 0 AS media_ok FROM e)
SELECT id, CAST(CASE WHEN NOT outside AND verified THEN k END AS BIGINT) AS k_count, CAST(CASE WHEN NOT outside AND verified THEN n_comments END AS BIGINT) AS comment_count, CAST(CASE WHEN NOT outside AND trusted THEN k END AS BIGINT) AS known_minimum,
 CAST(CASE WHEN NOT outside THEN n_before END AS BIGINT) AS n_before, CAST(CASE WHEN NOT outside THEN n_within END AS BIGINT) AS n_within, CAST(CASE WHEN NOT outside THEN n_after END AS BIGINT) AS n_after, CAST(dup AS BIGINT) AS duplicate_rows, CAST(conflicts AS BIGINT) AS n_conflicts,
 NOT outside AND complete AS comments_complete, CASE WHEN NOT outside THEN qualified END AS qualified, CASE WHEN NOT outside AND verified THEN 'exact_native_total' WHEN NOT outside AND qualified THEN 'observed_lower_bound' END AS basis, NOT outside AND candidate AS candidate,
 CASE WHEN NOT outside AND candidate AND NOT verified THEN 'native_comment_total_unverified' || CASE WHEN sources_ok THEN '' ELSE ',source_list_unverified' END || CASE WHEN media_ok THEN '' ELSE ',media_metadata_unverified' END ELSE '' END AS hold_reasons,
 outside OR (status = 'observed' AND listed_at IS NOT NULL AND complete AND (NOT coalesce(qualified, false) OR (sources_ok AND media_ok))) AS inspection_complete, CASE WHEN title = 'title' THEN '' WHEN title LIKE 'ㅇㅎ%' THEN 'source_title_nsfw_marker:' || id ELSE 'sexual_title:' END AS exclusions, outside FROM f""")
def normalised_observations(t):
    """Observed posts with proven counts, completeness, candidacy and holds; the threshold is 2 here."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    source = F.struct(F.lit("s").alias("id"), F.lit("source title").alias("title"))
    medium = F.struct(F.lit("image").alias("type"), F.lit("https://example.com/i").alias("url"), F.lit(True).alias("complete"), (k % 8).alias("width"), F.lit(1).alias("height"))
    lines = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("id"), F.when(F.col("l_linenumber") % 6 != 0, F.col("l_partkey") % 5).alias("cid"), F.when(F.col("l_suppkey") % 50 == 0, F.lit(-1)).otherwise(F.col("l_partkey") % 5 + F.floor(F.col("l_linenumber") / 7)).alias("n"),
        F.col("l_shipdate").alias("at"), (F.col("l_linenumber") * F.lit(1000000).cast("long") + F.col("l_partkey")).alias("pos"),
    )
    n = lines.groupBy("id").agg(F.count_distinct("cid").alias("n"))
    posts = t.orders.select(
        k.cast("string").alias("id"), F.concat(F.lit("https://aagag.com/issue/?idx="), k).alias("url"), F.when(k % 9 == 0, "outside_window").when(k % 5 == 0, "failed").otherwise("observed").alias("status"),
        F.when(k % 11 == 0, "비키니 title").when(k % 13 == 0, "ㅇㅎ title").otherwise("title").alias("title"), at.alias("observed_at"), F.when(k % 14 != 0, at).alias("listed_at"), (k % 17 != 0).alias("rows_given"), (k % 6 != 0).alias("all_selected"),
        (k % 7).alias("drift"), F.when(k % 10 == 0, at).alias("evidence_at"), F.array(source).alias("sources"), (k % 4 != 0).alias("sources_expanded"), F.when(k % 7 == 1, 2).otherwise(1).alias("sources_expected"), F.array(medium).alias("media"),
    )
    posts = posts.join(n, "id").withColumn("expected", F.when(F.col("drift") == 0, F.col("n") + 1).otherwise(F.col("n"))).drop("n", "drift")
    out = observations.normalise(posts, lines, _ntz(_START), _ntz(_END), least=2)
    codes = F.array_join(F.transform("exclusions", lambda x: F.concat(x["code"], F.lit(":"), F.coalesce(x["source_id"], F.lit("")))), ",")
    counts = ("k_count", "comment_count", "known_minimum", "n_before", "n_within", "n_after", "duplicate_rows", "n_conflicts")
    return out.select(F.col("id").cast("long").alias("id"), *(F.col(c).cast("long").alias(c) for c in counts), "comments_complete", "qualified", "basis", "candidate", F.array_join("hold_reasons", ",").alias("hold_reasons"), "inspection_complete", codes.alias("exclusions"), "outside")


@query("""
WITH r AS (SELECT o_custkey AS post, o_orderkey AS file, o_orderstatus <> 'O' AS complete, o_orderdate AS tm FROM orders),
b AS (SELECT post, max((CASE WHEN complete THEN 1 ELSE 0 END, tm)) AS best, max(tm) AS latest FROM r GROUP BY post)
SELECT r.post, count(*) AS n_observations, CAST(sum(CASE WHEN tm > b.best[2] AND NOT complete THEN 1 ELSE 0 END) AS BIGINT) AS n_newer_incomplete, b.best[1] = 1 AS complete, CAST(CAST(b.latest AS DATE) AS VARCHAR) AS latest_at FROM r JOIN b USING (post) GROUP BY r.post, b.best, b.latest""")
def selected_observations(t):
    """Aliases of a post as one row: the best observation, and what came after it."""
    raw = t.orders.select(F.col("o_custkey").alias("post"), F.col("o_orderkey").alias("file"), (F.col("o_orderstatus") != "O").alias("complete"), F.col("o_orderdate").alias("at"))
    out = publication.refreshed(raw, "post", "complete", "at", lambda df: df)
    return out.select("post", "n_observations", "n_newer_incomplete", "complete", F.date_format("latest_at", "yyyy-MM-dd").alias("latest_at"))


@query("""
WITH p AS (SELECT c_custkey AS k, c_custkey % 10 AS r, c_nationkey AS n FROM customer)
SELECT k, CASE WHEN r NOT IN (1, 2) THEN 'https://aagag.com/issue/?idx=' || CASE WHEN r = 0 THEN k + 1 ELSE k END END IS NOT NULL AND r <> 0 AS own, r > 2 AND n % 3 = 0 AND n % 5 <> 0 AND n > 0 AS held,
 CASE WHEN r < 5 THEN 'own' WHEN n % 2 = 0 THEN 'row' END AS field_time,
 CASE WHEN n % 7 = 0 THEN 'held:h' WHEN n % 5 = 0 THEN 'excluded:e' WHEN r = 0 THEN 'failed:f' WHEN n % 3 = 0 THEN 'incomplete:i' ELSE '' END AS state FROM p""")
def observation_states(t):
    """Own URLs, open membership, field times, and one state a row."""
    k, r, n = F.col("c_custkey"), F.col("c_custkey") % 10, F.col("c_nationkey")
    url = F.concat(F.when(r == 1, "https://example.com/issue/?idx=").when(r == 2, "https://aagag.com/list/?idx=").otherwise("https://www.aagag.com/issue/?idx="), F.when(r == 0, k + 1).otherwise(k))
    post = F.concat(F.lit("aagag-"), k)
    age = F.when(n % 5 == 0, F.lit("yesterday")).otherwise(F.concat(n.cast("string"), F.lit("시간 전")))
    evidence = F.struct(post.alias("id"), n.alias("page"), F.when(n % 3 == 0, "initial").otherwise("resweep").alias("phase"), F.lit("2026-10-12").alias("observed_at"), age.alias("age"), url.alias("url"))
    held = observations.temporal_hold(F.lit(True), F.lit(observations.HOLD_REASON), F.lit(None).cast("boolean"), post, evidence)
    rows = t.customer.select(k.alias("k"), observations.own_url(url, post).isNotNull().alias("own"), held.isNotNull().alias("held"), observations.field_time(r < 5, F.lit("own"), n % 2 == 0, F.lit("row")).alias("field_time"), r.alias("r"), n.alias("n"))
    why = F.lit
    states = observations.status_rows(rows, "k", {"held": (F.col("n") % 7 == 0, why("h")), "excluded": (F.col("n") % 5 == 0, why("e")), "failed": (F.col("r") == 0, why("f")), "incomplete": (F.col("n") % 3 == 0, why("i"))})
    out = rows.join(states, "k", "left")
    return out.select("k", "own", "held", "field_time", F.coalesce(F.concat_ws(":", F.col("status"), F.col("reason")), F.lit("")).alias("state"))


@query("""
WITH m AS (SELECT o_custkey AS run, CASE WHEN o_orderkey % 8 = 0 THEN 2 ELSE 1 END AS v, o_orderkey % 5 = 0 AS zoned, o_orderkey % 6 = 0 AS long, o_custkey % 4 = 0 AND o_orderkey % 2 = 0 AS other FROM orders),
w AS (SELECT run, CASE WHEN v = 1 AND NOT zoned AND NOT long THEN CASE WHEN other THEN 'b' ELSE 'a' END END AS w FROM m)
SELECT run, count(*) AS n, coalesce(min(w) = max(w), false) AND count(w) = count(*) AS fixed FROM w GROUP BY run""")
def run_windows(t):
    """A run's window is written in UTC, 24 hours long, and the same in all its manifests."""
    k = F.col("o_orderkey")
    day = F.when((F.col("o_custkey") % 4 == 0) & (k % 2 == 0), F.lit("2026-10-13")).otherwise(F.lit("2026-10-12"))
    zone = F.when(k % 5 == 0, "+09:00").when(k % 3 == 0, "+00:00").otherwise("Z")
    end = F.date_format(F.date_add(F.to_date(day), F.when(k % 6 == 0, 2).otherwise(1)), "yyyy-MM-dd")
    m = t.orders.select(F.col("o_custkey").alias("run"), F.when(k % 8 == 0, 2).when(k % 3 == 0, 1).alias("version"), F.concat(day, F.lit("T00:00:00"), zone).alias("start"), F.concat(end, F.lit("T00:00:00"), zone).alias("end"))
    return publication.unchanged_window(m, "run")


@query("""
SELECT CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_editions, count(*) AS n_stories, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS n_unlinked, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS updated_at FROM orders""")
def index_totals(t):
    """Counters of the issue index."""
    s = t.orders.select(F.col("o_custkey").alias("edition_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("issue_id"), "o_orderdate")
    return publication.index_counters(s, "o_orderdate").withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd"))


@query("""
WITH w AS (SELECT o_custkey AS issue, o_orderkey AS edition, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [o_orderpriority, ' ', o_orderstatus] ELSE [o_orderstatus, o_orderpriority] END) AS item FROM orders)
SELECT issue, item, min(edition) AS first_seen FROM w WHERE trim(item) <> '' GROUP BY 1, 2""")
def watched_items(t):
    """Watched items over editions, each once."""
    items = F.when(F.col("o_orderkey") % 3 == 0, F.array("o_orderpriority", F.lit(" "), "o_orderstatus")).otherwise(F.array("o_orderstatus", "o_orderpriority"))
    return publication.watch_items(t.orders.select(F.col("o_custkey").alias("issue"), F.col("o_orderkey").alias("edition"), items.alias("items")), "issue", "items", "edition")


@query("""
WITH p AS (SELECT p_partkey AS id, p_size AS s, p_partkey % 7 AS r FROM part)
SELECT id, r % 2 = 0 OR s % 3 = 0 AS shared, CASE WHEN r = 0 THEN 'https://b.com,https://c.com' WHEN r % 2 = 0 THEN 'https://a.com,https://c.com' ELSE 'https://a.com,https://b.com,https://c.com' END AS evidence,
 CASE r WHEN 0 THEN 'one' WHEN 1 THEN 'a,b' WHEN 2 THEN 'x' ELSE '' END AS strings FROM p""")
def url_evidence(t):
    """Canonical URL overlap, evidence URLs of a response, and string-or-list values."""
    s, r = F.col("p_size"), F.col("p_partkey") % 7
    a = F.array(F.concat(F.lit("HTTPS://Site.com/a?q="), s, F.lit("&utm_x=1")), F.lit("https://other.com/"))
    b = F.array(F.concat(F.lit("https://site.com/a/?q="), F.when(r % 2 == 0, s).otherwise(s + 1)), F.when(s % 3 == 0, F.lit("https://other.com#x")).otherwise(F.lit("https://more.com")))
    none = F.lit(None).cast("string")
    many = lambda *u: F.array(*map(F.lit, u)) if u else F.array().cast("array<string>")
    call = lambda kind, status, url, searched, cited: F.struct(F.lit(kind).alias("type"), status.alias("status"), url.alias("url"), searched.alias("searched"), cited.alias("cited"))
    calls = F.array(
        call("read", F.when(r == 0, "failed").otherwise("completed"), F.lit("https://a.com"), many(), many()),
        call("search", F.lit("completed"), none, F.when(r % 2 == 1, many("https://b.com", "https://a.com")).when(r == 0, many("https://b.com")).otherwise(many()), many()),
        call("message", F.lit("completed"), none, many("https://ignored.com"), many("https://c.com", "")),
    )
    value = F.when(r == 0, F.lit('"one"')).when(r == 1, F.lit('["a", 1, "b"]')).when(r == 2, F.lit('["x", null]')).when(r == 3, F.lit("5")).otherwise(none)
    return t.part.select(F.col("p_partkey").alias("id"), publication.shares_url(a, b).alias("shared"), F.array_join(publication.evidence_urls(calls), ",").alias("evidence"), F.coalesce(F.array_join(publication.strings(value), ","), F.lit("")).alias("strings"))


@query("""
SELECT o_orderkey AS k, '2026-10-12-pm' AS id, 'pm' AS edition, '2026-10-12 21:00:00' AS cutoff_at, '2026-10-12 21:05:00' AS verified_at, 2 AS n_stories, o_orderstatus AS kept FROM orders""")
def stamped_drafts(t):
    """Drafts with the publisher's identity and times in place of their own."""
    source = F.array(F.struct(F.lit("u").alias("url"), F.lit("never").alias("verified_at")))
    story = F.struct(F.col("o_orderstatus").alias("title"), source.alias("sources"), source.alias("related"))
    draft = t.orders.select(F.col("o_orderkey").alias("k"), F.lit("draft").alias("id"), F.lit("x").alias("updated_at"), F.array(story, story).alias("stories"))
    out = publication.stamped(draft, "2026-10-12-pm", F.lit("2026-10-12 21:10:00"), F.lit("2026-10-12 21:05:00"))
    seen = F.col("stories")[1]["related"][0]["verified_at"]
    return views.without(out, "version", "zone").select("k", "id", "edition", F.date_format("cutoff_at", "yyyy-MM-dd HH:mm:ss").alias("cutoff_at"), seen.alias("verified_at"), F.size("stories").alias("n_stories"), F.col("stories")[0]["title"].alias("kept"))


@query("""
WITH b AS (SELECT o_orderkey AS op, o_custkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderstatus END AS digest FROM orders WHERE o_orderstatus <> 'P'), l AS (SELECT o_orderkey AS op, o_orderstatus AS digest FROM orders WHERE o_orderkey % 2 = 0)
SELECT b.op, CASE WHEN l.op IS NULL THEN 'new' WHEN l.digest = b.digest THEN 'replay' ELSE 'conflict' END AS outcome, c.c_custkey IS NOT NULL AS supersedes, '{"id":' || b.id || ',"revision":' || b.op || '}' AS payload FROM b LEFT JOIN l USING (op) LEFT JOIN customer c ON c.c_custkey = b.id AND c.c_custkey % 2 = 1""")
def operation_events(t):
    """Events of a batch: new, replayed or in conflict, with payload and the row superseded."""
    batch = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("op"), F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("revision"), F.when(F.col("o_orderkey") % 3 == 0, "changed").otherwise(F.col("o_orderstatus")).alias("digest"))
    log = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("op"), F.col("o_orderstatus").alias("digest"))
    current = t.customer.where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("revision"))
    none = t.spark.createDataFrame([], "key string, rule string")
    _, events = publication.plan(current, batch, log, none, "id", ["revision"], "op", "digest")
    return events.select("op", "outcome", F.col("superseded").isNotNull().alias("supersedes"), "payload")


@query("""
WITH l AS (SELECT o_orderkey AS op FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey AS id, o_orderkey AS revision FROM orders WHERE o_orderkey NOT IN (SELECT op FROM l))
SELECT coalesce(c.c_custkey, n.id) AS id, CAST(coalesce(n.revision, 0) AS BIGINT) AS revision FROM customer c FULL JOIN (SELECT id, max(revision) AS revision FROM b GROUP BY id) n ON n.id = c.c_custkey""")
def planned_state(t):
    """The state after a batch of new and replayed operations: replays change nothing."""
    batch = t.orders.select(F.col("o_orderkey").alias("op"), F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("revision"), F.col("o_orderstatus").alias("digest"))
    log = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("op"), F.col("o_orderstatus").alias("digest"))
    current = t.customer.select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("revision"))
    after, _ = publication.plan(current, batch, log, t.spark.createDataFrame([], "key string, rule string"), "id", ["revision"], "op", "digest")
    return after.select("id", "revision")


@query("""
SELECT p_partkey AS id, p_size % 4 <> 0 AS same_bytes, p_size % 3 <> 0 AS listed, p_size % 5 <> 0 AS receipt FROM part""")
def delivery_proof(t):
    """Delivered files: the planned bytes, in the index, with a receipt."""
    p = t.part.select(F.col("p_partkey").alias("id"), "p_size", F.sha2("p_name", 256).alias("sha256"))
    public = p.withColumn("sha256", F.when(F.col("p_size") % 4 == 0, "other").otherwise(F.col("sha256")))
    return publication.delivered(p.select("id", "sha256"), public, p.where("p_size % 3 <> 0"), p.where("p_size % 5 <> 0"), "id", "sha256")


@query("""
SELECT p_partkey AS id, p_size % 6 <> 0 AND p_size % 4 <> 0 AS valid, p_size % 6 <> 0 AS found FROM part""")
def verified_snapshots(t):
    """Snapshots looked up by reference; only bytes with the reference's digest are valid."""
    refs = t.part.select(F.col("p_partkey").alias("id"), F.sha2("p_name", 256).alias("sha256"))
    stored = t.part.where("p_size % 6 <> 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 4 == 0, F.lit("tampered")).otherwise(F.col("p_name")).alias("content"))
    return publication.verified_lookup(refs, stored, "id", "sha256", "content").select("id", "valid", F.col("content").isNotNull().alias("found"))


@query("""
WITH a AS (SELECT c_custkey AS id, c_mktsegment AS d FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE c_mktsegment END AS d FROM customer WHERE c_custkey % 2 = 0)
SELECT CAST(sum(CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_both, CAST(sum(CASE WHEN b.id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_left, CAST(sum(CASE WHEN a.id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_right,
 CAST(sum(CASE WHEN a.d = b.d THEN 1 ELSE 0 END) AS BIGINT) AS n_agree FROM a FULL JOIN b ON a.id = b.id""")
def population_overlap(t):
    """Published and candidate populations: what both have, and where they agree."""
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("d"))
    other = c.where("id % 2 = 0").withColumn("d", F.when(F.col("id") % 5 == 0, "x").otherwise(F.col("d")))
    return publication.overlap_report(c.where("id % 3 <> 0"), other, "id", "d")


_CALLS = "(SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'success' ELSE 'success' END AS mode, turn % 4 AS r FROM conversations)"


@query(f"""
SELECT conv_id || ':' || turn AS post, CASE WHEN r = 1 THEN 'conflict' WHEN r = 2 THEN 'deleted' WHEN r = 3 THEN 'incomplete' ELSE 'ok' END AS verdict, CAST(CASE WHEN r = 0 THEN 3 END AS BIGINT) AS k_count FROM {_CALLS}""")
def reconciled_comments(t):
    """Answers of a comment interface: one row an id, conflicts and deleted rows are errors, the total must agree."""
    row = lambda i, n, who: F.concat(F.lit(f'{{"w_idx":"{i}","w_content":"'), F.lit("ㅋ" * n), F.lit(f'","w_mb_id":"{who}"}}'))
    r = F.col("turn") % 4
    second = F.when(r == 1, row("1", 1, "a")).when(r == 2, row("2", 1, "delete")).otherwise(row("2", 1, "b"))
    body = F.concat(F.lit('{"mode":"success","total":'), F.when(r == 3, F.lit("5")).otherwise(F.lit("2")), F.lit(',"comment":['), row("1", 2, "a"), F.lit(","), row("1", 2, "a"), F.lit(","), second, F.lit("]}"))
    answers = t.conversations.select(F.concat_ws(":", "conv_id", "turn").alias("post"), body.alias("body"))
    return readers.reconciled(readers.comments(answers, "post", "body"), "post").select("post", "verdict", "k_count")


@query("""
WITH d AS (SELECT doc_id, doc_id % 4 AS r FROM documents)
SELECT doc_id, CASE WHEN r = 0 THEN 'From the head ' || doc_id WHEN r = 1 THEN 'Assigned' END AS title, CASE WHEN r <> 3 THEN '2026-10-12 00:00:00' END AS published FROM d""")
def article_fields(t):
    """Title by the head's property, else by the script's field; the epoch as an instant."""
    r = F.col("doc_id") % 4
    head = F.when(r == 0, F.concat(F.lit('<meta property="og:title" content="From the head '), F.col("doc_id"), F.lit('">'))).otherwise(F.lit(""))
    script = F.concat(F.lit("<script>\nAAGAG_AA.idx = 7\n"), F.when(r == 1, F.lit('AAGAG_AA.title = "Assigned"\n')).otherwise(F.lit("")), F.when(r != 3, F.lit("AAGAG_AA.otime = 1791763200\n")).otherwise(F.lit("")), F.lit("</script>"))
    a = readers.article(t.documents.select("doc_id", F.concat(head, script).alias("page")), "doc_id", "page")
    return a.select("doc_id", "title", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("""
WITH e AS (SELECT event_id AS k, ts, event_id % 5 AS r FROM events)
SELECT k, r <= 2 AS in_time, r <> 4 AS all_before, CASE WHEN r = 0 THEN '30분 전' ELSE r || '시간 전' END AS age, CASE WHEN r = 1 THEN 'second' WHEN r = 2 THEN NULL ELSE 'first' END AS given, hour(ts + INTERVAL 9 HOURS) AS korean_hour,
 CASE WHEN r = 0 THEN 'stopped' WHEN r = 1 THEN 'overdue' WHEN r = 3 THEN 'retrying' END AS notice, r < 3 AS day_over FROM e""")
def time_scalars(t):
    """Verification times, ages, Korean clock, monitor notices, whole days."""
    r = F.col("event_id") % 5
    ts = F.col("ts").cast("timestamp")
    hours = lambda n: F.make_dt_interval(hours=n)
    seen = ts - hours(F.when(r == 3, F.lit(7)).when(r == 4, F.lit(-1)).otherwise(r.cast("int")))
    made = F.when(r == 0, F.make_dt_interval(mins=F.lit(30))).otherwise(hours(r.cast("int")))
    day = F.date_add(F.to_date(ts), F.when(r < 3, F.lit(-1)).otherwise(F.lit(0)))
    return t.events.select(
        F.col("event_id").alias("k"), times.verified_in_time(seen, F.lit(None).cast("timestamp"), ts, ts, single_run=False).alias("in_time"),
        times.all_before(F.array(ts, F.lit(None).cast("timestamp"), F.when(r == 4, ts + hours(F.lit(1)))), ts).alias("all_before"), times.age_label(ts - made, ts).alias("age"),
        times.first_given(F.when(r == 1, "").when(r != 2, "first"), F.when(r == 1, "second")).alias("given"), F.hour(times.korean(ts)).cast("long").alias("korean_hour"),
        times.monitor_notice(F.when(r == 0, "stopped").when(r == 3, "retrying").otherwise("fine"), ts - hours(F.when(r == 1, F.lit(1)).otherwise(F.lit(-1))), ts).alias("notice"), times.date_wholly_before(day, F.date_trunc("day", ts).cast("timestamp_ntz")).alias("day_over"),
    )


@query("""
WITH d AS (SELECT doc_id AS k, source, lang, n_chars, doc_id % 3 AS r FROM documents)
SELECT k, r = 0 AS occur, sha256('{"lang":"' || lang || '","source":"' || source || '"}') AS digest, CASE WHEN r = 0 THEN 'a; b' ELSE 'a' END AS codes, 'x & "y" < ' || k AS decoded, CAST(k AS VARCHAR) AS bare, CASE WHEN r = 1 THEN 10 - k % 7 END AS safe, '국가%20' || k AS raw_path FROM d""")
def text_scalars(t):
    """Phrases that occur, record digests, codes, entities, bare ids, safe counts."""
    k, r = F.col("doc_id"), F.col("doc_id") % 3
    return t.documents.select(
        k.alias("k"), text.phrases_occur(F.array(F.when(r == 0, "two").otherwise("four")), F.array(F.lit("one two"), F.lit("three")), 1, 6).alias("occur"), text.record_digest("source", "lang").alias("digest"),
        text.joined_codes(F.array(F.when(r == 0, "b").otherwise("a"), F.lit("a"))).alias("codes"), text.decode_entities(F.concat(F.lit("x &amp; &quot;y&quot; &lt; "), k)).alias("decoded"), urls.bare_identity(F.concat(F.lit("aagag-"), k, F.when(r == 0, "_2").otherwise(""))).alias("bare"),
        text.safe_count(F.when(r == 0, F.lit("-1")).when(r == 1, (10 - k % 7).cast("string")).otherwise(F.lit("99999999999999999"))).alias("safe"), F.url_decode(F.replace(text.encode_unicode(F.concat(F.lit("국가%20"), k)), F.lit("%20"), F.lit("%2520"))).alias("raw_path"),
    )


@query("""
WITH o AS (SELECT o_orderkey AS id, o_custkey AS issue, o_orderdate AS tm, o_totalprice AS p FROM orders WHERE o_totalprice >= 50000)
SELECT id, lag(id) OVER (PARTITION BY issue ORDER BY tm, id) AS previous_id FROM o""")
def earlier_entries(t):
    """Rows at the threshold, each with the one before of its issue."""
    o = counting.at_least(t.orders, "o_totalprice", 50000).select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate")
    return ordering.previous(o, "o_custkey", ["o_orderdate", "id"], ["id"]).select("id", "previous_id")


@query("""
SELECT c_custkey AS id, c_nationkey AS topic, CAST(c_custkey % 3 AS BIGINT) AS revision FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def registry_additions(t):
    """Registry rows (identity and revision) that aren't stored yet."""
    items = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("topic"), (F.col("c_custkey") % 3).alias("revision"), "c_name")
    return writers.append_new(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")), views.registry(items), "id")


@query("""
WITH e AS (SELECT o_orderkey AS id, o_orderpriority AS headline FROM orders ORDER BY o_orderkey DESC LIMIT 6) SELECT id, headline FROM e""")
def recent_history(t):
    """The last six editions with the keys that research needs."""
    return views.compact_history(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("headline"), "o_totalprice"), "id", ["id", "headline"])


@query("""
SELECT event_id AS mark FROM events ORDER BY event_id DESC LIMIT 2000""")
def recent_read_marks(t):
    """The most recent 2000 marks."""
    return views.recent_marks(t.events.select(F.col("event_id").alias("mark")), "mark")


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, url FROM pages)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://example.org/' || page_id END AS link, 'https://b.com' AS extra FROM p""")
def original_links(t):
    """Captured links outside the aggregator, and links that aren't among the sources."""
    rows = t.pages.select("page_id")
    captured = t.pages.select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://example.org/"), "page_id")).otherwise(F.concat(F.lit("https://img.aagag.com/"), "page_id")).alias("link"))
    out = views.own_links(rows, captured, "page_id", urls.host(F.col("link")), "aagag.com")
    extra = out.withColumn("links", F.array(F.lit("https://a.com"), F.lit("https://b.com"))).withColumn("sources", F.array(F.lit("https://a.com")))
    return extra.select("page_id", "link", F.array_join(views.related(extra, "links", "sources"), ",").alias("extra"))


@query("""
WITH e AS (SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS archive, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 2 END AS n FROM orders)
SELECT id, CAST(n AS INTEGER) AS n_stories, CASE WHEN archive THEN 'archive/' ELSE '' END || '2026-10-12/pm.json' AS path, CASE WHEN n > 0 THEN 'first ' || id END AS headline FROM e""")
def edition_index(t):
    """Index rows of editions: stories, path and headline."""
    story = lambda w: F.struct(F.concat(F.lit(w + " "), F.col("o_orderkey")).alias("title"))
    stories = F.when(F.col("o_orderkey") % 5 == 0, F.array().cast("array<struct<title:string>>")).otherwise(F.array(story("first"), story("second")))
    e = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("2026-10-12").alias("date"), F.lit("pm").alias("edition"), (F.col("o_orderkey") % 2 == 0).alias("archive"), stories.alias("stories"))
    return views.index_rows(e)
