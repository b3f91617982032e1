"""Queries on ranking, previous and next rows, best observations, timelines and revisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import audit, ordering, revisions, state, timeline
from tallyloom.plans.registry import query

_PARTS = """SELECT p_partkey AS id, p_brand AS edition, p_size * 2 AS importance, p_partkey % 101 AS domestic, p_partkey % 7 * 10 AS reliability, p_partkey % 13 * 5 AS recency, p_partkey % 17 * 5 AS interest FROM part"""


def _parts(t):
    k = F.col("p_partkey")
    return t.part.select(k.alias("id"), F.col("p_brand").alias("edition"), (F.col("p_size") * 2).alias("importance"), (k % 101).alias("domestic"), (k % 7 * 10).alias("reliability"), (k % 13 * 5).alias("recency"), (k % 17 * 5).alias("interest"))


@query(f"""
WITH p AS ({_PARTS})
SELECT id, edition, CAST(round((recency * 20 + importance * 35 + interest * 10 + domestic * 25 + reliability * 10) / 100.0, 2) AS DOUBLE) AS score,
 CAST(row_number() OVER (PARTITION BY edition ORDER BY importance DESC, domestic DESC, reliability DESC, recency DESC, interest DESC, id) AS BIGINT) AS rank FROM p""")
def editorial_order(t):
    """Weighted score in decimals, and the order by parts with ties in input order."""
    p = _parts(t)
    s = ordering.score({k: F.col(k) for k in ordering.WEIGHTS})
    return ordering.editorial_rank(p, ["edition"], "id").select("id", "edition", s.cast("double").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH p AS ({_PARTS}), r AS (SELECT *, row_number() OVER (PARTITION BY edition ORDER BY importance DESC, domestic DESC, id) AS rank FROM p)
SELECT id, edition, CAST(rank AS BIGINT) AS rank, reliability >= 70 AND importance >= 70 AS leads FROM (SELECT *, reliability + 40 AS r2 FROM r) WHERE rank <= 3""")
def lead_stories(t):
    """The first three of each edition, and which may lead."""
    top = ordering.top_k(_parts(t), ["edition"], [F.col("importance").desc(), F.col("domestic").desc(), F.col("id")], 3)
    return top.select("id", "edition", F.col("rank").cast("long").alias("rank"), ((F.col("reliability") >= 70) & (F.col("importance") >= 70)).alias("leads"))


@query("""
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CAST(event_type = 'purchase' AS INT) DESC, ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def best_observation(t):
    """Complete first, then newest, then greatest id."""
    e = t.events.withColumn("c", (F.col("event_type") == "purchase").cast("int"))
    return ordering.best_row(e, "user_id", ["c", "ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("""
WITH e AS (SELECT user_id, event_id, event_type <> 'error' AS ok FROM events), s AS (SELECT user_id, arg_max(event_id, (CASE WHEN ok THEN 1 ELSE 0 END) * 1000000000 + event_id) AS selected, max(event_id) AS latest FROM e GROUP BY 1)
SELECT s.user_id, s.selected, CAST((SELECT count(*) FROM e WHERE e.user_id = s.user_id AND NOT ok AND event_id > s.selected) AS BIGINT) AS newer_incomplete, s.latest FROM s""")
def newer_incomplete(t):
    """The selected observation, the latest attempt and the incomplete ones between."""
    e = t.events.withColumn("ok", F.col("event_type") != "error")
    return ordering.newer_incomplete(e, "user_id", ["event_id"], "ok").select("user_id", F.col("selected.event_id").alias("selected"), "newer_incomplete", F.col("latest.event_id").alias("latest"))


@query("""
SELECT event_id, lag(event_id) OVER w AS previous_entry, CAST(row_number() OVER w AS BIGINT) AS entry_no FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def issue_entries(t):
    """Each entry of an issue with the one before."""
    return timeline.entries(t.events, "user_id", ["ts", "event_id"], "event_id").select("event_id", "previous_entry", F.col("entry_no").cast("long").alias("entry_no"))


@query("""
SELECT o_custkey AS issue, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS categories, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_covered, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_covered, count(*) AS n_entries,
 arg_max(o_orderkey, epoch(o_orderdate) * 10000000 + o_orderkey) AS latest_entry FROM orders GROUP BY 1""")
def issue_index(t):
    """Per issue: categories, first and last coverage, entries and the latest."""
    i = timeline.issue_index(t.orders, "o_custkey", "o_orderdate", "o_orderstatus", "o_orderkey")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return i.select(F.col("o_custkey").alias("issue"), F.array_join("categories", ",").alias("categories"), day("first_covered"), day("last_covered"), "n_entries", "latest_entry")


@query("""
WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS d FROM events)
SELECT event_id, CAST((SELECT count(*) FROM e p WHERE p.user_id = e.user_id AND p.d < e.d) AS BIGINT) AS n_prior, (SELECT max(event_id) FROM e p WHERE p.user_id = e.user_id AND p.d = (SELECT max(d) FROM e q WHERE q.user_id = e.user_id AND q.d < e.d)) AS last_prior FROM e""")
def visible_history(t):
    """Only strictly earlier editions are visible."""
    e = t.events.withColumn("d", F.to_date("ts"))
    return ordering.visible_before(e, "user_id", "d", "event_id").select("event_id", "n_prior", "last_prior")


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN event_id - event_id % 50 END AS fix FROM events)
SELECT e.event_id, f.event_id AS superseded_by FROM e LEFT JOIN e f ON f.fix = e.event_id""")
def corrections_applied(t):
    """Each entry with the corrections that name it."""
    fix = F.when(F.col("event_type") == "error", F.col("event_id") - F.col("event_id") % 50)
    e = timeline.superseded_by(t.events.withColumn("fix", fix).drop("superseded_by"), "event_id", "fix")
    return e.select("event_id", "superseded_by")


@query("""
WITH c AS (SELECT conv_id, turn, role = 'user' AS seen FROM conversations)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY CAST(seen AS INT), turn) AS BIGINT) AS place,
 coalesce((SELECT min(n.turn) FROM c n WHERE n.conv_id = c.conv_id AND n.turn > c.turn AND NOT n.seen), (SELECT min(n.turn) FROM c n WHERE n.conv_id = c.conv_id AND n.turn < c.turn AND NOT n.seen)) AS next_unread,
 lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM c""")
def reading_order(t):
    """Unread first, the next unread with wrap-around, and the neighbours of each row."""
    c = t.conversations.select("conv_id", "turn", (F.col("role") == "user").alias("seen"))
    c = ordering.neighbours(ordering.next_unread(ordering.unread_first(c, "conv_id", "seen", "turn"), "conv_id", "turn", "turn", "seen"), "conv_id", ["turn"], "turn")
    return c.select("conv_id", "turn", F.col("place").cast("long").alias("place"), "next_unread", "before", "after")


@query("""
SELECT event_id, first_value(event_type) OVER w AS first_event_type, lag(event_type) OVER w <> event_type AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def sticky_first(t):
    """The first observation stays; changes are marked."""
    return ordering.sticky_first(t.events, "user_id", ["ts", "event_id"], "event_type").select("event_id", "first_event_type", "changed")


@query("""
SELECT source, lang, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY source, lang""")
def first_of_each(t):
    """Ordered dedup: the first row of each key."""
    d = t.documents.withColumn("pos", F.col("doc_id"))
    return ordering.first_per_key(d.select("source", "lang", "doc_id", "n_chars", "pos"), ["source", "lang"], "pos").select("source", "lang", "doc_id", "n_chars")


@query("""
SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events ORDER BY d DESC LIMIT 14)""")
def latest_editions(t):
    """Rows of the last fourteen editions."""
    return ordering.latest_n_groups(t.events.withColumn("d", F.to_date("ts")), "d", 14).select("event_id", "user_id")


@query("""
SELECT event_type AS op, count(*) AS n_seen, min(value) <> max(value) AS conflict FROM events GROUP BY 1""")
def operation_replays(t):
    """An operation id with one digest is a replay, with several a conflict."""
    return state.operations(t.events.withColumnRenamed("event_type", "op"), "op", "value")


@query("""
SELECT event_id, CAST(row_number() OVER w - 1 AS BIGINT) AS current_revision, CAST(json_extract(props, '$.k') AS BIGINT) % 5 = row_number() OVER w - 1 AS revision_ok, coalesce(value >= lag(value) OVER w, true) AS time_ok,
 CASE WHEN row_number() OVER w = 1 THEN true ELSE event_type = lag(event_type) OVER w END AS identity_ok FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def revision_audit(t):
    """Expected revision, monotone verification and fixed identity of every write."""
    e = t.events.withColumn("expected", F.get_json_object("props", "$.k").cast("long") % 5)
    r = state.revision_checks(e, "user_id", ["ts", "event_id"], "expected", "value", ["event_type"])
    return r.select("event_id", F.col("current_revision").cast("long").alias("current_revision"), "revision_ok", "time_ok", "identity_ok")


@query("""
WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS d FROM orders WHERE o_orderkey % 3 < 2), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS d FROM orders WHERE o_orderkey % 3 > 0)
SELECT b.id, CASE WHEN a.id IS NULL THEN 'new' WHEN a.d = b.d THEN 'same' ELSE 'conflict' END AS status FROM b LEFT JOIN a USING (id)""")
def merge_status(t):
    """Incoming rows against stored ones: new, same or conflict."""
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("d"))
    b = o.where("id % 3 > 0").withColumn("d", F.when(F.col("id") % 10 == 0, "X").otherwise(F.col("d")))
    return state.merge_or_conflict(o.where("id % 3 < 2"), b, "id", "d").select("id", "status")


@query("""
WITH s AS (SELECT s_suppkey AS id, s_nationkey AS v FROM supplier), d AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN -1 ELSE s_nationkey END AS v FROM supplier)
SELECT *, 'stored' AS side FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM d) UNION ALL SELECT *, 'derived' FROM (SELECT * FROM d EXCEPT ALL SELECT * FROM s)""")
def derived_drift(t):
    """Stored against recomputed rows, both ways."""
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("v"))
    return state.drift(s, s.withColumn("v", F.when(F.col("id") % 7 == 0, -1).otherwise(F.col("v"))))


@query("""
SELECT c_custkey AS id, coalesce((SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P'), 0) AS n_corrections, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS last_correction FROM customer""")
def items_with_corrections(t):
    """Items unchanged, with what was appended to them."""
    c = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("correction_id"))
    return state.with_corrections(t.customer.select(F.col("c_custkey").alias("id")), c, "id").select("id", "n_corrections", "last_correction")


@query("""
WITH log AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_id % 2 = 0)
SELECT user_id, event_id FROM log WHERE k = 1""")
def rejected_batch(t):
    """One invalid row rejects its whole batch: the state is what it was."""
    bad = t.events.where("event_id % 2 = 1 and value < 1e9").limit(1)
    out = state.apply_batch(t.events.where("event_id % 2 = 0"), t.events.where("event_id % 2 = 1"), bad, "user_id", ["ts", "event_id"])
    return out.select("user_id", "event_id")


@query("""
WITH RECURSIVE w AS (SELECT o_orderkey AS id, o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, o_orderkey % 4 AS expected, CAST(floor(o_totalprice) AS BIGINT) AS verified, o_orderstatus AS fixed FROM orders),
f AS (SELECT k, arg_min(fixed, i) AS fixed FROM w WHERE expected = 0 GROUP BY k),
m AS (SELECT w.*, coalesce(w.fixed = f.fixed, false) AS same FROM w LEFT JOIN f USING (k)),
s(k, i, id, r, v, accepted) AS (SELECT k, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false FROM (SELECT DISTINCT k FROM m)
 UNION ALL SELECT s.k, m.i, m.id, CASE WHEN s.accepted THEN s.r + 1 ELSE s.r END, CASE WHEN s.accepted THEN p.verified ELSE s.v END,
 m.same AND m.expected = CASE WHEN s.accepted THEN s.r + 1 ELSE s.r END AND coalesce(m.verified >= CASE WHEN s.accepted THEN p.verified ELSE s.v END, true) FROM s JOIN m ON m.k = s.k AND m.i = s.i + 1 LEFT JOIN m p ON p.k = s.k AND p.i = s.i)
SELECT s.id, s.r AS current_revision, m.expected = s.r AS revision_ok, coalesce(m.verified >= s.v, true) AS time_ok, s.r = 0 OR m.same AS identity_ok, s.accepted FROM s JOIN m ON m.id = s.id""")
def write_audit(t):
    """Attempted writes, refused ones among them: a refused write leaves the revision as it is."""
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), "o_orderdate", (F.col("o_orderkey") % 4).alias("expected"), F.floor("o_totalprice").alias("verified"), F.col("o_orderstatus").alias("fixed"))
    w = revisions.attempted_writes(o, "k", ["o_orderdate", "id"], "expected", "verified", ["fixed"])
    return w.select("id", "current_revision", "revision_ok", "time_ok", "identity_ok", "accepted")


@query("""
WITH RECURSIVE w AS (SELECT event_id AS id, user_id AS k, ts AS seen, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS i, event_id % 3 AS expected, CAST(floor(value) AS BIGINT) AS verified, date_trunc('day', ts) + (event_id % 2) * INTERVAL 6 HOUR AS published FROM events),
u AS (SELECT *, coalesce(published <= seen AND seen < published + INTERVAL 24 HOUR, false) AS fresh FROM w),
f AS (SELECT k, arg_min(published, i) AS p FROM u WHERE fresh AND expected = 0 AND verified IS NOT NULL GROUP BY k),
s(k, i, id, r, v, accepted, verified) AS (SELECT DISTINCT k, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false, CAST(NULL AS BIGINT) FROM u
 UNION ALL SELECT s.k, u.i, u.id, CASE WHEN s.accepted THEN s.r + 1 ELSE s.r END, CASE WHEN s.accepted THEN s.verified ELSE s.v END,
 u.fresh AND coalesce(u.published = f.p, false) AND u.expected = CASE WHEN s.accepted THEN s.r + 1 ELSE s.r END AND coalesce(u.verified >= CASE WHEN s.accepted THEN s.verified ELSE s.v END, u.verified IS NOT NULL), u.verified FROM s JOIN u ON u.k = s.k AND u.i = s.i + 1 LEFT JOIN f ON f.k = s.k),
a AS (SELECT s.k, min(u.seen) AS first_seen, min(u.published) AS published, count(*) AS n FROM s JOIN u ON u.id = s.id WHERE accepted GROUP BY s.k)
SELECT s.k AS key, CAST(s.id AS VARCHAR) AS op, CASE WHEN NOT accepted THEN 'refused' WHEN r = 0 THEN 'first' ELSE 'update' END AS kind, CASE WHEN accepted THEN NULL WHEN NOT fresh THEN 'stale' WHEN r > 0 AND u.published <> f.p THEN 'identity' WHEN u.expected <> s.r THEN 'revision' ELSE 'verification' END AS reason,
 u.seen AS "at", CASE WHEN accepted THEN r + 1 ELSE r END AS revision, CASE WHEN accepted OR r > 0 THEN a.first_seen END AS first_seen, CASE WHEN accepted OR r > 0 THEN a.published END AS published FROM s JOIN u ON u.id = s.id LEFT JOIN f ON f.k = s.k LEFT JOIN a ON a.k = s.k
UNION ALL SELECT k, NULL, 'expired', NULL, published + INTERVAL 24 HOUR, n, first_seen, published FROM a WHERE published + INTERVAL 24 HOUR <= TIMESTAMP '2024-03-01 00:00:00'""")
def rolling_events(t):
    """Rolling items by a log of writes: first and later ones, refusals with their reason, and expiries."""
    e = t.events.select(F.col("event_id").alias("op"), F.col("user_id").alias("k"), F.col("ts").alias("at"), (F.col("event_id") % 3).alias("expected"), F.floor("value").alias("verified"), (F.date_trunc("day", "ts").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 2 * 6).cast("int"))).alias("published"))
    return revisions.rolling(e.withColumn("op", F.col("op").cast("string")), "k", "op", "at", "expected", "verified", "published", F.lit("2024-03-01").cast("timestamp_ntz"))


_STORED = "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_partkey % 211 <> 0"
_DERIVED = "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 199 = 0 THEN l_quantity + 1 ELSE l_quantity END, l_returnflag FROM lineitem WHERE l_suppkey % 97 <> 0"


@query(f"""
SELECT *, 'stored' AS side FROM ({_STORED} EXCEPT ALL {_DERIVED}) UNION ALL SELECT *, 'derived' FROM ({_DERIVED} EXCEPT ALL {_STORED})""")
def audited_drift(t):
    """Stored lines against derived ones, by digests of ranges: rows that one side has and the other has not."""
    l = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_partkey", "l_suppkey")
    stored = l.where("l_partkey % 211 <> 0").drop("l_partkey", "l_suppkey")
    derived = l.where("l_suppkey % 97 <> 0").withColumn("l_quantity", F.when(F.col("l_partkey") % 199 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))).drop("l_partkey", "l_suppkey")
    return audit.drift(stored, derived, ["l_orderkey"])
