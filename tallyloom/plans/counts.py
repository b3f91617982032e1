"""Queries on conflict-aware counting, coverage, reports and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import counting, matching, rules, timeline
from tallyloom.plans.registry import query
from tallyloom.sinks import writers

_CELLS = "(SELECT conv_id, turn % 3 AS cid, turn, CAST(length(text) - length(replace(text, 'e', '')) AS BIGINT) AS k FROM conversations)"


def _cells(t):
    return t.conversations.select("conv_id", (F.col("turn") % 3).alias("cid"), "turn", text.literal_count(F.col("text"), "e").cast("long").alias("k"))


@query(f"""
WITH p AS (SELECT conv_id, cid, min(k) AS lo, max(k) AS hi FROM {_CELLS} GROUP BY 1, 2)
SELECT conv_id, CAST(sum(lo) AS BIGINT) AS k_count, count(*) AS n_comments, CAST(sum(CASE WHEN lo <> hi THEN 1 ELSE 0 END) AS BIGINT) AS n_conflicts, sum(CASE WHEN lo <> hi THEN 1 ELSE 0 END) = 0 AS complete FROM p GROUP BY conv_id""")
def strict_comment_counts(t):
    """Counts over distinct comment ids; a conflicting repeat makes the total incomplete."""
    return counting.strict_counts(_cells(t), "conv_id", "cid", "k")


@query(f"""
WITH p AS (SELECT conv_id, cid, arg_max(k, turn) AS l, count(*) AS n, min(k) AS lo, max(k) AS hi FROM {_CELLS} GROUP BY 1, 2)
SELECT conv_id, CAST(sum(l) AS BIGINT) AS k_count, count(*) AS n_comments, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, CAST(sum(CASE WHEN lo <> hi THEN 1 ELSE 0 END) AS BIGINT) AS n_conflicts, CAST(0 AS BIGINT) AS invalid_rows FROM p GROUP BY conv_id""")
def tolerant_comment_counts(t):
    """The last row of each id counts; repeats and conflicts are reported."""
    return counting.tolerant_counts(_cells(t), "conv_id", "cid", "k", "turn")


@query(f"""
WITH p AS (SELECT conv_id, cid, min(k) AS lo, max(k) AS hi FROM {_CELLS} GROUP BY 1, 2),
c AS (SELECT conv_id, CAST(sum(lo) AS BIGINT) AS k_count, sum(CASE WHEN lo <> hi THEN 1 ELSE 0 END) = 0 AS complete FROM p GROUP BY conv_id)
SELECT conv_id, CASE WHEN complete THEN k_count END AS known_count, CASE WHEN NOT complete AND k_count >= 11 THEN k_count END AS known_minimum,
 CASE WHEN complete THEN k_count >= 11 WHEN k_count >= 11 THEN true END AS qualified,
 CASE WHEN complete THEN 'exact' WHEN k_count >= 11 THEN 'lower_bound' ELSE 'unknown' END AS basis FROM c""")
def count_evidence(t):
    """Exact, lower-bound and unknown totals; unknown is neither zero nor false."""
    c = counting.strict_counts(_cells(t), "conv_id", "cid", "k")
    return counting.evidence(c, 11).select("conv_id", "known_count", "known_minimum", "qualified", "basis")


@query(f"""
WITH c AS (SELECT conv_id, CAST(sum(k) AS BIGINT) AS k FROM {_CELLS} GROUP BY conv_id)
SELECT sum(CASE WHEN k >= 10 THEN 1 ELSE 0 END) AS rolling, sum(CASE WHEN k >= 11 THEN 1 ELSE 0 END) AS fixed, count(*) AS n FROM c""")
def threshold_populations(t):
    """The rolling and the fixed-window threshold side by side."""
    c = _cells(t).groupBy("conv_id").agg(F.sum("k").alias("k"))
    return c.agg(F.count_if(F.col("k") >= 10).alias("rolling"), F.count_if(F.col("k") >= 11).alias("fixed"), F.count("*").alias("n"))


@query("""
WITH l AS (SELECT DISTINCT l_orderkey AS id FROM lineitem), o AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P'), x AS (SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '5-LOW')
SELECT count(*) AS n_listed, CAST(sum(CASE WHEN id IN (SELECT id FROM x) THEN 1 ELSE 0 END) AS BIGINT) AS n_excluded,
 CAST(sum(CASE WHEN id NOT IN (SELECT id FROM x) AND id IN (SELECT id FROM o) THEN 1 ELSE 0 END) AS BIGINT) AS n_observed,
 CAST(sum(CASE WHEN id NOT IN (SELECT id FROM x) AND id NOT IN (SELECT id FROM o) THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
 sum(CASE WHEN id NOT IN (SELECT id FROM x) AND id NOT IN (SELECT id FROM o) THEN 1 ELSE 0 END) = 0 AS complete FROM l""")
def run_coverage(t):
    """Listed, excluded, observed and missing ids of a run."""
    o = t.orders.select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority")
    return timeline.coverage(t.lineitem.select(F.col("l_orderkey").alias("id")), o.where("o_orderstatus <> 'P'"), o.where("o_orderpriority = '5-LOW'"), "id")


@query("""
SELECT l_orderkey AS id, min(l_shipdate) IS NOT NULL AS seen, CAST(min(CAST(l_shipdate AS DATE)) AS VARCHAR) AS first_seen FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY l_orderkey""")
def pending_queue(t):
    """The work queue: listed less observed less excluded, with the first listing."""
    listed = t.lineitem.select(F.col("l_orderkey").alias("id"), "l_shipdate")
    o = t.orders.withColumnRenamed("o_orderkey", "id")
    q = matching.pending(listed, "id", "l_shipdate", o.where("o_orderstatus = 'F'"), o.where("o_orderpriority = '1-URGENT'"))
    return q.select("id", F.col("first_seen").isNotNull().alias("seen"), F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"))


@query("""
SELECT l_orderkey AS post, (min(l_linenumber) = 1 AND max(l_linenumber) = count(DISTINCT l_linenumber)) AS contiguous, arg_max(l_returnflag = 'A', l_linenumber * 1000000 + l_partkey) IS NOT NULL AS boundary_known, count(DISTINCT l_linenumber) AS n_pages
FROM lineitem GROUP BY l_orderkey""")
def page_contiguity(t):
    """Pages of a pass run from 1 without gaps."""
    p = timeline.pages_contiguous(t.lineitem.withColumn("b", F.col("l_returnflag") == "A"), "l_orderkey", "l_linenumber", "b")
    return p.select(F.col("l_orderkey").alias("post"), "contiguous", F.col("boundary_confirmed").isNotNull().alias("boundary_known"), "n_pages")


@query("""
SELECT user_id, event_type, bool_and(ts < TIMESTAMP '2024-01-25 00:00:00') AS boundary_confirmed, count(*) AS n_rows FROM events GROUP BY 1, 2""")
def boundary_proofs(t):
    """A page proves the boundary only if all its rows are older."""
    return timeline.boundary_proof(t.events, ["user_id", "event_type"], "ts", F.expr("TIMESTAMP_NTZ'2024-01-25 00:00:00'"))


@query("""
WITH f AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' END AS in_window, o_totalprice > 200000 AS candidate FROM orders)
SELECT count(*) AS n_rows, CAST(sum(CASE WHEN in_window THEN 1 ELSE 0 END) AS BIGINT) AS in_window_yes, CAST(sum(CASE WHEN NOT in_window THEN 1 ELSE 0 END) AS BIGINT) AS in_window_no, CAST(sum(CASE WHEN in_window IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS in_window_unknown,
 CAST(sum(CASE WHEN candidate THEN 1 ELSE 0 END) AS BIGINT) AS candidate_yes, CAST(sum(CASE WHEN NOT candidate THEN 1 ELSE 0 END) AS BIGINT) AS candidate_no, CAST(sum(CASE WHEN candidate IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS candidate_unknown FROM f""")
def run_counters(t):
    """Counters of a run; a tri-state flag gives three."""
    f = t.orders.select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ'1998-01-01 00:00:00'")).alias("in_window"), (F.col("o_totalprice") > 200000).alias("candidate"))
    return timeline.run_summary(f, ["in_window", "candidate"])


@query("""
WITH h AS (SELECT o_custkey AS c, list_sort(list(DISTINCT o_orderstatus)) AS r FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT c_custkey AS c, CASE WHEN r IS NULL THEN c_acctbal > 0 END AS member, coalesce(array_to_string(r, ','), '') AS reasons FROM customer LEFT JOIN h ON c = c_custkey""")
def held_posts(t):
    """Held posts lose their membership (unknown) and say why."""
    holds = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("reason"))
    posts = t.customer.select(F.col("c_custkey").alias("c"), (F.col("c_acctbal") > 0).alias("member"))
    return timeline.overlay_holds(posts, holds, "c", "member").select("c", "member", F.coalesce(F.array_join("hold_reasons", ","), F.lit("")).alias("reasons"))


@query("""
SELECT 'k' AS field, CAST(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS DOUBLE) AS total, count(*) AS n FROM events""")
def usage_totals(t):
    """Every numeric field of a JSON object, summed."""
    return counting.numeric_totals(t.events, "props")


@query("""
SELECT text AS story, n FROM (SELECT md5(text) AS text, count(*) AS n FROM documents GROUP BY text) WHERE n > 1""")
def repeat_counts(t):
    """Keys that occur more than once."""
    return timeline.repeat_report(t.documents.select(F.md5("text").alias("story")), "story")


@query("""
WITH r AS (
 SELECT d.doc_id AS key, CASE WHEN trim(d.text) = '' OR length(d.text) > 5000 THEN 'text_length' END AS a, CASE WHEN NOT regexp_matches(d.source, '^[a-z0-9][a-z0-9-]{0,119}$') THEN 'source_slug' END AS b,
  CASE WHEN d.lang NOT IN ('en', 'de') THEN 'language' END AS c, CASE WHEN coalesce(l.quality, 0) <> 1 THEN 'reviewed_good' END AS e FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT key, a AS rule FROM r WHERE a IS NOT NULL UNION ALL SELECT key, b FROM r WHERE b IS NOT NULL UNION ALL SELECT key, c FROM r WHERE c IS NOT NULL UNION ALL SELECT key, e FROM r WHERE e IS NOT NULL""")
def story_violations(t):
    """The rule table: each rule that a row breaks; unknown breaks it."""
    d = t.documents.join(t.labels, "doc_id", "left")
    return rules.violations(d, "doc_id", {"text_length": text.present(F.col("text"), 5000), "source_slug": text.is_slug(F.col("source")), "language": F.col("lang").isin("en", "de"), "reviewed_good": F.col("quality") == 1})


@query("""
WITH g AS (SELECT o_custkey AS key, count(*) >= 3 AND count(*) <= 20 AS story_count, count(DISTINCT o_orderdate) = count(*) AS unique_dates, max(o_totalprice) < 450000 AS price_cap FROM orders GROUP BY 1),
v AS (SELECT key, 'story_count' AS rule FROM g WHERE NOT story_count UNION ALL SELECT key, 'unique_dates' FROM g WHERE NOT unique_dates UNION ALL SELECT key, 'price_cap' FROM g WHERE NOT price_cap)
SELECT rule, count(*) AS n FROM v GROUP BY rule""")
def edition_gate(t):
    """Rules on groups, counted by rule."""
    v = rules.group_violations(t.orders, "o_custkey", {"story_count": F.count("*").between(3, 20), "unique_dates": F.count_distinct("o_orderdate") == F.count("*"), "price_cap": F.max("o_totalprice") < 450000})
    return rules.counts(v)


@query("""
SELECT p_partkey AS id, CASE WHEN regexp_matches(p_name, '^[=+@-]') THEN '''' || p_name ELSE p_name END AS name, CASE WHEN p_size % 2 = 0 THEN '''-' || p_size ELSE CAST(p_size AS VARCHAR) END AS size,
 '{"brand":"' || p_brand || '","type":"' || p_type || '"}' AS cell FROM part""")
def guarded_export(t):
    """CSV cells: nested values as JSON, formulas guarded."""
    p = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("-"), F.col("p_size"))).otherwise(F.col("p_size").cast("string")).alias("size"), F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")).alias("cell"))
    return writers.csv_guarded(p).withColumn("id", F.col("id").cast("long"))


@query("""
SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS total, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS priority FROM orders""")
def public_rows(t):
    """Allow-listed columns, each null without its own evidence."""
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"), "o_custkey")
    return writers.public_columns(o, ["id", "status", "total", "priority"], {"total": F.col("status") == "F", "priority": F.col("priority") != "4-NOT SPECIFIED"})


@query("""
SELECT p_brand AS brand, count(*) AS n_items, max(p_size) = 50 AS has_news FROM part GROUP BY 1""")
def snapshot_refs(t):
    """Snapshots by edition: items and whether there is news (their digests are tested apart)."""
    return writers.snapshot_rows(t.part, "p_brand", ["p_partkey", "p_name"], F.col("p_size") == 50).select(F.col("p_brand").alias("brand"), "n_items", "has_news")
