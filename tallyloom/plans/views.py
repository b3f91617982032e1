"""Queries on display orders, projections, filters and report counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import views
from tallyloom.plans.registry import query


@query("""
WITH e AS (SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE WHEN hour(ts) < 12 THEN 'am' ELSE 'pm' END AS edition, event_type = 'error' AS archive, ts, user_id FROM events)
SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY day, edition, CASE WHEN archive THEN 0 ELSE 1 END, event_id) AS BIGINT) AS edition_place,
 CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS BIGINT) AS stored_place, CAST(row_number() OVER (PARTITION BY user_id ORDER BY day DESC, event_id ASC) AS BIGINT) AS shown_place,
 CASE WHEN archive THEN 'archive/' ELSE '' END || day || '/' || edition || '.json' AS path FROM e""")
def display_orders(t):
    """Edition order, stored and displayed feed order, and paths."""
    e = t.events.select("event_id", "user_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(F.hour("ts") < 12, "am").otherwise("pm").alias("edition"), (F.col("event_type") == "error").alias("archive"))
    e = views.placed(e, ["user_id"], views.edition_order(F.col("day"), F.col("edition"), F.col("archive"), F.col("event_id")), "edition_place")
    e = views.placed(e, ["user_id"], views.feed_order(F.col("ts"), F.col("event_id"), False), "stored_place")
    e = views.placed(e, ["user_id"], views.feed_order(F.col("day"), F.col("event_id"), True), "shown_place")
    return e.select("event_id", *(F.col(c).cast("long").alias(c) for c in ("edition_place", "stored_place", "shown_place")), views.edition_path(F.col("day"), F.col("edition"), F.col("archive")).alias("path"))


@query("""
WITH e AS (SELECT o_orderkey AS id, o_custkey AS issue, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS event_date, o_orderdate AS covered FROM orders)
SELECT id, CAST(row_number() OVER (PARTITION BY issue ORDER BY event_date ASC NULLS LAST, covered, id) AS BIGINT) AS place FROM e""")
def entry_order(t):
    """Entries of an issue; unknown event dates come last."""
    e = t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey", F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("d"), "o_orderdate")
    e = views.placed(e, ["o_custkey"], views.entry_order(F.col("d"), F.lit(None), F.col("o_orderdate"), F.lit(None), F.col("id")))
    return e.select("id", F.col("place").cast("long").alias("place"))


@query("""
WITH m AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT c_custkey AS id, c_mktsegment AS tab, CAST(floor(c_acctbal) AS BIGINT) AS k, c_nationkey AS comments, c_custkey IN (SELECT id FROM m) AS is_read FROM customer)
SELECT id, is_read, CAST(row_number() OVER (PARTITION BY tab ORDER BY CAST(is_read AS INT), CASE WHEN tab = 'tagged' THEN comments ELSE k END DESC, id) AS BIGINT) AS place FROM p""")
def board_order(t):
    """The board: unread first, then by count; read marks join on the id or ``scope:id``."""
    p = t.customer.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("tab"), F.floor("c_acctbal").alias("k"), F.col("c_nationkey").alias("comments"), F.col("c_custkey").alias("n"))
    marks = t.orders.where("o_orderstatus = 'F'").select(F.concat(F.lit("scope:"), "o_custkey").alias("mark"))
    p = views.with_read_marks(p, marks, "id", "mark")
    p = views.placed(p, ["tab"], views.board_order(F.col("is_read"), F.col("tab"), F.col("k"), F.col("comments"), F.col("n")))
    return p.select(F.col("n").alias("id"), "is_read", F.col("place").cast("long").alias("place"))


@query("""
WITH p AS (SELECT c_custkey AS id, c_mktsegment AS category, c_nationkey % 2 = 0 AS tagged, c_acctbal > 0 AS has_media, c_nationkey AS k FROM customer)
SELECT id FROM p WHERE (NOT tagged OR has_media) AND (category <> 'BUILDING' OR k >= 10) AND id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND category = 'BUILDING'""")
def shown_posts(t):
    """Category, media and count filters, less the hidden ids."""
    humor = F.when(F.col("c_mktsegment") == "BUILDING", "humor").otherwise(F.col("c_mktsegment"))
    p = t.customer.select(F.col("c_custkey").alias("id"), humor.alias("category"), (F.col("c_nationkey") % 2 == 0).alias("tagged"), (F.col("c_acctbal") > 0).alias("has_media"), F.col("c_nationkey").alias("k_count"))
    hidden = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    return views.visible(views.in_category(views.showable(p), "category", "humor", ["humor"]), hidden, "id").select("id")


@query("""
SELECT l_orderkey AS story, l_suppkey AS url, CAST(pos AS BIGINT) AS pos, CAST(card AS BIGINT) AS card FROM (
 SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(rel AS INT) DESC, pos, l_suppkey) AS card FROM (SELECT l_orderkey, l_suppkey, max(l_linenumber) AS pos, max((l_linenumber, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END))[2] AS rel FROM lineitem GROUP BY 1, 2)) WHERE card <= 3""")
def source_cards(t):
    """At most three cards a story; the last of equal URLs wins, related ones come first."""
    s = t.lineitem.select(F.col("l_orderkey").alias("story"), F.col("l_suppkey").alias("url"), F.col("l_linenumber").cast("long").alias("pos"), (F.col("l_returnflag") == "A").alias("rel"))
    return views.cards(s, "story", "url", "pos", "rel").select("story", "url", "pos", F.col("card").cast("long").alias("card"))


@query("""
SELECT source, array_to_string(list(lang ORDER BY p), ',') AS themes FROM (SELECT source, lang, min(doc_id) AS p FROM documents GROUP BY 1, 2) GROUP BY source""")
def themes(t):
    """Distinct categories in first-seen order."""
    return views.themes(t.documents, "source", "doc_id", "lang").select("source", F.array_join("themes", ",").alias("themes"))


@query("""
SELECT l_orderkey AS id, CAST(max(l_linenumber) AS BIGINT) AS n_evidence_max, count(*) AS n_evidence, min(l_shipdate) IS NOT NULL AS has_head FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def exclusion_heads(t):
    """Excluded ids with their first evidence and its number."""
    l = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey")
    e = views.exclusions(l, "id", "l_linenumber", ["l_linenumber", "l_partkey"])
    most = l.groupBy("id").agg(F.max("l_linenumber").cast("long").alias("n_evidence_max"))
    return e.join(most, "id").select("id", "n_evidence_max", "n_evidence", F.col("head").isNotNull().alias("has_head"))


@query("""
SELECT CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS published, CAST(sum(CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS candidates, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS held,
 CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_observed, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_observed FROM orders""")
def report_counts(t):
    """Populations of a report and the range of observation times."""
    s = F.col("o_orderstatus")
    c = views.report_counts(t.orders, {"published": s == "F", "candidates": (s == "O") & (F.col("o_totalprice") > 100000), "held": s == "P"})
    r = views.observed_range(t.orders, "o_orderdate")
    return c.crossJoin(r).select("published", "candidates", "held", *(F.date_format(x, "yyyy-MM-dd").alias(x) for x in ("first_observed", "last_observed")))  # a row each


@query("""
SELECT l_partkey AS item, arg_max(l_orderkey, (o_orderdate, l_orderkey)) AS snapshot_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def item_snapshot(t):
    """The newest snapshot (by time, then id) that contains each item."""
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("snapshot_id")).agg(F.collect_set("l_partkey").alias("items"))
    taken = t.orders.select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("taken_at"))
    return views.holding_snapshot(s.join(taken, "snapshot_id"), "taken_at")


@query("""
WITH a AS (SELECT l_orderkey AS slot, l_linenumber AS n, l_partkey AS x FROM lineitem WHERE l_linenumber < 4), b AS (SELECT l_orderkey AS slot, l_linenumber AS n, l_suppkey AS y FROM lineitem WHERE l_linenumber > 1),
j AS (SELECT coalesce(a.slot, b.slot) AS slot, a.slot IS NOT NULL AND b.slot IS NOT NULL AS paired FROM (SELECT DISTINCT slot, n FROM a) a FULL JOIN (SELECT DISTINCT slot, n FROM b) b ON a.slot = b.slot AND a.n = b.n)
SELECT slot, count(*) AS n, bool_and(paired) AS aligned FROM j GROUP BY slot""")
def positional_review(t):
    """Reviewed rows against parsed rows by place; both sides must have the same places."""
    l = t.lineitem.select(F.col("l_orderkey").alias("slot"), F.col("l_linenumber").alias("n")).distinct()
    return views.positional(l.where("n < 4"), l.where("n > 1"), ["slot", "n"]).groupBy("slot").agg(F.count("*").alias("n"), F.bool_and("paired").alias("aligned"))


@query("""
SELECT p_partkey AS id, '/feed?date=2026-10-09&story=' || replace(p_name, ' ', '+') || CASE WHEN p_size % 2 = 0 THEN '&archive=1' ELSE '' END AS href,
 CASE WHEN p_size % 3 = 0 THEN 'denied' WHEN p_size % 3 = 1 THEN 'runtime' ELSE 'other' END AS failure, s_name IS NOT NULL AS enriched FROM part LEFT JOIN supplier ON s_suppkey = p_partkey""")
def links_and_failures(t):
    """Links with encoded parameters, failures by message, and an enriching lookup."""
    said = F.element_at(F.array(F.lit("403 Forbidden"), F.lit("request timeout"), F.lit("no such row")), F.col("p_size") % 3 + 1)
    p = t.part.withColumn("k", F.col("p_partkey"))
    p = views.enriched(p, t.supplier.select(F.col("s_suppkey").alias("k"), "s_name"), "k", "s_name")
    href = views.link("/feed", date=F.lit("2026-10-09"), story=F.col("p_name"), archive=F.when(F.col("p_size") % 2 == 0, F.lit("1")))
    return p.select(F.col("p_partkey").alias("id"), href.alias("href"), views.failure_kind(said).alias("failure"), F.col("s_name").isNotNull().alias("enriched"))
