"""Queries on event-time windows, freshness and lateness."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import times
from tallyloom.operators import counting, ordering, state
from tallyloom.plans.registry import query

_BUCKET = "time_bucket(INTERVAL 12 HOURS, ts, INTERVAL 9 HOURS)"
_END = f"{_BUCKET} + INTERVAL 12 HOURS"
_LABEL = f"strftime({_END}, '%Y-%m-%d') || CASE WHEN hour({_END}) = 9 THEN '-am' ELSE '-pm' END"
_NOW = "TIMESTAMP '2024-01-15 12:00:00'"


def _now():
    return F.expr("TIMESTAMP_NTZ'2024-01-15 12:00:00'")


def _labelled(events):
    return events.withColumn("edition", times.edition_label(times.edition_window(F.col("ts"))["end"]))


@query(f"""
WITH e AS (SELECT *, {_LABEL} AS edition FROM events)
SELECT edition, event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users, min(event_id) AS first_event,
  arg_max(event_id, struct_pack(v := value, i := -event_id)) AS top_event, max(value) AS top_value
FROM e GROUP BY edition, event_type""")
def edition_summary(t):
    """Flagship: events in 12-hour editions by type, with the top entry (value, then smaller id)."""
    top = F.max(F.struct("value", (-F.col("event_id")).alias("i")))
    g = _labelled(t.events).groupBy("edition", "event_type").agg(F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_users"), F.min("event_id").alias("first_event"), top.alias("top"))
    return g.select("edition", "event_type", "n_events", "n_users", "first_event", (-F.col("top.i")).alias("top_event"), F.col("top.value").alias("top_value"))


@query(f"""
SELECT event_id, CASE WHEN ts <= {_NOW} AND {_NOW} < ts + INTERVAL 24 HOURS THEN 1 ELSE 0 END AS fresh,
  CASE WHEN ts BETWEEN {_NOW} - INTERVAL 24 HOURS AND {_NOW} - INTERVAL 12 HOURS THEN 1 ELSE 0 END AS in_band,
  CASE WHEN ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND {_NOW} THEN 1 ELSE 0 END AS in_window,
  CASE WHEN ts > {_NOW} THEN 'future' WHEN ts < {_NOW} - INTERVAL 72 HOURS THEN 'stale' WHEN CAST(ts AS DATE) < DATE '2024-01-15' THEN 'older' ELSE 'current' END AS freshness,
  CASE WHEN ts <= {_NOW} AND {_NOW} < ts + INTERVAL 24 HOURS AND {_NOW} < ts + INTERVAL 20 HOURS THEN 1 ELSE 0 END AS readable
FROM events""")
def freshness_flags(t):
    """Three window rules that differ at their ends, and freshness by calendar day."""
    c, now = F.col("ts"), _now()
    return t.events.select(
        "event_id",
        times.fresh(c, now).cast("int").alias("fresh"),
        times.age_between(c, now).cast("int").alias("in_band"),
        times.in_closed_window(c, F.expr("TIMESTAMP_NTZ'2024-01-10 00:00:00'"), now).cast("int").alias("in_window"),
        times.freshness(c, now).alias("freshness"),
        times.fresh_until(c, c + F.expr("INTERVAL 20 HOURS"), now).cast("int").alias("readable"),
    )


@query(f"""
WITH w AS (SELECT CAST({_END} AS VARCHAR) AS window_end, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1),
a AS (SELECT CAST(x AS VARCHAR) AS window_end FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 09:00:00', TIMESTAMP '2024-01-31 21:00:00', INTERVAL 12 HOURS)) AS x))
SELECT a.window_end, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS empty_close FROM a LEFT JOIN w USING (window_end)""")
def every_window(t):
    """No window is skipped: windows without rows close empty."""
    w = t.events.where("event_type = 'error'").groupBy(times.edition_window(F.col("ts"))["end"].alias("window_end")).agg(F.count("*").alias("n"))
    filled = state.fill_windows(w, "2024-01-01 09:00:00", "2024-01-31 21:00:00")
    return filled.select(F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().cast("int").alias("empty_close"))


@query(f"""
WITH e AS (SELECT event_id, ts, {_LABEL} AS edition, ts + INTERVAL 1 HOUR * (event_id % 30) AS arrived FROM events),
x AS (SELECT *, strftime(time_bucket(INTERVAL 12 HOURS, arrived, INTERVAL 9 HOURS) + INTERVAL 12 HOURS, '%Y-%m-%d') || CASE WHEN hour(time_bucket(INTERVAL 12 HOURS, arrived, INTERVAL 9 HOURS) + INTERVAL 12 HOURS) = 9 THEN '-am' ELSE '-pm' END AS assigned FROM e)
SELECT assigned, count(*) AS n, sum(CASE WHEN assigned <> edition THEN 1 ELSE 0 END) AS n_late FROM x GROUP BY assigned""")
def late_rows(t):
    """Late rows go to the window that is open when they arrive; closed windows never change."""
    e = t.events.withColumn("arrived", F.col("ts") + F.make_dt_interval(hours=F.pmod("event_id", F.lit(30)).cast("int")))
    label = lambda c: times.edition_label(times.edition_window(F.col(c))["end"])
    # Spark allows one window expression in a projection: labels are made one after the other.
    x = e.withColumn("edition", label("ts")).withColumn("assigned", label("arrived"))
    return x.groupBy("assigned").agg(F.count("*").alias("n"), F.sum((F.col("assigned") != F.col("edition")).cast("int")).alias("n_late"))


@query(f"""
WITH x AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'am' ELSE 'pm' END AS edition, ts, date_trunc('day', {_NOW}) AS m FROM events)
SELECT event_id, CASE WHEN edition = 'am' THEN CASE WHEN ts >= m THEN 100 WHEN ts >= m - INTERVAL 6 HOURS THEN 82 WHEN ts >= m - INTERVAL 24 HOURS THEN 50 ELSE 25 END
  ELSE CASE WHEN ts >= m + INTERVAL 12 HOURS THEN 100 WHEN ts >= m + INTERVAL 9 HOURS THEN 85 WHEN ts >= m THEN 50 ELSE 25 END END AS recency,
  CASE WHEN hour(ts) IN (9, 21) THEN 1 ELSE 0 END AS run_allowed FROM x""")
def recency_steps(t):
    """Recency as a step function by edition; the hours in which a run may start."""
    x = t.events.withColumn("edition", F.when(F.col("event_id") % 2 == 0, "am").otherwise("pm"))
    return x.select("event_id", times.recency_score(F.col("ts"), _now(), F.col("edition")).alias("recency"), times.run_allowed(F.col("ts")).cast("int").alias("run_allowed"))


@query(f"""
WITH e AS (SELECT DISTINCT {_LABEL} AS edition FROM events)
SELECT edition, CAST(CAST(left(edition, 10) AS DATE) + INTERVAL 1 HOUR * (CASE WHEN edition LIKE '%am' THEN 9 ELSE 21 END) AS VARCHAR) AS deadline,
 CAST(CAST(left(edition, 10) AS DATE) + INTERVAL 1 MINUTE * (CASE WHEN edition LIKE '%am' THEN 540 ELSE 1260 END - CASE WHEN left(edition, 10) >= '2024-01-15' THEN 0 ELSE 30 END) AS VARCHAR) AS cutoff
FROM e""")
def edition_deadlines(t):
    """Deadline of each edition, and its cut-off by the contract of its day."""
    e = _labelled(t.events).select("edition").distinct()
    day, half = F.to_date(F.substring("edition", 1, 10)), F.substring("edition", 12, 2)
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return e.select("edition", fmt(times.deadline(F.col("edition"))).alias("deadline"), fmt(times.cutoff_time(day, half, "2024-01-15")).alias("cutoff"))


@query("""
SELECT user_id, sum(CASE WHEN ts < TIMESTAMP '2024-01-10 00:00:00' THEN 1 ELSE 0 END) AS n_before,
 sum(CASE WHEN ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' THEN 1 ELSE 0 END) AS n_within,
 sum(CASE WHEN ts > TIMESTAMP '2024-01-20 00:00:00' THEN 1 ELSE 0 END) AS n_after, 0 AS n_unknown FROM events GROUP BY user_id""")
def window_partitions(t):
    """Rows before, within and after a fixed window, per key."""
    return counting.window_partition(t.events, "user_id", "ts", F.expr("TIMESTAMP_NTZ'2024-01-10 00:00:00'"), F.expr("TIMESTAMP_NTZ'2024-01-20 00:00:00'"))


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts <= {_NOW})
SELECT user_id, event_id, event_type, value FROM r WHERE k = 1 AND {_NOW} < ts + INTERVAL 24 HOURS""")
def active_posts(t):
    """The rolling feed: the latest revision of each key, if it is within its day."""
    log = t.events.where(F.col("ts") <= _now())
    return state.active(log, "user_id", ["ts", "event_id"], "ts", _now()).select("user_id", "event_id", "event_type", "value")


@query(f"""
WITH e AS (SELECT DISTINCT {_LABEL} AS edition FROM events)
SELECT edition, lag(edition) OVER (ORDER BY edition) AS before, lead(edition) OVER (ORDER BY edition) AS after FROM e""")
def available_editions(t):
    """Previous and next available edition of each."""
    e = _labelled(t.events).select("edition").distinct().withColumn("one", F.lit(1))
    return ordering.neighbours(e, "one", ["edition"], "edition").drop("one")
