"""Instants, windows and freshness as column expressions. ``now`` and cut-offs are arguments.

Instants are ``TIMESTAMP`` under a UTC session; wall clocks of the driver's tables
are ``TIMESTAMP_NTZ`` and stand for Korean local time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Seoul"
# Seconds in a unit of a relative age; a month counts 28 days.
AGE_UNITS = {"초": 1, "분": 60, "시간": 3600, "일": 86400, "개월": 28 * 86400, "년": 365 * 86400}


def instant(text: Column) -> Column:
    """ISO text with an offset to a TIMESTAMP; naive or malformed text gives null."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.try_to_timestamp(text))


def korean(ts: Column) -> Column:
    """Korean wall clock of an instant."""
    return F.from_utc_timestamp(ts, ZONE)


def fresh(published: Column, now: Column, hours: int = 24) -> Column:
    """``published <= now < published + hours``."""
    return (published <= now) & (now < published + F.expr(f"INTERVAL {hours} HOURS"))


def fresh_until(published: Column, expires: Column, now: Column) -> Column:
    """The reader's rule: fresh and not past the stored expiry."""
    return fresh(published, now) & (now < expires)


def first_given(*texts: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts))


def in_closed_window(t: Column, start: Column, end: Column) -> Column:
    """Both ends count; null where the time is unknown."""
    return t.between(start, end)


def age_between(t: Column, cutoff: Column, low_hours: int = 12, high_hours: int = 24) -> Column:
    """``low <= cutoff - t <= high``."""
    return t.between(cutoff - F.expr(f"INTERVAL {high_hours} HOURS"), cutoff - F.expr(f"INTERVAL {low_hours} HOURS"))


def freshness(published: Column, cutoff: Column, max_hours: int = 72) -> Column:
    """``current``, ``older`` (an earlier calendar day, needs a label), ``stale`` or ``future``."""
    return (
        F.when(published > cutoff, "future")
        .when(published < cutoff - F.expr(f"INTERVAL {max_hours} HOURS"), "stale")
        .when(F.to_date(published) < F.to_date(cutoff), "older")
        .otherwise("current")
    )


def date_wholly_before(day: Column, cutoff: Column) -> Column:
    """A date without a time counts only when its whole day is over."""
    return F.date_add(day, 1).cast("timestamp_ntz") <= cutoff


def verified_in_time(verified: Column, published: Column, generated: Column, cutoff: Column, single_run: bool) -> Column:
    """Source checked within 6 h before generation (and not before the cut-off in single-run mode), published by the cut-off."""
    ok = verified.between(generated - F.expr("INTERVAL 6 HOURS"), generated) & F.coalesce(published <= cutoff, F.lit(True))
    return ok & (verified >= cutoff) if single_run else ok


def all_before(dates: Column, cutoff: Column) -> Column:
    """Every known date of an array is at or before the cut-off."""
    return F.forall(F.filter(dates, lambda d: d.isNotNull()), lambda d: d <= cutoff)


def edition_window(t: Column) -> Column:
    """Half-open 12-hour window at 09:00 and 21:00 of a wall clock."""
    return F.window(t, "12 hours", startTime="9 hours")


def edition_label(end: Column) -> Column:
    """``YYYY-MM-DD-am`` or ``-pm`` from a window's end, 09:00 or 21:00."""
    return F.concat(F.date_format(end, "yyyy-MM-dd"), F.when(F.hour(end) == 9, F.lit("-am")).otherwise(F.lit("-pm")))


def deadline(edition: Column) -> Column:
    """Wall clock of an edition's end; null for a malformed key or a day that doesn't exist."""
    day = F.try_to_timestamp(F.regexp_extract(edition, r"^(\d{4}-\d{2}-\d{2})-(am|pm)$", 1), F.lit("yyyy-MM-dd"))
    hour = F.when(F.regexp_extract(edition, "-(am|pm)$", 1) == "am", F.expr("INTERVAL 9 HOURS")).otherwise(F.expr("INTERVAL 21 HOURS"))
    return (day + hour).cast("timestamp_ntz")


def run_allowed(t: Column) -> Column:
    """A run may start only in the hours of the two deadlines."""
    return F.hour(t).isin(9, 21)


def cutoff_time(day: Column, edition: Column, changed_on: str = "2026-10-07") -> Column:
    """The cut-off by contract version: 08:30 and 20:30 before the change, 09:00 and 21:00 since."""
    late = F.when(edition == "am", F.lit(9 * 60)).otherwise(F.lit(21 * 60))
    minutes = F.when(day >= F.lit(changed_on).cast("date"), late).otherwise(late - 30)
    return day.cast("timestamp_ntz") + F.make_dt_interval(mins=minutes)


def recency_score(published: Column, cutoff: Column, edition: Column) -> Column:
    """A step function of the publication time against the midnight of the cut-off's day."""
    midnight = F.date_trunc("day", cutoff).cast("timestamp_ntz")
    at = lambda text: midnight + F.expr(text)
    early = F.when(published >= midnight, 100).when(published >= at("INTERVAL -6 HOURS"), 82).when(published >= at("INTERVAL -24 HOURS"), 50).otherwise(25)
    late = F.when(published >= at("INTERVAL 12 HOURS"), 100).when(published >= at("INTERVAL 9 HOURS"), 85).when(published >= midnight, 50).otherwise(25)
    return F.when(edition == "am", early).otherwise(late)


def relative_age(text: Column, observed: Column) -> Column:
    """The latest instant that a rounded-down age can mean ("3시간 전")."""
    unit = F.regexp_extract(text, r"(\d+)\s*(초|분|시간|일|개월|년)\s*전", 2)
    n = F.try_to_number(F.nullif(F.regexp_extract(text, r"(\d+)\s*(초|분|시간|일|개월|년)\s*전", 1), F.lit("")), F.lit("999999999"))
    seconds = F.create_map(*(F.lit(x) for kv in AGE_UNITS.items() for x in kv))[unit]
    return F.timestamp_seconds(F.unix_timestamp(observed) - (n * seconds))


def listed_time(text: Column) -> Column:
    """The first ``YYYY-MM-DD HH:MM:SS`` in a text, as Korean time."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.nullif(F.regexp_extract(text, r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", 0), F.lit(""))), ZONE)


def real_date(text: Column) -> Column:
    """A calendar date in ISO form, null for 30 February and the like."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def age_label(t: Column, now: Column) -> Column:
    """Minutes below an hour, else hours."""
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(t)) / 60)
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("분 전"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("시간 전")))


def monitor_notice(state: Column, expected_by: Column, now: Column) -> Column:
    """``stopped`` before ``overdue`` before ``retrying``; null if all is well."""
    return F.when(state == "stopped", "stopped").when(now > expected_by, "overdue").when(state == "retrying", "retrying")
