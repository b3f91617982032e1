"""Read-side views: projections, display orders, filters, lookups and report counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edition_order(date: Column, edition: Column, archive: Column, row_id: Column) -> list[Column]:
    """Date, half of the day, archive first, id."""
    return [date, edition, (~archive).cast("int"), row_id]


def entry_order(event_date: Column, event_at: Column, covered: Column, edition: Column, row_id: Column) -> list[Column]:
    """Unknown event dates last, then date, time, coverage, edition and id."""
    return [event_date.asc_nulls_last(), event_at.asc_nulls_last(), covered, edition, row_id]


def feed_order(published: Column, row_id: Column, displayed: bool) -> list[Column]:
    """Newest first; ties by id, descending as stored and ascending as displayed."""
    return [published.desc(), row_id.asc() if displayed else row_id.desc()]


def board_order(is_read: Column, tab: Column, k_count: Column, comments: Column, pos: Column) -> list[Column]:
    """Unread first, then the count of the tab, descending; ties keep their place."""
    return [is_read.cast("int"), F.when(tab == "tagged", comments).otherwise(k_count).desc(), pos]


def placed(df: DataFrame, within: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """Each row's place in an order within a group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))


def index_rows(editions: DataFrame) -> DataFrame:
    """Edition index: stories, path and headline."""
    path = F.concat(F.when(F.col("archive"), F.lit("archive/")).otherwise(F.lit("")), F.col("date"), F.lit("/"), F.col("edition"), F.lit(".json"))
    return editions.select("id", F.size("stories").alias("n_stories"), path.alias("path"), F.try_element_at("stories", F.lit(1))["title"].alias("headline"))


def media(items: Column) -> Column:
    """Media in order, projected by type: an image keeps its size, a video its completeness, an embed its URL only."""
    return F.transform(
        items,
        lambda m: F.struct(
            m["type"].alias("type"),
            m["url"].alias("url"),
            F.when(m["type"] == "image", m["width"]).alias("width"),
            F.when(m["type"] == "image", m["height"]).alias("height"),
            F.when(m["type"] == "video", m["complete"]).alias("complete"),
        ),
    )


def zipped(df: DataFrame, key: str, *lists: str) -> DataFrame:
    """Lists of one row side by side with their rank; ``aligned`` is false where their lengths differ."""
    same = F.lit(True)
    for name in lists[1:]:
        same = same & (F.size(name) == F.size(lists[0]))
    return df.select(key, same.alias("aligned"), F.posexplode(F.arrays_zip(*lists)).alias("pos", "z")).select(key, "aligned", (F.col("pos") + 1).alias("rank"), *(F.col(f"z.{n}").alias(n) for n in lists))


def without(df: DataFrame, *owned: str) -> DataFrame:
    """Drop columns that the publisher owns."""
    return df.drop(*owned)


def registry(items: DataFrame) -> DataFrame:
    """Identity and revision only."""
    return items.select("id", "topic", "revision")


def compact_history(editions: DataFrame, order: str, keys: list[str], n: int = 6) -> DataFrame:
    """Selected keys of the last n editions."""
    return editions.orderBy(F.col(order).desc()).limit(n).select(*keys)


def in_category(df: DataFrame, column: str, wanted: str, known: list[str]) -> DataFrame:
    """Rows of a category; ``all`` passes everything, an unknown one nothing."""
    return df if wanted == "all" else df.where((F.col(column) == wanted) & F.lit(wanted in known))


def showable(df: DataFrame, least: int = 10) -> DataFrame:
    """Tagged posts need media; humour needs the count."""
    return df.where((~F.col("tagged") | F.col("has_media")) & ((F.col("category") != "humor") | (F.col("k_count") >= least)))


def visible(posts: DataFrame, hidden: DataFrame, key: str) -> DataFrame:
    """Posts that aren't hidden."""
    return posts.join(hidden.select(key), key, "left_anti")


def with_read_marks(posts: DataFrame, marks: DataFrame, post_id: str, mark_id: str) -> DataFrame:
    """``is_read`` where a mark is the post's id or ``scope:id``, with one colon; both are one key, so an equi-join does."""
    own = F.regexp_extract(mark_id, r"^(?:[^:]*:)?([^:]+)$", 1)
    m = marks.select(own.alias(post_id)).distinct().withColumn("is_read", F.lit(True))
    return posts.join(m, post_id, "left").withColumn("is_read", F.coalesce("is_read", F.lit(False)))


def recent_marks(marks: DataFrame, order: str, n: int = 2000) -> DataFrame:
    """The most recent marks."""
    return marks.orderBy(F.col(order).desc()).limit(n)


def holding_snapshot(snapshots: DataFrame, at: str, item: str = "item") -> DataFrame:
    """For each item the first snapshot, newest first (ties: greatest id), that contains it."""
    rows = snapshots.select("snapshot_id", at, F.explode("items").alias(item))
    return rows.groupBy(item).agg(F.max_by("snapshot_id", F.struct(at, "snapshot_id")).alias("snapshot_id"))


def related(df: DataFrame, links: str, sources: str) -> Column:
    """Links that aren't among the sources."""
    return F.array_except(links, sources)


def enriched(rows: DataFrame, by: DataFrame, on: str, column: str) -> DataFrame:
    """Rows with one attribute of a lookup table, null without a match."""
    return rows.join(by.select(on, column).dropDuplicates([on]), on, "left")


def own_links(rows: DataFrame, captured: DataFrame, key: str, host: Column, aggregator: str) -> DataFrame:
    """Captured original links of each row whose host isn't the aggregator's."""
    return rows.join(captured.where(~(host == aggregator) & ~host.endswith("." + aggregator)), key, "left")


def positional(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Reviewed rows joined to parsed rows by place, with rows that only one side has marked."""
    return left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), keys, "full").withColumn("paired", F.col("_l").isNotNull() & F.col("_r").isNotNull()).drop("_l", "_r")


def cards(sources: DataFrame, story: str, url: str, pos: str, related_first: str, most: int = 3) -> DataFrame:
    """At most three source cards a story: the last of equal URLs (at one place, one with related data), rows with related data first."""
    last = sources.groupBy(story, url).agg(F.max(F.struct(pos, related_first)).alias("s")).select(story, url, "s.*")
    return placed(last, [story], [F.col(related_first).cast("int").desc(), F.col(pos), F.col(url)], "card").where(F.col("card") <= most)


def source_total(breakdown: Column, text: Column) -> Column:
    """Sum of a breakdown's counts, else the total that the text states."""
    total = F.aggregate(F.transform(breakdown, lambda b: b["count"]), F.lit(0).cast("long"), lambda a, x: a + x)
    stated = F.nullif(F.regexp_extract(text, r"총 (\d+)개", 1), F.lit("")).cast("long")
    return F.when(F.size(breakdown) > 0, total).otherwise(stated)


def report_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Population counters of a report, one row, with the range of observation times if there is one."""
    return df.agg(*(F.count_if(c).alias(n) for n, c in conditions.items()))


def observed_range(df: DataFrame, t: str) -> DataFrame:
    return df.agg(F.min(t).alias("first_observed"), F.max(t).alias("last_observed"))


def exclusions(listed: DataFrame, key: str, order: str, evidence: list[str]) -> DataFrame:
    """Excluded listings by id: the first is the head, their number is kept; evidence rows stay in the source table."""
    return listed.groupBy(key).agg(F.min_by(F.struct(*evidence), order).alias("head"), F.count("*").alias("n_evidence"))


def themes(df: DataFrame, within: str, pos: str, category: str) -> DataFrame:
    """Distinct categories in first-seen order."""
    first = df.groupBy(within, category).agg(F.min(pos).alias("p"))
    return first.groupBy(within).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", category))), lambda s: s[category]).alias("themes"))


def edition_path(date: Column, edition: Column, archive: Column) -> Column:
    return F.concat(F.when(archive, F.lit("archive/")).otherwise(F.lit("")), date, F.lit("/"), edition, F.lit(".json"))


def link(path: str, **params: Column) -> Column:
    """A path with encoded parameters; a null parameter is left out."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), F.url_encode(v))) for k, v in params.items()]
    return F.concat(F.lit(path + "?"), F.concat_ws("&", *parts))


def outside_header(status: Column, row_id: Column, title: Column, observed: Column, listed: Column, url_id: Column, start, end) -> Column:
    """An out-of-window header counts only with all its evidence, and only if the listed time is outside."""
    return F.coalesce((status == "outside_window") & (row_id != "") & (F.trim(title) != "") & observed.isNotNull() & ~listed.between(start, end) & (url_id == F.regexp_replace(row_id, r"[_-]\d+$", "")), F.lit(False))


def failure_kind(message: Column) -> Column:
    """A failed step by its message: ``denied``, ``runtime`` or ``other``."""
    return F.when(message.rlike("(?i)denied|forbidden|blocked|captcha|40[13]"), "denied").when(message.rlike("(?i)timeout|disconnected|crash|unavailable"), "runtime").otherwise("other")
