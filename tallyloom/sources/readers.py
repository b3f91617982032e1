"""Sources: JSON editions, Markdown archives, pages, comments, rankings, event logs."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import text

STORY = "id string, topicKey string, category string, title string, summary array<string>, publishedAt string, url string"
EDITION = f"id string, date string, edition string, cutoffAt string, archive boolean, stories array<struct<{STORY.replace(' string', ':string').replace(' array<string>', ':array<string>')}>>"


def editions(spark: SparkSession, path: str, schema: str = EDITION) -> DataFrame:
    """Edition documents below a path, with the file each came from."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("file", F.col("_metadata.file_path"))


def stories(edition_rows: DataFrame) -> DataFrame:
    """One row per story, with its place."""
    return edition_rows.select(F.col("id").alias("edition_id"), "date", "edition", F.posexplode("stories").alias("pos", "story")).select("edition_id", "date", "edition", "pos", "story.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): a text file is read whole, so that line numbers hold."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("i", "line"))
    return whole.select("file", (F.col("i") + 1).alias("line_no"), "line")


def archive(lines: DataFrame, file: str = "file") -> DataFrame:
    """Markdown archive lines to records (date, edition, kind, text, first and last line).

    ``## date 오전|저녁`` opens an edition, ``###`` its watch list, ``# `` closes it; ``-`` opens
    a record, four spaces continue one. Running sums over a file's lines give the groups.
    """
    heading = r"^## (\d{4}-\d{2}-\d{2}) (오전|저녁)$"
    line = F.col("line")
    opens, closes = line.rlike(heading), line.rlike("^# ")
    w = Window.partitionBy(file).orderBy("line_no")
    rows = lines.withColumns({"_ed": F.sum((opens | closes).cast("int")).over(w), "_open": F.when(opens, F.regexp_extract(line, heading, 1)), "_half": F.when(opens, F.regexp_extract(line, heading, 2))})
    e = Window.partitionBy(file, "_ed").orderBy("line_no")
    rows = rows.withColumns({"date": F.first("_open").over(e), "half": F.first("_half").over(e), "_watch": F.coalesce(F.max(line.rlike("^### ").cast("int")).over(e), F.lit(0))}).where(F.col("date").isNotNull())
    starts = line.rlike(r"^-\s+")
    rows = rows.withColumn("_rec", F.sum(starts.cast("int")).over(e))
    kept = rows.where(starts | (line.startswith("    ") & (F.col("_watch") == 0) & (F.col("_rec") > 0)))
    piece = F.replace(F.when(starts, F.regexp_replace(line, r"^-\s+", "")).otherwise(F.trim(line)), F.lit("\\"), F.lit(""))
    grouped = kept.select(file, "date", "half", "_ed", "_rec", "line_no", piece.alias("piece"), "_watch").groupBy(file, "date", "half", "_ed", "_rec")
    out = grouped.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "piece"))), lambda s: s["piece"]), " ").alias("text"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.min("_watch").alias("watch"))
    return out.select(file, "date", F.when(F.col("half") == "오전", "am").otherwise("pm").alias("edition"), F.when(F.col("watch") == 1, "watch").otherwise("record").alias("kind"), "text", "line_start", "line_end")


# Elements without content, and elements whose text isn't shown.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
UNSEEN = ("script", "style")


class _Text(HTMLParser):
    """Visible text of a page: scripts, styles and hidden elements are skipped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append((tag, tag in UNSEEN or any(k == "hidden" for k, _ in attrs) or any(s for _, s in self.open[-1:])))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if not (self.open and self.open[-1][1]):
            self.out.append(data)


# Row by row, so that no more pages are held than the 100 that Spark pickles at once.
@F.udf(T.StringType(), useArrow=False)
def visible_text(source):
    """Text of a page as a reader sees it, white space collapsed."""
    if source is None:
        return None
    p = _Text()
    p.feed(source)
    p.close()
    return " ".join("".join(p.out).split())


def page_title(page: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


# Titles of pages that ask for proof.
CHALLENGE_TITLES = r"(?i)just a moment|attention required|access denied|captcha|verify.*human|403 forbidden"


def is_challenge(page: Column, header: Column | None = None) -> Column:
    """A page that asks for proof in place of its content, by its title or by the answer's ``cf-mitigated`` header."""
    said = F.coalesce(page_title(page).rlike(CHALLENGE_TITLES), F.lit(False))
    return said if header is None else said | F.coalesce(F.lower(header) == "challenge", F.lit(False))


def links(page: Column) -> Column:
    """Targets of a page's links, in order, repeats dropped."""
    return F.array_distinct(F.regexp_extract_all(page, F.lit(r"(?i)<a\s[^>]*?href=\"([^\"]*)\""), F.lit(1)))


def listing(pages: DataFrame, row_id: str, html: str) -> DataFrame:
    """(page, pos, href, text) of a listing's links, the first of each href."""
    found = pages.select(row_id, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)(<a\s[^>]*?href=\"[^\"]*\"[^>]*>.*?</a>)"), F.lit(1))).alias("pos", "a"))
    rows = found.select(row_id, "pos", F.regexp_extract("a", r"(?i)href=\"([^\"]*)\"", 1).alias("href"), F.regexp_replace("a", r"<[^>]+>", "").alias("text"))
    return rows.groupBy(row_id, "href").agg(F.min("pos").alias("pos"), F.min_by("text", "pos").alias("text"))


@F.pandas_udf(T.StringType())
def assigned_json(source: pd.Series, name: pd.Series) -> pd.Series:
    """The JSON value that a page's script assigns to ``NAMESPACE.name``; null if there is none."""
    import re

    def one(text, field):
        found = re.search(r"^\s*\w+\." + re.escape(field) + r"\s*=\s*", text or "", re.M)
        if not found:
            return None
        try:
            value, _ = json.JSONDecoder().raw_decode(text[found.end() :])
        except ValueError:
            return None
        return json.dumps(value, ensure_ascii=False)

    return pd.Series([one(t, f) for t, f in zip(source, name)])


COMMENTS = "mode string, total long, comment array<struct<w_idx:string,w_content:string,w_mb_id:string>>"


def comments(answers: DataFrame, post: str, body: str) -> DataFrame:
    """Comment rows (post, cid, text, total) of API answers; rows that need verification are marked, not dropped."""
    d = answers.select(post, F.from_json(body, COMMENTS).alias("d")).select(post, "d.mode", "d.total", F.explode_outer("d.comment").alias("c"))
    bad = (F.col("mode") != "success") | F.col("total").isNull() | ~F.coalesce(F.col("c.w_idx").rlike(r"^\d+$"), F.lit(True)) | F.col("c.w_mb_id").isin("delete", "■system■")
    return d.select(post, F.col("c.w_idx").alias("cid"), F.col("c.w_content").alias("text"), "total", F.coalesce(bad, F.lit(False)).alias("needs_verification"))


def reconciled(rows: DataFrame, post: str, letter: str = "ㅋ") -> DataFrame:
    """(post, verdict, n_comments, reported, k_count) of :func:`comments` rows, markup left out of the count.

    ``deleted`` (a deleted or system row, or an answer that failed), ``conflict`` (an id with two counts) and ``incomplete`` (ids
    and total differ) are errors without a count; only ``ok`` has one.
    """
    n = text.literal_count(visible_text(F.coalesce("text", F.lit(""))), letter).cast("long")
    per = rows.withColumn("n", n).groupBy(post, "cid").agg(F.min("n").alias("n"), (F.min("n") != F.max("n")).alias("differs"), F.max("total").alias("total"), F.max("needs_verification").alias("bad"))
    out = per.groupBy(post).agg(F.count("cid").alias("n_comments"), F.max("total").alias("reported"), F.max("differs").alias("differs"), F.max("bad").alias("bad"), F.sum(F.when(F.col("cid").isNotNull(), F.col("n")).otherwise(0)).alias("k"))
    verdict = F.when(F.col("bad"), "deleted").when(F.col("differs"), "conflict").when(~F.coalesce(F.col("n_comments") == F.col("reported"), F.lit(False)), "incomplete").otherwise("ok")
    return out.select(post, verdict.alias("verdict"), "n_comments", "reported", F.when(verdict == "ok", F.col("k")).alias("k_count"))


def article(pages: DataFrame, row_id: str, html: str) -> DataFrame:
    """(row, title, number, published_at) of article pages: the head's title, else the script's; the script's epoch. What isn't there is null."""
    own = F.nullif(F.regexp_extract(html, r'(?is)<meta\s[^>]*property="og:title"[^>]*content="([^"]*)"', 1), F.lit(""))
    assigned = lambda name: assigned_json(F.col(html), F.lit(name))
    named = F.get_json_object(F.concat(F.lit('{"v":'), assigned("title"), F.lit("}")), "$.v")
    epoch = F.expr("try_cast(_otime AS double)")
    return pages.withColumn("_otime", assigned("otime")).select(row_id, F.coalesce(own, named).alias("title"), assigned("idx").alias("number"), F.timestamp_seconds(epoch).alias("published_at"))


def ranking(pages: DataFrame, row_id: str, html: str, most: int = 10) -> DataFrame:
    """(page, rank, repo, stars_today) of a trending page's articles that have a heading link."""
    a = pages.select(row_id, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?s)(<article\b.*?</article>)"), F.lit(1))).alias("pos", "a"))
    heading = F.regexp_extract("a", r"(?s)<h2\b.*?</h2>", 0)
    repo = F.nullif(F.regexp_extract(heading, r'href="/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)"', 1), F.lit(""))
    stars = F.nullif(F.replace(F.regexp_extract(F.regexp_replace("a", r"<[^>]+>", " "), r"([\d,]+)\s+stars?\s+today", 1), F.lit(","), F.lit("")), F.lit(""))
    rows = a.select(row_id, "pos", repo.alias("repo"), stars.cast("long").alias("stars_today")).where(F.col("repo").isNotNull())
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(row_id).orderBy("pos"))).where(F.col("rank") <= most).drop("pos")


def agent_events(spark: SparkSession, path: str) -> DataFrame:
    """Typed events of a JSON-lines log; a malformed line is a null type."""
    return spark.read.schema("type string, item struct<type:string,text:string,status:string>, usage map<string,long>").json(path)


def log_failed(events: DataFrame, *by: str) -> DataFrame:
    """One row (a log): did the log fail (a failed event, or no completion)."""
    bad, done = F.bool_or(F.col("type").rlike(r"(^|\.)(failed|error)$")), F.bool_or(F.col("type") == "turn.completed")
    failed = (F.coalesce(bad, F.lit(False)) | ~F.coalesce(done, F.lit(False))).alias("failed")
    return events.groupBy(*by).agg(failed) if by else events.agg(failed)
