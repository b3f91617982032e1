"""Queries on parsed sources, projections and the remaining scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text, times, urls
from tallyloom.operators import archive, counting, publication, views
from tallyloom.plans.registry import query
from tallyloom.sources import readers


@query("""
SELECT 'f' || c_nationkey AS file, '2026-10-12' AS date, CASE WHEN c_custkey % 2 = 0 THEN 'am' ELSE 'pm' END AS edition, 'record' AS kind, 'Record ' || c_custkey || ' continued' AS text, c_custkey * 10 + 2 AS line_start, c_custkey * 10 + 3 AS line_end FROM customer
UNION ALL SELECT 'f' || c_nationkey, '2026-10-12', CASE WHEN c_custkey % 2 = 0 THEN 'am' ELSE 'pm' END, 'watch', 'Watch ' || c_custkey, c_custkey * 10 + 6, c_custkey * 10 + 6 FROM customer""")
def archive_records(t):
    """Markdown archive lines to records and watch lists, with the lines they span."""
    k = F.col("c_custkey")
    half = F.when(k % 2 == 0, "오전").otherwise("저녁")
    written = [F.concat(F.lit("## 2026-10-12 "), half), F.concat(F.lit("- Record "), k), F.lit("    continued"), F.lit("stray"), F.lit("### 관찰"), F.concat(F.lit("-  Watch "), k), F.lit("# end"), F.lit("- outside")]
    lines = t.customer.select(F.concat(F.lit("f"), "c_nationkey").alias("file"), k.alias("k"), F.posexplode(F.array(*written)).alias("i", "line"))
    # The watch list opens a part of its own: here each is a second heading of the same edition.
    lines = lines.withColumn("line_no", F.col("k") * 10 + F.col("i") + 1)
    apart = lines.where("i not in (4)").unionAll(lines.where("i = 4").withColumn("line", F.concat(F.lit("## 2026-10-12 "), F.when(F.col("k") % 2 == 0, "오전").otherwise("저녁"))).withColumn("line_no", F.col("k") * 10 + 5))
    watch = lines.where("i = 4").select("file", "k", "i", F.lit("### 관찰").alias("line"), (F.col("k") * 10 + 5.5).alias("line_no"))
    out = readers.archive(apart.withColumn("line_no", F.col("line_no").cast("double")).unionAll(watch.withColumn("line_no", F.col("line_no").cast("double"))))
    return out.select("file", "date", "edition", "kind", "text", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


@query("""
SELECT s_suppkey AS page, CAST(n AS BIGINT) AS rank, 'owner/r' || n AS repo, CASE WHEN s_suppkey % 3 = 0 THEN CAST(1000 + n AS BIGINT) END AS stars FROM supplier, (SELECT unnest(generate_series(1, 10)) AS n)""")
def ranking_rows(t):
    """A trending page: the first ten places with a heading link, stars where they are stated."""
    article = lambda n, stars: F.concat(F.lit(f'<article><h2 class="x"><a href="/owner/r{n}">r</a></h2><span>'), F.when(stars, F.lit(f"1,{n:03d} stars today")).otherwise(F.lit("popular")), F.lit("</span></article>"))
    stated = F.col("s_suppkey") % 3 == 0
    page = F.concat(F.lit("<article>advert</article>"), *(article(n, stated) for n in range(1, 13)))
    return readers.ranking(t.supplier.select(F.col("s_suppkey").alias("page"), page.alias("html")), "page", "html").select("page", F.col("rank").cast("long").alias("rank"), "repo", F.col("stars_today").alias("stars"))


@query("""
SELECT o_custkey AS log, bool_or(o_orderstatus = 'P') OR NOT bool_or(o_orderstatus = 'F') AS failed FROM orders GROUP BY 1""")
def agent_logs(t):
    """Logs of agent events: failed on a failed event, or without a completion."""
    kind = F.when(F.col("o_orderstatus") == "P", "item.failed").when(F.col("o_orderstatus") == "F", "turn.completed").otherwise("item.completed")
    return readers.log_failed(t.orders.select(F.col("o_custkey").alias("log"), kind.alias("type")), "log")


@query("""
SELECT p_partkey AS id, 'image:' || CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '-' END || ',video:-,embed:-' AS media, p_size % 3 <> 0 AS aligned, CASE WHEN p_size % 3 = 0 THEN 3 ELSE 2 END AS places,
 CAST(CASE WHEN p_size % 4 = 0 THEN 6 WHEN p_size % 4 = 1 THEN 12 END AS BIGINT) AS source_total, 'e' || p_size || '/s' || p_partkey AS reference FROM part""")
def projections(t):
    """Media by type, lists side by side, totals of sources, references."""
    k, s = F.col("p_partkey"), F.col("p_size")
    medium = lambda kind: F.struct(F.lit(kind).alias("type"), F.lit("u").alias("url"), F.when((s % 2 == 0) | F.lit(kind != "image"), s).alias("width"), s.alias("height"), F.lit(True).alias("complete"))
    shown = F.array_join(F.transform(views.media(F.array(*map(medium, ("image", "video", "embed")))), lambda m: F.concat_ws(":", m["type"], F.coalesce(m["width"].cast("string"), F.lit("-")))), ",")
    parts = F.when(s % 4 == 0, F.array(*(F.struct(F.lit(n).alias("count")) for n in (2, 4)))).otherwise(F.array().cast("array<struct<count:int>>"))
    said = F.when(s % 4 == 1, "집계 총 12개").otherwise("집계")
    p = t.part.select(k.alias("id"), shown.alias("media"), F.array(F.lit("a"), F.lit("b")).alias("a"), F.when(s % 3 == 0, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2))).alias("b"), views.source_total(parts, said).alias("source_total"), publication.reference(F.concat(F.lit("e"), s), F.concat(F.lit("s"), k)).alias("r"))
    places = views.zipped(p, "id", "a", "b").groupBy("id").agg(F.bool_and("aligned").alias("aligned"), F.max("rank").alias("places"))
    return p.join(places, "id").select("id", "media", "aligned", "places", "source_total", F.concat_ws("/", "r.edition_id", "r.story_id").alias("reference"))


@query("""
WITH e AS (SELECT event_id AS k, date_trunc('second', ts) AS ts, event_id % 6 AS r FROM events)
SELECT k, CASE r WHEN 0 THEN ts - INTERVAL 30 SECOND WHEN 1 THEN ts - INTERVAL 5 MINUTE WHEN 2 THEN ts - INTERVAL 3 HOUR WHEN 3 THEN ts - INTERVAL 2 DAY WHEN 4 THEN ts - INTERVAL 28 DAY END AS since, ts - INTERVAL 9 HOUR AS listed, CASE WHEN r < 3 THEN ts END AS at, r <> 5 AS real FROM e""")
def age_scalars(t):
    """Relative ages, listed times as Korean, instants with an offset, real dates."""
    r, ts = F.col("event_id") % 6, F.date_trunc("second", F.col("ts").cast("timestamp"))
    age = F.element_at(F.array(*map(F.lit, ("30초 전", "5분 전", "3 시간 전", "2일 전", "1개월 전", "방금"))), (r + 1).cast("int"))
    wall = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    iso = F.concat(F.replace(wall, F.lit(" "), F.lit("T")), F.when(r == 0, "Z").when(r < 3, "+00:00").otherwise(""))
    day = F.when(r == 5, F.lit("2026-02-30")).otherwise(F.date_format(ts, "yyyy-MM-dd"))
    plain = lambda c: c.cast("timestamp_ntz")
    return t.events.select(F.col("event_id").alias("k"), plain(times.relative_age(age, ts)).alias("since"), plain(times.listed_time(F.concat(F.lit("등록 "), wall))).alias("listed"), plain(times.instant(iso)).alias("at"), times.real_date(day).isNotNull().alias("real"))


@query("""
WITH c AS (SELECT c_custkey AS k, c_name, c_custkey % 4 AS r FROM customer)
SELECT k, 'straße ' || lower(c_name) AS title, sha256('[["a","x"],["b","' || k || '"]]') AS facts, 'The rest' AS body, CASE WHEN r = 0 THEN 'Site A, Site B' END AS names, 'one|*two*| and |*three*' AS parts,
 CASE WHEN r = 0 THEN 'key phrase' ELSE 'Short lead.|3억원|5%' END AS phrases, CASE WHEN r = 1 THEN '인스타 https://instagram.com/p;X https://x.com/a' ELSE '' END AS links, r = 2 AS tagged FROM c""")
def title_parts(t):
    """Normal forms, fingerprints, source notes, emphasis, phrases, social links, tags."""
    k, r = F.col("c_custkey"), F.col("c_custkey") % 4
    note = F.concat(F.lit("[tag] The rest"), F.when(r == 0, F.lit(" 확인: Site A, Site B.")).otherwise(F.lit("")))
    parts = F.array_join(F.transform(text.emphasis_parts(F.concat(F.lit("one"), F.lit("two"), F.lit(" and "), F.lit("three")), ["two", "three"]), lambda p: F.when(p["bold"], F.concat(F.lit("*"), p["text"], F.lit("*"))).otherwise(p["text"])), "|")
    body = F.when(r == 0, F.lit("A key phrase. 3억원")).otherwise(F.lit("Short lead. It cost 3억원 and 5% more."))
    phrases = F.array_join(text.overview_phrases(body, F.array(F.lit("absent")), F.array(F.lit("key phrase"))), "|")
    links = F.array_join(F.transform(text.social_links(F.when(r == 1, F.lit("see instagram.com/p, https://x.com/a. and https://instagram.com/p")).otherwise(F.lit("see example.com"))), lambda x: F.concat_ws(" ", x["label"], x["url"])), ";")
    facts = F.create_map(F.lit("B"), k.cast("string"), F.lit("a!"), F.lit("X "))
    return t.customer.select(
        k.alias("k"), F.regexp_replace(text.normalize_title(F.concat(F.lit("STRASSE  "), "c_name")), "^strasse", "straße").alias("title"), text.fingerprint(facts).alias("facts"), text.bracket_prefix(note).alias("body"), text.source_names(note).alias("names"),
        parts.alias("parts"), phrases.alias("phrases"), links.alias("links"), text.has_tag(text.nfc(F.when(r == 2, F.lit("글 ㅇ​ㅎ")).otherwise(F.lit("ㅋㅇㅎ")))).alias("tagged"),
    )


@query("""
SELECT conv_id, count(*) >= 11 AS humour_ok, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) >= 2""")
def category_threshold(t):
    """The threshold of one category beside a general one."""
    c = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"))
    return counting.at_least(c, "n", 2).select("conv_id", (F.col("n") >= 11).alias("humour_ok"), "n")


@query("""
SELECT page_id, 'idx-' || page_id AS value, CASE WHEN page_id % 2 = 0 THEN 'true' END AS flag, page_id % 3 = 0 AS challenge FROM pages""")
def script_fields(t):
    """JSON values that a page's script assigns, and challenge pages."""
    k = F.col("page_id")
    page = F.concat(F.when(k % 3 == 0, F.lit("<title>Just a moment...</title>")).otherwise(F.lit("<title>Post</title>")), F.lit("\nNS.idx = \"idx-"), k, F.lit("\";\n"), F.when(k % 2 == 0, F.lit("NS.done = true;")).otherwise(F.lit("NS.done = {broken")))
    value = readers.assigned_json(page, F.lit("idx"))
    return t.pages.select("page_id", F.replace(value, F.lit('"'), F.lit("")).alias("value"), readers.assigned_json(page, F.lit("done")).alias("flag"), readers.is_challenge(page).alias("challenge"))


@query("""
SELECT event_id AS k, 'https://host.com/' || event_id || '?a=1' AS no_fragment, CASE WHEN event_id % 3 = 0 THEN '-' || event_id % 7 END AS bare FROM events""")
def url_scalars(t):
    """Fragments and bare ids."""
    k = F.col("event_id")
    return t.events.select(k.alias("k"), urls.without_fragment(F.concat(F.lit("https://host.com/"), k, F.lit("?a=1#x"))).alias("no_fragment"), F.when(k % 3 == 0, F.concat(F.lit("-"), urls.bare_identity(F.concat(F.lit("aagag_"), k % 7, F.lit("-3"))))).alias("bare"))


_NOTED = """SELECT CAST(conv_id AS VARCHAR) AS slot, conv_id * 100 + turn AS line_start, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal, 'k' || (conv_id + turn) % 9 AS issue_key, CASE (conv_id + turn) % 9 WHEN 4 THEN '웹툰 산업' ELSE 'c' || (conv_id + turn) % 3 END AS category,
 '[' || role || '] ' || text || ' ' || turn || '~' || conv_id || '명' || CASE WHEN turn % 2 = 0 THEN ' 확인: Site ' || conv_id || '.' ELSE '' END AS said, trim(text || ' ' || turn || '~' || conv_id || '명') AS clean FROM conversations"""


@query(f"""
WITH r AS ({_NOTED}), t AS (SELECT *, 'archive-' || lpad(CAST(ordinal AS VARCHAR), 2, '0') AS id, rtrim(CASE WHEN regexp_matches(clean, '^(?s).*?[.。][ \\n\\t\\r]') THEN regexp_extract(clean, '^(?s)(.*?[.。])[ \\n\\t\\r]', 1) ELSE clean END, '.') AS title FROM r WHERE issue_key <> 'k8')
SELECT slot, id, category, title, md5(clean) AS summary, turn_numbers AS emphasis, sources, lag(slot || '/' || id) OVER (PARTITION BY issue_key ORDER BY line_start) AS previous FROM (SELECT *, array_to_string(regexp_extract_all(clean, '[+−-]?\\d[\\d,.]*(?:~[\\d,.]+)?(?:%p|%|배|억원|조원|억달러|만달러|달러|원|명|건|곳|장|TB)')[1:6], ' ') AS turn_numbers, CASE WHEN contains(said, '확인:') THEN 'Site ' || slot ELSE '' END AS sources FROM t)""")
def archived_stories(t):
    """Stories of an archive's records by a reviewed map; records whose issue the map doesn't know have none."""
    k, n = F.col("conv_id"), F.col("turn")
    said = F.concat(F.lit("["), "role", F.lit("] "), "text", F.lit(" "), n, F.lit("~"), k, F.lit("명"), F.when(n % 2 == 0, F.concat(F.lit(" 확인: Site "), k, F.lit("."))).otherwise(""))
    records = t.conversations.select(k.cast("string").alias("slot"), said.alias("text"), (k * 100 + n).alias("line_start"), (k * 100 + n).alias("line_end"), F.concat(F.lit("k"), (k + n) % 9).alias("issue_key"))
    assigned = archive.numbered(records).select("slot", "ordinal", "issue_key")
    c = (k + n) % 9
    issues = t.conversations.select(F.concat(F.lit("k"), c).alias("issue_key"), F.concat(F.lit("i"), c).alias("issue_id"), F.concat(F.lit("Issue "), c).alias("issue_title"), F.when(c == 4, "웹툰 산업").otherwise(F.concat(F.lit("c"), (k + n) % 3)).alias("category"), F.lit("context").alias("context")).where("issue_key <> 'k8'").distinct()
    s = archive.stories(records.drop("issue_key"), assigned, issues)
    return s.select("slot", "id", "category", "title", F.md5(F.element_at("summary", 1)).alias("summary"), F.array_join("emphasis", " ").alias("emphasis"), F.array_join("archive.names", ",").alias("sources"), F.concat_ws("/", "previous.slot", "previous.story_id").alias("prev")).withColumn("previous", F.nullif("prev", F.lit(""))).drop("prev")
