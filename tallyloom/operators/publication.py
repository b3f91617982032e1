"""Publishing: stamped drafts, planned batches, derived files, and proof that what was delivered is what was planned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text, times, urls
from tallyloom.operators import state


def stamped(brief: DataFrame, edition: str, generated: Column, verified: Column) -> DataFrame:
    """A draft with its identity, cut-off and times set: ``edition`` (date and half), and ``verified_at`` of every source of its stories.

    ``brief`` has stories, an array of structs with ``sources`` and ``related``, arrays of structs. What the draft says of
    these fields itself is replaced; an update time of its own is dropped.
    """
    day, half = edition[:10], edition[11:]
    seen = lambda sources: F.transform(sources, lambda s: s.withField("verified_at", verified))
    stories = F.transform("stories", lambda s: s.withField("sources", seen(s["sources"])).withField("related", seen(s["related"])))
    fixed = {"version": F.lit(1), "id": F.lit(edition), "date": F.lit(day), "edition": F.lit(half), "zone": F.lit(times.ZONE), "cutoff_at": times.deadline(F.lit(edition)), "generated_at": generated, "stories": stories}
    return brief.drop("updated_at").withColumns(fixed)


def shares_url(a: Column, b: Column) -> Column:
    """Do two lists of URLs have one in common, by their canonical form."""
    canonical = lambda x: F.array_compact(F.transform(x, urls.canonical_ordered))
    return F.coalesce(F.arrays_overlap(canonical(a), canonical(b)), F.lit(False))


def evidence_urls(calls: Column) -> Column:
    """Distinct URLs of a response's items (type, status, url, searched, cited): completed reads, searches and citations."""
    read = F.transform(F.filter(calls, lambda c: (c["type"] == "read") & (c["status"] == "completed")), lambda c: c["url"])
    more = F.flatten(F.transform(calls, lambda c: F.concat(F.coalesce(F.when(c["type"] == "search", c["searched"]), F.array().cast("array<string>")), F.coalesce(c["cited"], F.array().cast("array<string>")))))
    return F.array_sort(F.filter(F.array_distinct(F.concat(read, more)), lambda u: u.isNotNull() & (u != "")))


def strings(value: Column) -> Column:
    """A JSON value as a list of strings: a string is a list of one, of a list only strings count, all else is none."""
    items = F.from_json(value, "array<string>", {"mode": "PERMISSIVE"})
    quoted = F.transform(F.from_json(value, "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING")
    texts = F.transform(F.filter(F.arrays_zip(items.alias("i"), quoted.alias("q")), lambda z: F.coalesce(z["q"], F.lit(False))), lambda z: z["i"])
    one = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    return F.when(value.startswith("["), texts).when(value.startswith('"'), F.array(one)).otherwise(F.array().cast("array<string>"))


def reference(edition_id: Column, story_id: Column) -> Column:
    return F.struct(edition_id.alias("edition_id"), story_id.alias("story_id"))


def index_counters(stories: DataFrame, updated: str) -> DataFrame:
    """One row: editions, stories, stories without an issue, and the last update."""
    return stories.agg(F.count_distinct("edition_id").alias("n_editions"), F.count("*").alias("n_stories"), F.count_if(F.col("issue_id").isNull()).alias("n_unlinked"), F.max(updated).alias("updated_at"))


def watch_items(editions: DataFrame, key: str, items: str, order: str) -> DataFrame:
    """(key, item) of watched items, each once, at its first edition's place: an aggregation of the exploded lists, not one list of all."""
    rows = editions.select(key, order, F.posexplode(items).alias("pos", "item")).where(F.trim("item") != "")
    return rows.groupBy(key, "item").agg(F.min(F.struct(order, "pos")).alias("first")).select(key, "item", F.col("first")[order].alias("first_seen"))


def anchor(value: Column) -> Column:
    """An instant written in UTC (``Z`` or ``+00:00``); any other offset, or none, is null."""
    return F.when(value.rlike(r"(Z|\+00:00)$"), times.instant(value))


def fixed_window(version: Column, start: Column, end: Column) -> Column:
    """A run's window (start, end): both in UTC and exactly 24 hours apart, version 1; else null."""
    a, b = anchor(start), anchor(end)
    ok = (F.coalesce(version, F.lit(1)) == 1) & (b == a + F.expr("INTERVAL 24 HOURS"))
    return F.when(ok, F.struct(a.alias("start"), b.alias("end")))


def unchanged_window(manifests: DataFrame, run: str) -> DataFrame:
    """(run, n, fixed): a run's window is anchored once; ``fixed`` if all its manifests have the same one."""
    w = fixed_window(F.col("version"), F.col("start"), F.col("end"))
    return manifests.select(run, w.alias("w")).groupBy(run).agg(F.count("*").alias("n"), (F.coalesce(F.min("w") == F.max("w"), F.lit(False)) & (F.count("w") == F.count("*"))).alias("fixed"))


def refreshed(raw: DataFrame, key: str, complete: str, at: str, derive) -> DataFrame:
    """Everything derived anew from the raw rows: the best row of each key, then ``derive``. It depends on no earlier result, nor on the rows' order."""
    from tallyloom.operators.observations import selected

    return derive(selected(raw, key, complete, at))


def plan(current: DataFrame, batch: DataFrame, log: DataFrame, violations: DataFrame, key: str, order: list[str], op_id: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """(next state, events to append) of one batch of commands.

    An operation that the log has already is a replay and changes nothing; one with another digest is a conflict. The batch
    joins the state only if it has neither conflicts nor violations. Each event keeps the row that it supersedes.
    """
    seen = log.groupBy(op_id).agg(F.min(digest).alias("_known"))
    marked = batch.join(seen, op_id, "left").withColumn("outcome", F.when(F.col("_known").isNull(), "new").when(F.col("_known") == F.col(digest), "replay").otherwise("conflict"))
    fresh = marked.where("outcome = 'new'").select(*batch.columns)
    clash = marked.where("outcome = 'conflict'").select(F.col(op_id).cast("string").alias("key"), F.lit("conflict").alias("rule"))
    problems = violations.select(F.col("key").cast("string").alias("key"), "rule").unionAll(clash)
    after = state.apply_batch(current, fresh.select(*current.columns), problems, key, order)
    before = current.select(F.col(key), F.struct(*current.columns).alias("superseded"))
    events = marked.join(before, key, "left").select(op_id, digest, key, "outcome", F.to_json(F.struct(*(c for c in batch.columns if c not in (op_id, digest)))).alias("payload"), "superseded")
    return after, events


def first_edition(published: DataFrame, windows: DataFrame, edition: str) -> DataFrame:
    """The plan of one publication: the open window of an edition that isn't published yet, with what it holds; none is a refusal."""
    return windows.where(F.col("edition_id") == edition).join(published.select("edition_id"), "edition_id", "left_anti")


def tree_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, sha256) of every file below a path: read by Spark, one row a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def combined_digest(digests: DataFrame, name: str = "path", digest: str = "sha256") -> DataFrame:
    """One digest of a tree from its files' names and digests, in whatever order they come."""
    line = digests.select(F.sha2(F.concat_ws(" ", name, digest), 256).alias("d"))
    return line.agg(F.count("*").alias("n"), *text.digest_sums(F.col("d"))).select(text.sums_digest("n").alias("sha256"))


def verified_lookup(refs: DataFrame, stored: DataFrame, key: str, digest: str, content: str) -> DataFrame:
    """References with what is stored under them: ``valid`` only if its bytes have the reference's digest."""
    found = stored.select(key, F.col(content), F.sha2(content, 256).alias("_actual"))
    return refs.join(found, key, "left").withColumn("valid", F.coalesce(F.col("_actual") == F.col(digest), F.lit(False))).drop("_actual")


def delivered(expected: DataFrame, public: DataFrame, index: DataFrame, receipts: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, same_bytes, listed, receipt) of each expected file of a delivery."""
    out = expected.join(public.select(key, F.col(digest).alias("_got")), key, "left")
    out = out.join(index.select(key).distinct().withColumn("_i", F.lit(True)), key, "left").join(receipts.select(key).distinct().withColumn("_r", F.lit(True)), key, "left")
    return out.select(key, F.coalesce(F.col("_got") == F.col(digest), F.lit(False)).alias("same_bytes"), F.coalesce("_i", F.lit(False)).alias("listed"), F.coalesce("_r", F.lit(False)).alias("receipt"))


def overlap_report(left: DataFrame, right: DataFrame, key: str, digest: str) -> DataFrame:
    """One row: keys in both, only left, only right, and those of both whose digests agree."""
    a, b = left.select(key, F.col(digest).alias("_a"), F.lit(1).alias("_l")), right.select(key, F.col(digest).alias("_b"), F.lit(1).alias("_r"))
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    j = a.join(b, key, "full")
    return j.agg(F.count_if(both).alias("n_both"), F.count_if(F.col("_r").isNull()).alias("n_left"), F.count_if(F.col("_l").isNull()).alias("n_right"), F.count_if(both & (F.col("_a") == F.col("_b"))).alias("n_agree"))
