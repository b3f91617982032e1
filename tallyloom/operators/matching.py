"""Joins by hand-made keys: history lookups, duplicates, as-of and range joins, work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import alike


def key_rows(df: DataFrame, row_id: str, keys: dict[str, Column]) -> DataFrame:
    """The multi-key index in long form: one (row, field, value) per distinct key of an array or scalar column."""
    arrays = F.array(*(F.struct(F.lit(f).alias("field"), c.cast("array<string>").alias("values")) for f, c in keys.items()))
    long = df.select(F.col(row_id).alias("row_id"), F.explode(arrays).alias("k")).select("row_id", "k.field", F.explode("k.values").alias("value"))
    return long.where(F.col("value").isNotNull() & (F.col("value") != "")).distinct()


def compare_history(candidates: DataFrame, history: DataFrame, identity_fields: list[str]) -> DataFrame:
    """All history rows that share any key with a candidate: one equi-join on (field, value) in place of an OR of conditions.

    Both sides are :func:`key_rows`. ``same`` is true where an identity key matched; other
    keys (titles, media) only flag.
    """
    h = history.select(F.col("row_id").alias("history_id"), "field", "value")
    return (
        candidates.join(h, ["field", "value"])
        .groupBy("row_id", "history_id")
        .agg(F.array_sort(F.collect_set("field")).alias("fields"), F.max(F.col("field").isin(*identity_fields)).alias("same"))
    )


def annotate(rows: DataFrame, row_id: str, matches: DataFrame) -> DataFrame:
    """Every input row with its overlap counts; rows without a match stay."""
    per = matches.groupBy("row_id").agg(F.count("*").alias("n_matches"), F.count_if("same").alias("n_same"))
    out = rows.join(per.withColumnRenamed("row_id", row_id), row_id, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_matches", "n_same")})


#: Keys that may be held as heavy, and how many the sketch that finds them follows.
HEAVY_KEYS, TRACKED_KEYS = 256, 10_000


def overlap_counts(candidates: DataFrame, history: DataFrame, identity_fields: list[str], heavy_from: int = 10_000) -> DataFrame:
    """(row_id, n_matches, n_same): what :func:`annotate` counts of :func:`compare_history`, without a pair for a key that many rows share.

    Keys that some ``heavy_from`` history rows or more have, ``HEAVY_KEYS`` of them at most, are found by a frequent-items sketch. History rows with equal
    sets of heavy keys are one class with a size, and so are candidates; classes that share a heavy key match as a whole. Other keys are joined row by row, and a pair
    whose classes match already isn't counted twice. The sketch only decides which way a key goes, so a key that it misses or misjudges changes no count.
    """
    key = F.concat("field", F.lit("\0"), "value")
    top = history.agg(F.expr(f"approx_top_k(concat(field, '\\0', value), {HEAVY_KEYS}, {TRACKED_KEYS})").alias("top"))
    heavy = F.broadcast(top.select(F.inline("top")).where(F.col("count") >= heavy_from).select(F.col("item").alias("key"), F.lit(True).alias("heavy")))  # HEAVY_KEYS rows at most
    marked = lambda t: t.select("row_id", "field", "value", key.alias("key"), F.col("field").isin(*identity_fields).alias("identity")).join(heavy, "key", "left")
    c, h = marked(candidates), marked(history)
    # A row's heavy keys: HEAVY_KEYS at most.
    sets = lambda t: t.where("heavy").groupBy("row_id").agg(F.array_sort(F.collect_set("key")).alias("keys"), F.array_sort(F.collect_set(F.when(F.col("identity"), F.col("key")))).alias("identities"))
    cs, hs = sets(c), sets(h)
    asks, holds = cs.select("keys", "identities").distinct(), hs.groupBy("keys", "identities").agg(F.count("*").alias("n"))
    met = asks.select(F.col("keys").alias("ask"), F.col("identities").alias("ask_id"), F.explode("keys").alias("key")).join(holds.select(F.col("keys").alias("hold"), F.col("identities").alias("hold_id"), "n", F.explode("keys").alias("key")), "key")
    met = met.groupBy("ask", "hold").agg(F.max("n").alias("n"), F.max(F.arrays_overlap("ask_id", "hold_id")).alias("same"))
    by_class = met.groupBy("ask").agg(F.sum("n").alias("n_matches"), F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("n_same"))
    whole = cs.join(by_class, F.col("keys") == F.col("ask")).select("row_id", "n_matches", "n_same")

    light = lambda t: t.where("heavy IS NULL")
    pairs = light(c).join(light(h).select(F.col("row_id").alias("history_id"), "key"), "key").groupBy("row_id", "history_id").agg(F.max("identity").alias("same"))
    none = F.array().cast("array<string>")
    own = cs.select("row_id", F.col("keys").alias("ask"), F.col("identities").alias("ask_id"))
    theirs = hs.select(F.col("row_id").alias("history_id"), F.col("keys").alias("hold"), F.col("identities").alias("hold_id"))
    pairs = pairs.join(own, "row_id", "left").join(theirs, "history_id", "left").withColumns({n: F.coalesce(n, none) for n in ("ask", "ask_id", "hold", "hold_id")})
    fresh, fresh_same = ~F.arrays_overlap("ask", "hold"), F.col("same") & ~F.arrays_overlap("ask_id", "hold_id")
    single = pairs.groupBy("row_id").agg(F.count_if(fresh).alias("n_matches"), F.count_if(fresh_same).alias("n_same"))
    return whole.unionByName(single).groupBy("row_id").agg(F.sum("n_matches").alias("n_matches"), F.sum("n_same").alias("n_same"))


def equal_pairs(df: DataFrame, row_id: str, pos: str, within: list[str], keys: list[str]) -> DataFrame:
    """Earlier and later rows of a group that share a key: an aggregation and a join per key, united. A null key matches nothing.

    Pairs are with the first row of the key only, so a key with many rows gives one pair a row.
    """
    parts = []
    for key in keys:
        known = df.where(F.col(key).isNotNull())
        first = known.groupBy(*within, key).agg(F.min_by(row_id, pos).alias("earlier"))
        parts.append(known.join(first, [*within, key]).select(F.col(row_id).alias("later"), "earlier", F.lit(key).alias("reason")).where("earlier <> later"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("earlier", "later").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


#: Common tokens that a pair must have among the rarest of both sides; more tokens go into the join, fewer pairs come out.
RARE_COMMON = 12


def _titles(df: DataFrame, c: str) -> DataFrame:
    """(id, t, size) of the distinct texts of a column."""
    return df.select(F.col(c).alias("t")).where(F.col("t").isNotNull()).distinct().select(F.md5("t").alias("id"), "t", F.length("t").alias("size"))


def _tokens(titles: DataFrame, least: float) -> DataFrame:
    """(id, size, q, n, need, gram, pos): the q-grams of texts, ``need`` of which any text must share in place that is ``least`` alike.

    A pair of ``s`` characters together has at least ``M = least * s / 2`` of them matched, in at most ``1 + s - 2 * M`` runs, so it has ``3 * M
    - s - 1`` pairs of neighbours in common. Where a text is so short that this is nothing, single characters are taken: M are common.
    """
    smallest = F.col("size") * 2 / (2 - least)  # of both texts together: the shorter has all its characters matched
    pairs = F.ceil((1.5 * least - 1) * smallest - 1 - 1e-9).cast("int")
    sized = titles.where("size > 0").withColumn("q", F.when(pairs >= 1, 2).otherwise(1)).withColumn("need", F.when(pairs >= 1, pairs).otherwise(F.ceil(least * smallest / 2 - 1e-9).cast("int")))
    # A pair may have one text of either kind; the shorter kind's tokens must then be there for both.
    longest_short = F.lit(2 / (1.5 * least - 1) * (2 - least) / least if least > 2 / 3 else float("inf"))
    both = F.when((F.col("q") == 2) & (F.col("size") <= longest_short), F.array(F.lit(1), F.lit(2))).otherwise(F.array("q"))
    sized = sized.select("id", "t", "size", "need", F.col("q").alias("own"), F.explode(both).alias("q"))
    sized = sized.withColumn("need", F.when(F.col("q") == F.col("own"), F.col("need")).otherwise(F.ceil(least * smallest / 2 - 1e-9).cast("int")))
    sized = sized.withColumn("n", F.col("size") - F.col("q") + 1).withColumn("pos", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return sized.select("id", "size", "q", "n", "need", F.substring("t", F.col("pos"), F.col("q")).alias("gram"), "pos")


def _rarest(tokens: DataFrame, freq: DataFrame) -> DataFrame:
    """The tokens of a text that are rarest over all texts: as many as must hold ``few`` of any ``need`` that are common."""
    few = F.least(F.lit(RARE_COMMON), F.col("need"))
    packed = tokens.join(freq, ["q", "gram"]).groupBy("id", "size", "q", "n", "need").agg(F.array_sort(F.collect_list(F.struct("freq", "gram", "pos"))).alias("all"))  # a text's own
    kept = packed.select("id", "size", "q", few.alias("few"), F.explode(F.slice("all", F.lit(1), F.greatest(F.col("n") - F.col("need") + few, F.lit(1)))).alias("k"))
    return kept.select("id", "size", "q", "few", "k.gram", "k.pos")


def candidate_pairs(left: DataFrame, right: DataFrame, left_text: str, right_text: str, least: float) -> DataFrame:
    """(left_id, right_id), the md5 of texts: all pairs of different texts that can be ``least`` alike, from an inverted index on rare q-grams.

    For texts whose rarest q-grams tell them apart; those of titles don't, so :func:`similar_pairs` compares blocks. Lengths must allow the ratio; a common token must stand no further from its place than the characters that remain
    unmatched; and so many tokens must be common among the rarest of both. No pair that is ``least`` alike is lost.
    """
    a, b = _titles(left, left_text), _titles(right, right_text)
    ta, tb = _tokens(a, least), _tokens(b, least)
    freq = ta.unionByName(tb).groupBy("q", "gram").agg(F.count("*").alias("freq"))
    side = lambda t, p: t.select("q", "gram", *(F.col(c).alias(p + c) for c in ("id", "size", "few", "pos")))
    l, r = side(_rarest(ta, freq), "left_"), side(_rarest(tb, freq), "right_")
    total = F.col("left_size") + F.col("right_size")
    matched = F.ceil(least * total / 2 - 1e-9)
    near = F.abs(F.col("left_pos") - F.col("right_pos")) <= F.greatest("left_size", "right_size") - matched
    met = l.join(r, ["q", "gram"]).where((F.col("left_id") != F.col("right_id")) & (matched <= F.least("left_size", "right_size")) & near)
    counted = met.groupBy("q", "left_id", "right_id").agg(F.count("*").alias("n"), F.min(F.least("left_few", "right_few")).alias("few"))
    return counted.where("n >= few").select("left_id", "right_id").distinct()


def similar_pairs(left: DataFrame, right: DataFrame, left_text: str, right_text: str, least: float, min_length: int = 0) -> DataFrame:
    """(``left_text``, ``right_text``, ratio): distinct texts of both sides that are at least ``least`` alike, left first; equal texts too.

    Blocks of texts are compared by :func:`tallyloom.operators.alike.alike`. Null and empty texts match nothing. One title repeated by many rows is one text.
    """
    side = lambda df, c, asks, size: df.select(F.col(c).alias("t"), F.lit(asks).alias("asks"), F.lit(not asks).alias("holds")).where(F.length("t") >= size)
    both = side(left, left_text, True, max(1, min_length)).unionAll(side(right, right_text, False, 1))
    texts = both.groupBy("t").agg(F.max("asks").alias("asks"), F.max("holds").alias("holds"))
    pairs = alike.alike(texts, least).select(F.col("asked").alias(left_text), F.col("other").alias(right_text), "ratio")
    return pairs.unionByName(texts.where("asks AND holds").select(F.col("t").alias(left_text), F.col("t").alias(right_text), F.lit(1.0).alias("ratio")))


def fuzzy_pairs(left: DataFrame, right: DataFrame, on: list[str], left_text: str, right_text: str, least: float, min_length: int = 0) -> DataFrame:
    """Rows of equal block ``on`` whose texts are at least ``least`` alike (left first): :func:`similar_pairs` and a join each to the rows."""
    alike = similar_pairs(left, right, left_text, right_text, least, min_length)
    return left.join(alike, left_text).join(right, [*on, right_text])


def latest_before(rows: DataFrame, prior: DataFrame, key: str, at: str, prior_at: str, prior_id: str) -> DataFrame:
    """As-of join, strictly backward: each row with the latest prior row of its key before it.

    One sort of both sides by key and time in place of a join that makes every pair: prior
    rows come before rows of a later time only. A null key finds nothing: such priors take no
    part, and such rows are spread by a hash, so that they are no hot partition.
    """
    p = prior.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(prior_at).alias("_t"), F.lit(1).alias("_side"), F.struct(F.col(prior_at).alias("at"), F.col(prior_id).alias("id")).alias("_p"), F.lit(None).cast(rows.schema.simpleString()).alias("_r"))
    r = rows.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.struct(*rows.columns).alias("_r"))
    spread = F.when(F.col("_k").isNull(), F.pmod(F.xxhash64("_t", "_r"), F.lit(1 << 20))).otherwise(-1)
    w = Window.partitionBy("_k", spread).orderBy("_t", "_side", F.col("_p.id")).rowsBetween(Window.unboundedPreceding, -1)
    return r.unionAll(p).withColumn("prior", F.last("_p", ignorenulls=True).over(w)).where("_side = 0").select("_r.*", F.col("prior.id").alias("prior_id"), F.col("prior.at").alias("prior_at"))


def within_days(rows: DataFrame, prior: DataFrame, key: str, at: str, prior_at: str, days: int = 7) -> DataFrame:
    """Range join on a key: prior rows in the ``days`` before a row, the row's own time excluded.

    Both sides are bucketed by ``days``; a row looks into its own and the previous bucket,
    so the join is an equi-join on (key, bucket).
    """
    day = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / (86400 * days))
    r = rows.withColumn("_b", F.explode(F.array(day(at), day(at) - 1)))
    p = prior.withColumn("_b", day(prior_at))
    joined = r.join(p, [key, "_b"]).drop("_b")
    return joined.where((F.col(prior_at) < F.col(at)) & (F.col(prior_at) >= F.col(at) - F.expr(f"INTERVAL {days} DAYS")))


def pending(listed: DataFrame, key: str, order: str, *done: DataFrame) -> DataFrame:
    """The work queue: listed ids less all that are done, by first listing."""
    first = listed.groupBy(key).agg(F.min(order).alias("first_seen"))
    for d in done:
        first = first.join(d.select(key), key, "left_anti")
    return first


def missing(required: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Required keys that aren't known: empty if all is well."""
    return required.select(key).distinct().join(known.select(key), key, "left_anti")


def reused(rows: DataFrame, prior: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share any one of the keys with prior rows, and which."""
    out = None
    for k in keys:
        part = rows.join(prior.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_semi").select(*rows.columns, F.lit(k).alias("reused_key"))
        out = part if out is None else out.unionAll(part)
    return out


def conflicts(rows: DataFrame, registry: DataFrame, row_id: str, keys: list[str]) -> DataFrame:
    """Rows whose key another id holds in the registry too, with one such id (the smallest, or else the greatest).

    A row a conflict, not a row a pair: a key that many ids share costs as many rows as it has.
    """
    out = None
    for k in keys:
        held = registry.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(row_id).alias("_low"), F.max(row_id).alias("_high"))
        other = F.when(F.col("_low") != F.col(row_id), F.col("_low")).otherwise(F.col("_high"))
        part = rows.join(held, k).withColumn("other_id", other).where(F.col("other_id") != F.col(row_id)).select(row_id, "other_id", F.lit(k).alias("key"))
        out = part if out is None else out.unionAll(part)
    return out.distinct()


def unique_lookup(rows: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    """Each row with the number of its targets; one is right, none or several are violations."""
    n = target.groupBy(*on).agg(F.count("*").alias("n_targets"))
    return rows.join(n, on, "left").withColumn("n_targets", F.coalesce("n_targets", F.lit(0)))


def by_precedence(rows: DataFrame, key: str, sources: dict[str, DataFrame]) -> DataFrame:
    """Each key with the first source that has it, else ``missing``: one aggregation of all sources' keys, and one join."""
    names, found = F.array(*map(F.lit, (*sources, "missing"))), None
    for place, s in enumerate(sources.values(), 1):
        part = s.select(key, F.lit(place).alias("_place"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy(key).agg(F.min("_place").alias("_place"))
    # The place is filled in before the lookup: Spark holds ``element_at`` of an array without nulls for not null, whatever its index is, and drops a later ``coalesce``.
    return rows.join(best, key, "left").withColumn("found_in", F.element_at(names, F.coalesce("_place", F.lit(len(sources) + 1)))).drop("_place")


def allowed_by_rules(urls: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """Robots rules: per path the longest matching rule wins, allow wins ties, no match allows.

    ``rules`` has (pattern, allow) of one agent's group, a list as short as a robots file.
    """
    pattern = F.col("pattern")
    ends = pattern.endswith("$")
    body = F.when(ends, F.expr("substring(pattern, 1, length(pattern) - 1)")).otherwise(pattern)
    literal = F.regexp_replace(body, r"([.\\+?()\[\]{}|^$])", r"\\$1")
    compiled = rules.select(F.concat(F.lit("^"), F.replace(literal, F.lit("*"), F.lit(".*")), F.when(ends, F.lit("$")).otherwise(F.lit(""))).alias("regex"), F.length(F.replace(body, F.lit("*"), F.lit(""))).alias("size"), "allow")
    packed = compiled.agg(F.collect_list(F.struct("size", "allow", "regex")).alias("rules"))  # one robots file
    hit = F.filter("rules", lambda r: F.regexp_like(F.col(path), r["regex"]))
    best = F.array_max(F.transform(hit, lambda r: F.struct(r["size"], r["allow"])))
    return urls.crossJoin(F.broadcast(packed)).select(*urls.columns, F.coalesce(best["allow"], F.lit(True)).alias("allowed"))
