"""URL filters by a cascade of Bloom filters over a corpus's own keys. [native: DataFrame functions only]

A rule is a host, the start of a path and a verdict; it fits its host and all subdomains. A URL's
keys are every host suffix and path start of the lengths that rules have, so a rule fits if it is one
of them, and the longest listed key is the rule that counts.

Whether a key is listed is answered by a cascade: the first filter holds the listed keys; the next
holds the keys of the corpus that pass it though unlisted; the next the listed keys that pass that
one; and so on, until a filter lets nothing through. Since the whole key universe of the corpus was
tried, answers are exact for all its keys, by bit tests alone: judging is one map over the pages
without a join or a shuffle. The first filter's rate of false positives follows from the sizes of list
and universe, so all filters together have some 1.44 * log2(universe / list) + 6 bits a rule. That is
the size that tasks get as a literal. A list that would need more than ``MAX_BITS`` is dealt by hash to
several such cascades, each with a pass over the pages; results are the same.

Defined cases. A null URL or one without ``://`` has an empty host and path; no rule fits it. A URL that no
rule fits gets ``default``. Of equally long rules that fit, the one with the longer host counts; a rule
listed with both verdicts blocks. Rules with a null or empty host, a null verdict, or a path that is neither null,
empty nor begins with ``/`` fit nothing. Repeated pages are a row each; an empty table gives no rows; whole
URLs count, however long; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BITS = 1 << 24
#: The rate of false positives of all filters but the first.
LATER_RATE = 0.5
MAX_LEVELS = 200


def lowered(text: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    return F.translate(text, UPPER, LOWER)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.coalesce(lowered(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its number, bits, hash functions and 64-bit words."""

    number: int
    bits: int
    hashes: int
    words: tuple[int, ...]


def _shape(n: int, rate: float) -> tuple[int, int]:
    """Bits (a multiple of 64) and hash functions for ``n`` keys."""
    return 64 * max(1, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64)), max(1, round(-math.log2(rate)))


def _place(key: Column, number: int, i: int, bits: int) -> Column:
    # The numbers come first, so that two keys with one hash part in another level.
    return F.pmod(F.xxhash64(F.lit(number), F.lit(i), key), F.lit(bits))


def level(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    """The filter of ``n`` keys (column ``key``). Its words, a bounded number, come to the driver."""
    bits, hashes = _shape(n, rate)
    places = keys.select(F.explode(F.array(*[_place(F.col("key"), number, i, bits) for i in range(hashes)])).alias("at"))
    found = places.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("set"))
    words = [0] * (bits // 64)
    for r in found.collect():
        words[r.word] = r.set
    return Level(number, bits, hashes, tuple(words))


def passes(key: Column, f: Level) -> Column:
    """Whether the filter lets a key through."""
    words = F.from_json(F.lit(f"[{','.join(map(str, f.words))}]"), "array<bigint>")
    out = F.lit(True)
    for i in range(f.hashes):
        at = _place(key, f.number, i, f.bits)
        out = out & (F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1)
    return out


def listed(key: Column, cascade: list[Level]) -> Column:
    """Exact membership, for any key of the universe that the cascade was built for."""
    out = F.lit(False)
    for f in reversed(cascade):
        out = passes(key, f) & ~out
    return out


def _members(cascade: list[Level], made: Callable[[Column], Column]) -> Column:
    """What is ``made`` of each of the ``keys`` that a cascade lists."""
    return F.transform(F.filter("keys", lambda k: listed(k, cascade)), lambda k: made(k))


def _deal(key: Column, deals: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(deals))


def _dealt(keys: Column, deal: int, deals: int) -> Column:
    return F.filter(keys, lambda k: _deal(k, deals) == deal)


def _candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys of a URL: host suffixes of so many labels with path starts of so many characters."""
    key = lambda labels, n: F.when(F.length(path) >= n, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, n)))
    return F.array_compact(F.array_distinct(F.array(*[key(labels, n) for labels, n in shapes])))


def _rule_keys(rules: DataFrame) -> DataFrame:
    """(key, block, labels, n): what can fit, a row a rule and verdict."""
    host, path = lowered(F.col("host")), F.coalesce("path", F.lit(""))
    good = rules.where((F.length("host") > 0) & F.col("verdict").isNotNull() & ((path == "") | path.startswith("/")))
    return good.select(F.concat(host, path).alias("key"), (F.col("verdict") == "block").alias("block"), F.size(F.split(host, r"\.")).alias("labels"), F.length(path).alias("n")).distinct()


def cascades(keys: DataFrame, corpus: DataFrame, universe: int) -> dict[bool, list[Level]]:
    """A cascade each for the listed keys that block and those that allow. ``corpus``: a column
    ``keys``, an array for each page; ``universe`` is at least the number of their different keys."""
    sizes = {r.block: r.n for r in keys.groupBy("block").agg(F.count("*").alias("n")).collect()}
    rate = {b: min(LATER_RATE, n * math.sqrt(0.5) / max(universe, 1)) for b, n in sizes.items()}
    out = {b: [level(keys.where(F.col("block") == b), n, rate[b], 0)] for b, n in sizes.items()}
    if not out:
        return out
    # One pass over the corpus for what the first filters let through; as many keys as rules are listed, or so.
    through = F.concat(*[_members(cascade, lambda k, b=block: F.struct(F.lit(b).alias("block"), k.alias("key"))) for block, cascade in out.items()])
    through = corpus.select(F.explode(through).alias("k")).select("k.block", "k.key").distinct()
    tried = through.withColumn("rule", F.lit(0)).unionByName(keys.select("block", "key", F.lit(1).alias("rule")))
    known, path = store.written(tried.groupBy("block", "key").agg(F.max("rule").alias("rule")), "url-keys")
    for b, made in out.items():
        own = known.where(F.col("block") == b)
        encode, against = own.where("rule = 0").select("key"), own.where("rule = 1").select("key")
        while n := encode.count():
            if len(made) == MAX_LEVELS:
                raise RuntimeError("the filters of a cascade don't converge")
            made.append(level(encode, n, LATER_RATE, len(made)))
            encode, against = against.where(passes(F.col("key"), made[-1])), encode
    store.remove(corpus.sparkSession, path)
    return out


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict), a row a page. ``rules``: (host, path, verdict); verdicts are block or allow."""
    spark = pages.sparkSession
    host, path = parts(F.col("url"))
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    keys, rule_path = store.written(_rule_keys(rules), "url-rules")
    best = F.lit(None).cast("struct<n:int,host_n:int,block:boolean,key:string>")
    out = out.withColumn("best", best)
    # What lengths rules have: bounded by the length of a host and of a rule's path.
    shapes = sorted((r.labels, r.n) for r in keys.select("labels", "n").distinct().collect())
    if shapes:
        n, universe = keys.count(), max(1, pages.count() * len(shapes))
        deals = max(1, math.ceil(_shape(n, min(LATER_RATE, n * math.sqrt(0.5) / universe))[0] / MAX_BITS))
        for deal in range(deals):
            candidates = _candidates(F.col("host"), F.col("path"), shapes)
            if deals > 1:
                candidates = _dealt(candidates, deal, deals)
            found = cascades(keys.where(_deal(F.col("key"), deals) == deal), out.select(candidates.alias("keys")), universe)
            rank = lambda k, b: F.struct(F.length(k).alias("n"), F.length(F.substring_index(k, "/", 1)).alias("host_n"), F.lit(b).alias("block"), k.alias("key"))
            hits = [F.array_max(_members(cascade, lambda k, b=block: rank(k, b))) for block, cascade in found.items()]
            out = out.withColumn("keys", candidates).withColumn("best", F.greatest("best", best, *hits)).drop("keys")
            if deal + 1 < deals:
                out, _ = store.written(out, "url-judged")
    store.remove(spark, rule_path)
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best.block"), "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))
