"""The filter cascade against plain Python: exactness, odd URLs, lists dealt to several cascades."""

import random

import pytest

from tallyloom.llm import urlfilter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
ODD = [None, "", "no scheme", "http://", "https://WWW.Example.COM/en/x?q", "http://example.com", "http://example.com?/en/", "http://example.com#x", "http://a.net/es", "http://a.net/es/", "x://y://z.net/fr/", "http://notexample.com/en/", "http://com/", "http://ÄB.com/É/", "http://example.com:80/en/", "ftp://u@example.com/en/1", "http://.net/fr/", "http://net/fr/a/fr/", "http://a..com/", "http://example.com/EN/", "http://e.com/\n?x"]


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]


def judged(url, rules):
    host, path = parts(url)
    fit = [(len(h + (p or "")), len(h), v == "block", h + (p or "")) for h, p, v in ((h and h.lower(), p, v) for h, p, v in rules) if h and v and (host == h or host.endswith("." + h)) and path.startswith(p or "") and (not p or p[0] == "/")]
    best = max(fit, default=None)
    return host, path, best and best[3], "allow" if not best or not best[2] else "block"


def check(spark, urls, rules):
    pages = spark.createDataFrame([(n % 50, u, "<p>", "x", "y", [1], None) for n, u in enumerate(urls)], "page_id long, url string, html string, host string, path string, keys array<int>, best string")
    got = urlfilter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((n % 50, *judged(u, rules))) for n, u in enumerate(urls))


def test_the_contracts_rules_on_odd_urls(spark):
    long = ["http://" + "a." * 4000 + "net/fr/" + "p/" * 50_000, "http://example.com/en/" + "e" * 100_000]
    check(spark, [*ODD, *ODD, *long], RULES)


def many(seed, n):
    rng = random.Random(seed)
    host = lambda: ".".join(rng.choice(("a", "b", "c", "news", "x")) for _ in range(rng.randrange(1, 4)))
    path = lambda: "/" + "/".join(rng.choice(("en", "fr", "p", "q1")) for _ in range(rng.randrange(0, 3)))
    rules = [(host(), rng.choice((path(), path() + "/", "", None)), rng.choice(("allow", "block"))) for _ in range(60)]
    return [f"http://{host()}{path()}{rng.choice(('', '/', '?a', '#b'))}" for _ in range(n)], rules


@pytest.mark.parametrize("bits", (1 << 24, 128))
def test_many_rules_in_one_cascade_and_in_several(spark, monkeypatch, bits):
    """A rate of one half in the first filter makes cascades of several levels."""
    monkeypatch.setattr(urlfilter, "MAX_BITS", bits)
    urls, rules = many(bits, 600)
    check(spark, urls, [*rules, ("A", "/p", "block"), ("a", "/p", "allow"), (None, "/", "block"), ("", "/", "block"), ("b", "p", "block"), ("c", "/", None)])


def test_levels_alternate_until_nothing_passes(spark):
    """Weak filters: many levels, exact all the same."""
    keys = spark.range(400).selectExpr("concat('k', id) AS key", "id % 3 = 0 AS block", "1 AS labels", "0 AS n").where("block")
    corpus = spark.range(2000).selectExpr("array(concat('k', id)) AS keys")
    made = urlfilter.cascades(keys, corpus, 1)[True]
    assert len(made) > 3
    got = {r.key for r in corpus.selectExpr("keys[0] AS key").where(urlfilter.listed(urlfilter.F.col("key"), made)).collect()}
    assert got == {f"k{i}" for i in range(0, 400, 3)}


def test_no_rules_no_pages_and_no_python_in_the_plan(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [tuple(r) for r in urlfilter.judge(pages, none).collect()] == [(1, "a.com", "/", None, "allow")]
    assert urlfilter.judge(pages.where("false"), spark.createDataFrame(RULES, none.schema)).count() == 0
    rules = spark.sql("SELECT * FROM VALUES ('com', '/', 'block') AS r(host, path, verdict)")
    plan = urlfilter.judge(spark.sql("SELECT 1L AS page_id, 'http://a.com/' AS url"), rules)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Join", "ExistingRDD", "Exchange"))
