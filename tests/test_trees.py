"""Page trees and listings against a tree of objects; the fuzzy index against all pairs."""

import random
from difflib import SequenceMatcher
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import alike, matching
from tallyloom.sources import readers, trees
from tallyloom.sources.readers import UNSEEN, VOID

PAGES = [
    "", None, "plain & <b>bold", "</p></div>x<br/>y<img src=a>z</b>",
    "<div id=listIssue class='a  b'><a class='article hot' href='/issue/?idx=7_2'><span class='title'> T<i>in</i>x </span><b class=time> 3분 전</b></a><a class=article href='?idx=7'>again</a><a href=x>no</a></div><a href='?page=3'>n</a>",
    "<section hidden>no<p>no</p></section><script>var a='<p>';</script><div>a<style>b</style><p hidden>c</p>d<p>e<p>f</div>g",
    "<ul>" + "<li>" * 3000 + "deep", "<a class=article href='?idx=1'>out</a><p id=listIssue></p>", "<p id=listIssue><a class=article href='https://e.com/'>x</a>", "<p id=listIssue><a class=article>x</a>",
    "<p id=listIssue><a class=article href='http://[bad'>x</a>", "<p id=listIssue><a class=article href='/issue/?idx=5'>x</a>" + "<i>é&amp;</i>" * 500,
]


class Plain(HTMLParser):
    """A tree of (tag, attrs, children) lists."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.root = ("", {}, [])
        self.stack = [self.root]
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = (tag, {k: v or "" for k, v in attrs}, [])
        self.stack[-1][2].append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1][2].append((tag, {k: v or "" for k, v in attrs}, []))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def walk(node):
    """Elements below a node, without recursion."""
    todo = list(reversed(node[2]))
    while todo:
        n = todo.pop()
        if not isinstance(n, str):
            yield n
            todo.extend(reversed(n[2]))


def shown(node):
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n[0] not in UNSEEN and "hidden" not in n[1]:
            todo.extend(reversed(n[2]))
    return "".join(out)


def frame(spark, pages):
    return spark.createDataFrame([(i, f"https://aagag.com/issue/?page={i % 3}" if i % 3 else "https://aagag.com/issue/", p, "", 1) for i, p in enumerate(pages)], "id long, url string, html string, _tree string, pos int")


def test_nodes_and_their_text_equal_a_plain_tree(spark):
    p = frame(spark, PAGES).select("id", trees.nodes("html").alias("tree"))
    each = F.transform(trees.select(F.col("tree")), lambda n: F.struct(n["tag"].alias("tag"), n["attrs"]["class"].alias("cls"), trees.shown_text(F.col("tree"), n).alias("shown"), trees.own_text(F.col("tree"), n).alias("own"), F.size(trees.select(trees.below(F.col("tree"), n))).alias("below")))
    small = p.where("id <> 6").select("id", each.alias("e")).collect()
    for r in small:
        if PAGES[r.id] is None:
            assert r.e is None
            continue
        want = [(n[0], n[1].get("class"), shown(n), "".join(c for c in n[2] if isinstance(c, str)), sum(1 for _ in walk(n))) for n in walk(Plain(PAGES[r.id]).root)]
        assert [tuple(e) for e in r.e] == want
    deep = p.where("id = 6").select(F.size("tree").alias("n"), F.array_max(F.transform("tree", lambda n: n["depth"])).alias("d"), F.array_max(F.transform("tree", lambda n: n["last"])).alias("l")).first()
    assert tuple(deep) == (3002, 3001, 3001)


def test_listings(spark):
    got = {r.id: r for r in trees.listing(frame(spark, PAGES), "id", "url", "html").collect()}
    assert [got[i].status for i in range(len(PAGES))] == ["no list"] * 4 + ["ok"] + ["no list"] * 2 + ["empty", "bad link", "bad link", "bad link", "ok"]
    assert [tuple(x) for x in got[4]["items"]] == [(0, "aagag-7", "https://aagag.com/issue/?idx=7_2", "Tinx", "Tx", "3분 전")]
    assert got[4].next_page is None and got[7]["items"] is None
    assert [tuple(x) for x in got[11]["items"]] == [(0, "aagag-5", "https://aagag.com/issue/?idx=5", "", None, None)]
    ahead = spark.createDataFrame([(0, "https://aagag.com/issue/", PAGES[4].replace("page=3", "page=2")), (1, "https://aagag.com/issue/?page=2", PAGES[4])], "id long, url string, html string")
    listed = trees.listing(ahead, "id", "url", "html")
    assert {r.id: r.next_page for r in listed.collect()} == {0: "https://aagag.com/issue/?page=2", 1: "https://aagag.com/issue/?page=3"}
    assert [r.url for r in trees.listed_posts(listed, "id").orderBy("id").collect()] == ["https://aagag.com/issue/?idx=7_2"] * 2
    assert trees.listing(ahead.where("false"), "id", "url", "html").count() == 0


def texts(seed, n):
    """Texts of syllables and their edited copies, empty and very short ones among them."""
    rng = random.Random(seed)
    parts = ["가", "나다", "라", "마바", "사", "ab", "c", "3"]
    out = {"".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(n)}
    for t in sorted(out):
        t = list(t)
        for _ in range(rng.randrange(1, 4)):
            k = rng.randrange(len(t) + 1)
            if t and rng.random() < 0.5:
                del t[min(k, len(t) - 1)]
            else:
                t.insert(k, rng.choice("가나다ab"))
        out.add("".join(t))
    return sorted(out) + ["x" * 300, "x" * 280 + "y" * 20, "가" * 40]


@pytest.mark.parametrize("least, common", ((0.82, 12), (0.82, 1), (0.6, 3), (0.95, 100)))
def test_index_loses_no_alike_pair(spark, monkeypatch, least, common):
    monkeypatch.setattr(matching, "RARE_COMMON", common)
    a = texts(common, 130)
    b = a[::2] + texts(99, 20)
    left, right = (spark.createDataFrame([(t, 1, 2) for t in x + x[:5]] + [(None, 1, 2)], f"{c} string, size int, q int") for x, c in ((a, "l"), (b, "r")))
    got = [tuple(r) for r in matching.similar_pairs(left, right, "l", "r", least).collect()]
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    assert sorted(got) == sorted((x, y, ratio(x, y)) for x in set(a) for y in set(b) if x and y and ratio(x, y) >= least)
    longer = matching.similar_pairs(left, right, "l", "r", least, min_length=12).select("l").distinct().collect()
    assert all(len(r.l) >= 12 for r in longer)
    assert matching.similar_pairs(left.where("false"), right, "l", "r", least).count() == 0


@pytest.mark.parametrize("block", (3, 40))
def test_blocks_lose_no_alike_pair(spark, monkeypatch, block):
    """Lengths with more texts than a block holds, and all lengths that may meet."""
    monkeypatch.setattr(alike, "BLOCK", block)
    made = sorted({t for t in texts(5, 150) if t})
    rows = spark.createDataFrame([(t, k % 3 != 0, k % 4 != 0) for k, t in enumerate(made)], "t string, asks boolean, holds boolean")
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    want = [(x, y, ratio(x, y)) for k, x in enumerate(made) for n, y in enumerate(made) if k != n and k % 3 and n % 4 and ratio(x, y) >= 0.82]
    assert want and sorted(tuple(r) for r in alike.alike(rows, 0.82).collect()) == sorted(want)


def test_blocks_rule_out_most_pairs():
    """Of random texts of 44 characters, of which the index on neighbours left a tenth, next to nothing is left; of edited copies, all are."""
    rng = random.Random(7)
    made = ["".join(rng.choice(("th", "er", "in", "on", "an", "re", "he", "nd", "ou", "st", "ing", "en")) for _ in range(40))[:44] for _ in range(300)]
    edited = [t[:10] + "zz" + t[10:30] + t[33:] + "q" for t in made]
    i, j = alike.possible(made, edited, 0.82)
    assert {(k, k) for k in range(300)} <= set(zip(i.tolist(), j.tolist())) and len(i) < 400


def test_pages_are_parsed_row_by_row(spark):
    """No batch of pages' nodes or texts is held, as it would be in a vectorised function."""
    pages = spark.createDataFrame([(1, "<p>a")], "page_id long, html string")
    for parsed in (trees.nodes("html"), readers.visible_text("html")):
        plan = pages.select(parsed)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "Arrow" not in plan


def test_texts_as_written(spark):
    page = "<h1 title='a&amp;b'>x &amp; &quot;y &copy &#65; &amp</h1><script>a &amp; b && c</script>"
    tree = spark.createDataFrame([(page,)], "html string").select(trees.nodes("html", written=True)).first()[0]
    assert [n.text for n in tree if n.text] == ["x &amp; &quot;y &copy &#65; &amp", "a &amp; b && c"]
    assert tree[0].attrs == {"title": "a&amp;b"}
