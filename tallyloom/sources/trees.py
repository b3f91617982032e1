"""Page trees as arrays of nodes with intervals, and selectors on them as column expressions.

A page is parsed once, in Python; its nodes stand in one array in document order. A node's number ``pre`` and the number ``last`` of
the last node below it make an interval, so "below" is a comparison of numbers, and all selection stays in Spark within the page's row,
without a join or a shuffle. Text is a node of its own (tag ``#text``). ``hidden`` is the number of the innermost element around a node whose
text isn't shown (-1: none): seen from a root above that element the text is hidden, from one below it isn't.

Defined cases: a null page has null nodes, an empty one none. Elements left open end where an element around them ends, or with the page;
an end tag that closes nothing is skipped. A page is one row, so it must fit in memory; there is no other limit to its size or depth.
"""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import text, urls
from tallyloom.sources.readers import UNSEEN, VOID

TEXT = "#text"
NODE = T.StructType([T.StructField("pre", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("hidden", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType()), T.StructField("link", T.StringType())])

# How listing pages of the aggregator are marked, their next pages, and the longest title.
LIST_ID, ITEM_CLASS, TITLE_CLASS, AGE_CLASS = "listIssue", "article", "title", "time"
NEXT_PAGE = r"^https://aagag\.com/issue/\?page=(\d+)$"
TITLE_LENGTH = 300


class _Tree(HTMLParser):
    def __init__(self, written: bool):
        super().__init__(convert_charrefs=True)
        self.written = written
        self.nodes: list[list] = []
        self.open: list[int] = []

    def _add(self, tag: str, attrs: dict, said: str | None) -> int:
        n = len(self.nodes)
        hidden = n if tag in UNSEEN or "hidden" in attrs else self.nodes[self.open[-1]][3] if self.open else -1
        self.nodes.append([n, n, len(self.open), hidden, tag, attrs, said])
        return n

    def handle_starttag(self, tag, attrs):
        n = self._add(tag, {k: v or "" for k, v in attrs}, None)
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, {k: v or "" for k, v in attrs}, None)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.nodes[self.open[i]][4] == tag), None)
        if at is not None:
            self._end(at)

    def handle_data(self, data):
        raw = self.cdata_elem is not None and not getattr(self, "_escapable", False)  # scripts and the like: no references there
        self._add(TEXT, {}, data.replace("&amp;", "&") if self.written and raw else data)

    def _end(self, at: int) -> None:
        for n in self.open[at:]:
            self.nodes[n][1] = len(self.nodes) - 1
        del self.open[at:]


def _link(base: str | None, ref: str) -> str | None:
    try:
        return urljoin(base or "", ref)
    except ValueError:
        return None


def _parsed(written: bool):
    # Row by row: a page's nodes take many times its size, so no batch of them is held but the 100 rows that Spark pickles at once.
    @F.udf(T.ArrayType(NODE), useArrow=False)
    def run(source, url):
        if source is None:
            return None
        tree = _Tree(written)
        tree.feed(source.replace("&", "&amp;") if written else source)
        tree.close()
        tree._end(0)
        return [(*n, _link(url, n[5].get("href", "")) if n[4] == "a" else None) for n in tree.nodes]

    return run


def nodes(page: Column | str, base: Column | str | None = None, written: bool = False) -> Column:
    """The nodes of a page in document order; ``base`` is its own URL, against which links are read (null where one can't be). Texts and attributes have
    their character references decoded, or stand as they are ``written``."""
    return _parsed(written)(page, F.lit(None).cast("string") if base is None else base)


def has_class(node: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(text.words(node["attrs"]["class"]), name), F.lit(False))


def select(tree: Column, tag: str | None = None, id: str | None = None, cls: str | None = None) -> Column:
    """The elements of a tree, or of a part of it, with a tag, an id or a class."""

    def fits(n: Column) -> Column:
        out = n["tag"] != TEXT
        if tag is not None:
            out = out & (n["tag"] == tag)
        if id is not None:
            out = out & F.coalesce(n["attrs"]["id"] == id, F.lit(False))
        return out & has_class(n, cls) if cls is not None else out

    return F.filter(tree, fits)


def first(found: Column) -> Column:
    """The first node of a selection, or null."""
    return F.get(found, F.lit(0))


def bound(value: Column, made: Callable[[Column], Column]) -> Column:
    """What is made of a value that is computed once: within lambdas over nodes, an expression would be computed for every node."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def below(tree: Column, root: Column) -> Column:
    """The nodes below a node; none if that is null."""
    return bound(root, lambda r: F.filter(tree, lambda n: F.coalesce((n["pre"] > r["pre"]) & (n["pre"] <= r["last"]), F.lit(False))))


def _said(tree: Column, root: Column, counts: Callable[[Column, Column], Column]) -> Column:
    def text_of(r: Column) -> Column:
        found = F.filter(tree, lambda n: (n["pre"] > r["pre"]) & (n["pre"] <= r["last"]) & (n["tag"] == TEXT) & counts(n, r))
        return F.when(r.isNotNull(), F.array_join(F.transform(found, lambda n: n["text"]), ""))

    return bound(root, text_of)


def shown_text(tree: Column, root: Column) -> Column:
    """The text below a node as a reader sees it; null for no node."""
    return _said(tree, root, lambda n, r: n["hidden"] < r["pre"])


def own_text(tree: Column, root: Column) -> Column:
    """A node's own text, without that of elements within it; null for no node."""
    return _said(tree, root, lambda n, r: n["depth"] == r["depth"] + 1)


def listing(pages: DataFrame, row_id: str, url: str, html: str) -> DataFrame:
    """(row, status, items, next_page), a row a listing page.

    Items are the list element's links of the item class as (pos, id, url, title, own_title, age), the first of each identity. ``next_page`` is the
    link to the page after this one, from anywhere on the page. Without a list (``no list``), with a link that is no post's (``bad link``) or
    without any item (``empty``) a page shows nothing, which isn't a count of zero: items are null.
    """
    # Columns of the page's other names stay out of the way.
    p = pages.select(F.col(row_id).alias("_id"), F.col(url).alias("_url"), nodes(html, url).alias("_tree"))
    tree, root = F.col("_tree"), F.col("_root")
    p = p.withColumn("_root", first(select(tree, id=LIST_ID)))
    p = p.withColumn("_items", select(below(tree, root), tag="a", cls=ITEM_CLASS))

    def item(node: Column, i: Column) -> Column:
        def told(part: Column) -> Column:
            said = bound(first(select(part, cls=TITLE_CLASS)), lambda n: F.struct(shown_text(part, n).alias("shown"), own_text(part, n).alias("own")))
            return F.struct(said.alias("title"), shown_text(part, first(select(part, cls=AGE_CLASS))).alias("age"))

        return F.struct(i.alias("pos"), node["link"].alias("url"), bound(below(tree, node), told).alias("told"))

    found = lambda m: F.struct(m["pos"].alias("pos"), urls.post_identity(m["url"]).alias("id"), m["url"].alias("url"), F.substring(F.trim(F.coalesce(m["told"]["title"]["shown"], F.lit(""))), 1, TITLE_LENGTH).alias("title"), F.trim(m["told"]["title"]["own"]).alias("own_title"), F.nullif(F.trim(m["told"]["age"]), F.lit("")).alias("age"))
    p = p.withColumn("_made", F.transform(F.transform("_items", item), found))
    ids = F.transform("_made", lambda m: m["id"])
    status = F.when(root.isNull(), "no list").when(F.exists(ids, lambda i: i.isNull()), "bad link").when(F.size("_items") == 0, "empty").otherwise("ok")
    here = F.coalesce(F.nullif(F.regexp_extract("_url", r"page=(\d+)", 1), F.lit("")).cast("decimal(38,0)"), F.lit(1))
    number = lambda u: F.nullif(F.regexp_extract(u, NEXT_PAGE, 1), F.lit("")).cast("decimal(38,0)")
    following = bound(here, lambda h: first(F.filter(tree, lambda n: F.coalesce(number(n["link"]) == h + 1, F.lit(False))))["link"])
    firsts = F.filter("_made", lambda m, i: F.array_position(ids, m["id"]) == i + 1)
    return p.select(F.col("_id").alias(row_id), status.alias("status"), F.when(status == "ok", firsts).alias("items"), F.when(status == "ok", following).alias("next_page"))


def listed_posts(listed: DataFrame, row_id: str) -> DataFrame:
    """A row an item of :func:`listing`."""
    return listed.select(row_id, F.inline("items"))
