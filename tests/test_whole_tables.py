"""Queries that once read a part of their table, on small tables of which that part is not all."""

from datetime import datetime
from difflib import SequenceMatcher

import pytest

from tallyloom.plans import catalog


@pytest.fixture
def run(spark, tmp_path):
    """Rows of a query over tables of the given rows."""

    def go(name, **tables):
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        return [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]

    return go


def parts():
    names = ["red widget", "Red Widget", "red widgets", "blue ring", "cold bolt", "red widget"]
    rows = [(298 + i, names[i % 6], f"Brand#{i % 2}", ["SMALL", "SMALLER", "ECONOMY"][i // 6 % 3]) for i in range(24)]
    return rows, "p_partkey long, p_name string, p_brand string, p_type string"


def test_equal_titles_of_all_ids(run):
    rows, _ = tables = parts()
    alike = lambda a: [b[0] for b in rows if b[1].lower().replace(" ", "") == a[1].lower().replace(" ", "")]
    assert sorted(run("equal_titles", part=tables)) == sorted((a[0], min(alike(a)), len(alike(a))) for a in rows)


def test_similar_titles_equal_brute_force(run):
    rows, _ = tables = parts()
    ratio = lambda a, b: SequenceMatcher(None, f"{a[1]} {a[3]}", f"{b[1]} {b[3]}").ratio()
    want = [(a[0], b[0], ratio(a, b)) for a in rows for b in rows if a[2] == b[2] and b[0] < a[0] and ratio(a, b) >= 0.82]
    assert any(b % 10 for _, b, _ in want) and any(r < 1 for _, _, r in want)
    got = run("similar_titles", part=tables)
    title = {a[0]: (a[2], f"{a[1]} {a[3]}") for a in rows}
    first = {title[i]: i for i in sorted(title, reverse=True)}
    copies = {(i, p) for i, p, _ in got if title[i] == title[p]}
    assert copies == {(i, first[title[i]]) for i in title if i != first[title[i]]}
    # All pairs of rows, from those of classes.
    member = {i: {i, *(c for c, p in copies if p == i)} for i in first.values()}
    pairs = [(a, b, r) for i, p, r in got if (i, p) not in copies for a in member[i] for b in member[p] if b < a]
    pairs += [(a, b, 1.0) for m in member.values() for a in m for b in m if b < a]
    assert sorted(pairs) == sorted(want)


def test_similar_titles_cost_a_row_for_each_copy(run):
    rows = [(i, "red widgets" if i % 50 else "red widget", "Brand#1", "SMALL") for i in range(400)]
    got = run("similar_titles", part=(rows, "p_partkey long, p_name string, p_brand string, p_type string"))
    assert len(got) == 400  # 398 copies, and two titles each way


def lines():
    # Order 3 holds only odd places' items, supplier 8 has one line number twice, and lines go on past 5.
    rows = [(3, 1, 7, 1, "N"), (3, 2, 8, 2, "N"), (3, 2, 8, 2, "A"), (3, 2, 8, 2, "N"), (3, 4, 9, 6, "A"), (3, 5, 7, 7, "N"), (2, 1, 7, 1, "A"), (5, 1, 6, 6, "N")]
    return rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string"


def test_item_snapshot_of_all_orders(run):
    orders = [(2, datetime(2024, 1, 1)), (3, datetime(2024, 3, 1)), (5, datetime(2024, 2, 1))], "o_orderkey long, o_orderdate timestamp_ntz"
    assert sorted(run("item_snapshot", lineitem=lines(), orders=orders)) == [(1, 3), (2, 3), (4, 3), (5, 3)]


def test_source_cards_of_all_lines(run):
    assert sorted(run("source_cards", lineitem=lines())) == [(2, 7, 1, 1), (3, 7, 7, 3), (3, 8, 2, 1), (3, 9, 6, 2), (5, 6, 6, 1)]


def test_every_window_counts_all_users(run):
    events = [(datetime(2024, 1, 3, 12), "error", 1), (datetime(2024, 1, 3, 13), "error", 5), (datetime(2024, 1, 4, 1), "error", 900), (datetime(2024, 1, 5, 1), "view", 2)]
    got = {end: (n, empty) for end, n, empty in run("every_window", events=(events, "ts timestamp_ntz, event_type string, user_id long"))}
    assert {end: x for end, x in got.items() if x != (0, 1)} == {"2024-01-03 21:00:00": (2, 0), "2024-01-04 09:00:00": (1, 0)}
    assert got["2024-01-05 09:00:00"] == (0, 1) and len(got) == 62


def test_registry_conflicts_of_all_ids(run):
    rows = [(1, 4, 150.0), (2, 4, 990.0), (3, 5, 930.0), (4, 6, 10.0), (5, 7, 20.0), (7, 8, 500.0)]
    rows.append((9, 4, 700.0))
    want = [(1, 2, "topic"), (2, 1, "topic"), (9, 1, "topic"), (2, 3, "url"), (3, 2, "url"), (4, 5, "url"), (5, 4, "url")]
    want[0] = (1, 9, "topic")  # of the smallest id's conflicts, the greatest
    assert sorted(run("registry_conflicts", supplier=(rows, "s_suppkey long, s_nationkey int, s_acctbal double"))) == sorted(want)


def test_edition_source_of_keys_in_no_source(run):
    customers = [(i,) for i in range(6)], "c_custkey long"
    orders = [(0, "P"), (0, "F"), (2, "O"), (2, "F"), (4, "F"), (None, "P")], "o_custkey long, o_orderstatus string"
    want = [(0, "snapshot"), (1, "missing"), (2, "window"), (3, "missing"), (4, "archive"), (5, "missing")]
    assert sorted(run("edition_source", customer=customers, orders=orders)) == want


def test_page_outline_decodes_two_references_only(run):
    pages = [(1, "<article><h1> a &amp; &quot;b &copy; c&amp</h1><p>x<p>y</article>"), (2, "<p>none")], "page_id long, html string"
    assert sorted(run("page_outline", pages=pages)) == [(1, 4, 'a & &quot;b © c&amp', 2), (2, 1, "", 0)]
