"""Rules that look up other stories, against loops over all pairs; alike titles, ties, nulls and a hot key among them."""

import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

from tallyloom.operators import history

SCHEMA = "edition_id string, cutoff_at timestamp, archived boolean, pos int, id string, topic_key string, title string, urls array<string>, facts_hash string, words string, issue_id string, issue_title string, follow_edition string, follow_story string, correction_edition string, correction_story string, source_at timestamp, rank int"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


def stories(seed):
    rng = random.Random(seed)
    base = ["큰불이항구에서났다", "금리가또올랐다고한다", "새로운달탐사선발사", "abcdefghijkl", "", None]
    out = []
    for e in range(20):
        cutoff = datetime(2026, 10, 1, 9) + timedelta(hours=12 * e)
        for pos in range(rng.randrange(1, 5)):
            title = rng.choice(base)
            title = title and title.replace(title[rng.randrange(len(title))], rng.choice("가나xy"))
            ref = lambda: (f"e{rng.randrange(e + 1)}", f"s{rng.randrange(4)}") if rng.random() < 0.5 else (None, None)
            out.append((f"e{e}", cutoff, rng.random() < 0.1, pos, f"s{pos}", rng.choice(["hot", "t1", f"t{e}", "", None]), title, rng.choice([None, [], [f"u{rng.randrange(30)}", None]]), rng.choice([None, f"f{rng.randrange(30)}"]), f"w{rng.randrange(4)}", rng.choice([None, "i1", f"i{rng.randrange(20)}"]), rng.choice(["A", "B"]), *ref(), *ref(), cutoff - timedelta(hours=rng.randrange(40)), 5))
    return out


def known(rows, least):
    rows = [dict(zip(FIELDS, r)) for r in rows]

    def same(a, b):
        if any(a[k] and a[k] == b[k] for k in ("topic_key", "facts_hash")) or {u for u in a["urls"] or [] if u} & {u for u in b["urls"] or [] if u}:
            return True
        return bool(a["title"] and b["title"] and SequenceMatcher(None, a["title"], b["title"]).ratio() >= least)

    of = {e: n for n, e in enumerate(sorted({r["edition_id"] for r in rows}, key=lambda e: int(e[1:])))}
    out = {}
    for a in rows:
        prior = [b for b in rows if not b["archived"] and b["cutoff_at"] < a["cutoff_at"]]
        issue = [b for b in prior if a["issue_id"] and a["issue_id"] == b["issue_id"]]
        match = [b for b in prior if same(a, b) or b in issue]
        newest = max(match, key=lambda b: (b["cutoff_at"], -b["pos"]), default=None)
        target = [b for b in prior if (b["edition_id"], b["id"]) == (a["follow_edition"], a["follow_story"])]
        fixed = [b for b in issue if (b["edition_id"], b["id"]) == (a["correction_edition"], a["correction_story"])]
        urls = {u for u in a["urls"] or [] if u}
        near = [b for b in prior if of[a["edition_id"]] - of[b["edition_id"]] <= 14 and ((a["topic_key"] and a["topic_key"] == b["topic_key"]) or urls & {u for u in b["urls"] or [] if u})]
        titles = {b["issue_title"] for b in issue}
        out[a["edition_id"], a["id"]] = (
            any(b["edition_id"] == a["edition_id"] and b["pos"] < a["pos"] and same(a, b) for b in rows), int(newest is not None), newest and (newest["edition_id"], newest["id"]),
            newest and newest["words"] == a["words"], newest and a["source_at"] > newest["cutoff_at"], len(target), bool(fixed), bool(titles - {a["issue_title"]}), bool(near),
        )
    return out


def test_history_equals_loops(spark):
    for seed, least in ((1, 0.82), (2, 0.82), (3, 1.0)):
        rows = stories(seed)
        got = history.with_history(spark.createDataFrame(rows, SCHEMA), least).collect()
        assert len(got) == len(rows)
        found = {(r.edition_id, r.id): (r.repeats, r.n_matches, r.newest and (r.newest.edition_id, r.newest.id), r.same_words, r.newer_source, r.follow_targets, r.correction_found, r.known_title is not None and r.known_title != r.issue_title, r.recent) for r in got}
        assert found == known(rows, least)
    none = spark.createDataFrame(rows, SCHEMA).where("false")
    assert history.with_history(none).count() == 0


def test_a_hot_topic_makes_no_pairs(spark):
    """Thousands of stories of one topic in a few editions: rows stay a small multiple of the stories."""
    rows = [(f"e{n % 3}", datetime(2026, 10, 1 + n % 3), False, n, f"s{n}", "hot", None, None, None, "w", None, None, None, None, None, None, None, 0) for n in range(3000)]
    got = history.with_history(spark.createDataFrame(rows, SCHEMA), least=1.0)
    assert {(r.edition_id, r.id): (r.n_matches, r.newest and r.newest.id) for r in got.collect()} == {(r[0], r[4]): (int(r[0] != "e0"), {"e0": None, "e1": "s0", "e2": "s1"}[r[0]]) for r in rows}
