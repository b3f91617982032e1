"""Timelines appended edition by edition against a rebuild from all stories, with a compaction and a crash between."""

import datetime as dt
import random

import pytest

from tallyloom.sinks.journal import Journal
from tallyloom.sinks.timelines import Timelines

SCHEMA = "entry_id string, issue string, title string, category string, covered timestamp, pos int, corrects string, batch string"


def edition(rng, n, so_far):
    out = []
    for pos in range(rng.randrange(1, 5)):
        issue = rng.choice(["hot", "hot", f"i{rng.randrange(6)}", None])
        own = [e[0] for e in so_far + out if e[1] == issue and issue]
        corrects = rng.choice(own) if own and rng.random() < 0.4 else None
        out.append((f"e{n:02}/s{pos}", issue, f"T {issue}", rng.choice("abc"), dt.datetime(2026, 10, 1) + dt.timedelta(hours=12 * n), pos, corrects, "x"))
    return out


def rebuilt(rows):
    """Entries and index by a loop over all stories in order."""
    entries, issues = {}, {}
    for entry, issue, title, category, covered, _, corrects, _ in rows:
        if issue is None:
            continue
        seen = issues.setdefault(issue, [])
        entries[entry] = [issue, seen[-1][0] if seen else None, []]
        seen.append((entry, title, category, covered))
        if corrects:
            entries[corrects][2].append(entry)
    index = {i: (s[0][1], sorted({c for *_, c, _ in s}), s[0][3], s[-1][3], len(s), s[-1][0]) for i, s in issues.items()}
    return entries, index


def test_appends_equal_a_rebuild_after_each_edition(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    lines, rows = Timelines(spark, str(tmp_path)), []
    assert lines.entries().count() == 0 and lines.index().count() == 0
    for n in range(20):
        new = edition(rng, n, rows)
        df = spark.createDataFrame(new, SCHEMA)
        if n in (5, 13):  # cut off once before and once after its intent; the next append takes it up
            whole = Journal.publish if n == 5 else Journal.intend
            monkeypatch.setattr(Journal, whole.__name__, lambda *_: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                lines.append(f"{n:04}", df)
            monkeypatch.undo()
        assert lines.append(f"{n:04}", df) is (n != 5)
        rows += new
        if n in (8, 15):
            assert lines.compact(f"{n:04}-fold")
        if n % 4 == 3 or n in (5, 8, 9, 13):
            entries, index = rebuilt(rows)
            assert {r.entry_id: [r.issue, r.previous_entry, r.superseded_by] for r in lines.entries().collect()} == entries
            assert {r.issue: (r.title, r.categories, r.first_covered, r.last_covered, r.n_entries, r.latest_entry) for r in lines.index().collect()} == index
    # Heads of a batch are those of its own issues, entries its own stories.
    own = lines.journal.read("heads", "issue string").where("batch = '0019'").collect()
    assert {r.issue for r in own} == {r[1] for r in new if r[1]}
    assert lines.append("0019", df) is False
    with pytest.raises(ValueError, match="before"):
        lines.append("0003x", df)
    with pytest.raises(ValueError, match="titles"):
        lines.append("0020", spark.createDataFrame([("z", "hot", "Other", "a", None, 0, None, "x")], SCHEMA))
    with pytest.raises(ValueError, match="corrects no entry"):
        lines.append("0020", spark.createDataFrame([("z", "new", "N", "a", None, 0, "e00/s0", "x")], SCHEMA))
