"""Conversation repair against search over all edits, chunked and whole; damage against zlib."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from tallyloom.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string, place long, chunk long, edits string"
ROLES = ("system", "user", "assistant", "tool", "", "u2", None)
TEXTS = ("Yes.", "No", "ok!", "", " \t", None, "why? \n", "éa", "Yes.")
FORM = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, rows) by best-first search over edits: rows is [(role, text, fault)]."""
    heap = [(0, "", 0, ())]
    n = len(rows)
    seen = set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        initials = "".join(r[:1] or "?" for r, _ in out)
        if i == n and FORM.fullmatch(initials):
            return cost, audit, out
        if (audit, out) in seen:
            continue
        seen.add((audit, out))
        if initials and not re.fullmatch("s?(ua)*u?", initials):
            continue
        if len(out) < 2 * n + 3:
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 3, audit + "I", i, (*out, (role, ""))))
        if i < n:
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*out, (role, text))))
                for other in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, (*out, (other, text))))
    raise AssertionError


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        role = "user" if way == 4 else role
        out += [(c, t, role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return out


def brute(rows, damaged=True):
    """Result rows of the query, from plain Python."""
    result = set()
    after = damage(rows) if damaged else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, marked = set(), []
        for _, role, text in own:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else None if said[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, out = cheapest(marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        faults = [f for _, _, f in marked]
        text = "\n".join(f"{r}:{t}" for r, t in out)
        result.add((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return result


def random_rows(seed, n, turns=7):
    rng = random.Random(seed)
    out = []
    for conv in [*range(n), None]:
        for t in range(rng.randrange(1, turns)):
            out.append((conv, rng.choice((t, t, t, t + 2, None)), rng.choice(ROLES), rng.choice(TEXTS)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "") for r in rows], SCHEMA)


@pytest.mark.parametrize("rows_a_chunk", (1 << 16, 2, 1))
def test_digests_equal_search(spark, monkeypatch, rows_a_chunk):
    monkeypatch.setattr(dialogue, "CHUNK_ROWS", rows_a_chunk)
    rows = random_rows(rows_a_chunk, 60)
    got = dialogue.digests(dialogue.damaged(frame(spark, rows))).collect()
    assert len(got) == len({r[0] for r in rows})
    assert set(map(tuple, got)) == brute(rows)


@pytest.mark.parametrize("rows_a_chunk", (1 << 16, 1))
def test_repair_gives_the_rows(spark, monkeypatch, rows_a_chunk):
    monkeypatch.setattr(dialogue, "CHUNK_ROWS", rows_a_chunk)
    rows = random_rows(5, 25)
    got = {}
    for r in dialogue.repair(frame(spark, rows)).collect():
        got.setdefault(r.conv_id, []).append(r)
    for want in brute(rows, damaged=False):
        own = sorted(got[want[0]], key=lambda r: (r.place, r.step))
        assert "".join(r.edit for r in own) == want[-2]
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own if r.edit != "D").encode()).hexdigest() == want[-1]
        faults = [r.fault for r in own if r.edit != "I"]
        assert [faults.count(f) for f in ("blank", "duplicate", "truncated")] == list(want[2:5])


@pytest.mark.parametrize("seed", range(3))
def test_chunks_of_a_long_conversation_are_one_path(seed):
    """Summaries compose to the path over all rows, however it is cut."""
    rng = random.Random(seed)
    kinds = [rng.randrange(12) for _ in range(3000)]
    whole, end = dialogue.path(kinds, 0, None)
    cuts = [0, *sorted(rng.sample(range(1, 3000), 40)), 3000]
    parts = [kinds[a:b] for a, b in itertools.pairwise(cuts)]
    found = dialogue.scan([dialogue.summary(p) for p in parts])
    assert found[-1][1] == end and found[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(found))
    assert [e for p, (a, b) in zip(parts, found) for e in dialogue.path(p, a, b)[0]] == whole


def test_a_hot_conversation_and_long_texts(spark, monkeypatch):
    """Most rows in one conversation, among them very many equal ones, over chunks and partitions; the same rows in one chunk give the same."""
    rows = [(7, n, ("user", "assistant")[n % 2], f"Line {n}." if n % 5 else "same.") for n in range(600)] + [(7, 50, "user", "again.")] * 300 + [(8, 0, "user", "x" * 3_000_000 + "."), (8, 1, "assistant", "y. " * 400_000)]
    df = dialogue.damaged(frame(spark, rows))
    want = set(map(tuple, dialogue.digests(df).collect()))
    monkeypatch.setattr(dialogue, "CHUNK_ROWS", 16)
    assert set(map(tuple, dialogue.digests(df).collect())) == want and {r[0] for r in want} == {7, 8}
    assert {r[3] for r in want if r[0] == 7} == {sum(r[3] == "duplicate" for r in _marked(rows, 7))}


def _marked(rows, conv):
    seen, out = set(), []
    for c, t, role, text in sorted((r for r in damage(rows) if r[0] == conv), key=lambda r: (r[1], r[2], hashlib.md5(r[3].encode()).hexdigest())):
        out.append((c, t, role, "blank" if not text.strip() else "duplicate" if (role, text) in seen else ""))
        seen.add((role, text))
    return out


def test_all_rows_dropped_and_empty_table(spark):
    dropped = [(c, t) for c in range(400) for t in range(2) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    rows = [(c, t, "user", "a.") for c, t in dropped]
    got = set(map(tuple, dialogue.digests(dialogue.damaged(frame(spark, rows))).collect()))
    assert got == {(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, _ in dropped}
    none = frame(spark, rows).where("false")
    assert dialogue.digests(dialogue.damaged(none)).count() == 0 and dialogue.repair(none).count() == 0
