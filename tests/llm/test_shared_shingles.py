"""Links across components: small and large sub-keys, blocks, and the bounds against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import minhash


@pytest.mark.parametrize("block", (4, 2048))
def test_partner_outside_large_buckets_is_found(spark, docs, monkeypatch, block):
    """1 and 2 are near; the hub of their one bucket is 3, which links neither; 1 is also in the bucket of 10 to 14."""
    text = lambda x: " ".join(f"{x}w{i}" for i in range(60))
    slots = {1: (1, 2, 11, 12), 2: (102, 2, 112, 12), 3: (3, 2, 13, 12)} | {i: (1, 100 + i, 11, 200 + i) for i in range(10, 15)} | {i: (3, 100 + i, 13, 200 + i) for i in range(20, 44)}
    schema, sets, chunks = minhash.SIGNED, minhash.sets, minhash.V.chunks

    def sign(k):
        def run(batches):
            for batch in batches:
                for t in chunks(batch.column(1)):
                    ids = batch.column(0).slice(t.first, t.rows)
                    n = [len(s) for s in sets(t, k)]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), ids, ids, pa.array([slots[i] for i in ids.to_pylist()], pa.list_(pa.int64())), pa.array([np.zeros(8, np.uint16).tobytes()] * t.rows, pa.binary())], names=schema.fieldNames())

        return run

    monkeypatch.setattr(minhash, "_sign", sign)
    monkeypatch.setattr(minhash, "TABLES_SIDE", 2)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = [(i, text("a") + " tail" if i == 2 else text("a") if i == 1 else text(f"x{i}")) for i in slots]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(rows)).collect()}
    assert got == {i: 1 if i == 2 else i for i in slots}


@pytest.mark.parametrize("blocks", (1, 2))
def test_linked_pairs_equal_brute_force(blocks):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (6, 60)).astype(np.uint64)
    hashes = []
    for i in range(90):
        h = base[i % 6].copy()
        edits = rng.integers(0, 12)
        h[rng.choice(60, edits, replace=False)] = rng.integers(0, 400, edits).astype(np.uint64)
        hashes.append(np.unique(h))
    n = np.array([len(h) for h in hashes])
    comp, block = rng.integers(0, 30, 90), rng.integers(0, blocks, 90)
    keys = rng.integers(0, 3, (90, 4))
    found = set()
    for slot in (0, 1):
        for u in range(3):
            rows = np.flatnonzero(keys[:, slot] == u)
            x, y = minhash.linked_pairs(n[rows], comp[rows], keys[rows], slot, block[rows], [hashes[r] for r in rows], 80, side=2)
            got = {(int(rows[a]), int(rows[b])) for a, b in zip(x, y)}
            assert not found & got
            found |= got
    want = set()
    for a in range(90):
        for b in range(a + 1, 90):
            both = len(np.intersect1d(hashes[a], hashes[b]))
            meets = (keys[a] == keys[b])[:2].any() and (keys[a] == keys[b])[2:].any()
            if comp[a] != comp[b] and meets and 100 * both >= 80 * (n[a] + n[b] - both) and (blocks == 1 or block[a] != block[b]):
                want.add((a, b))
    assert found == want and want
