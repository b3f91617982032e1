"""Every stage of the pipeline on its own input, and the whole run."""

import re

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tallyloom.llm import bytebpe, pii, store

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_and_run(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, labels = docs.columns, {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs, _ = store.written(stage(spark, before, sf_dir), f"test-{name}")
        seen[name] = (before, docs)
        if name != "tokens":
            assert docs.columns == columns

    before, after = ({r.doc_id for r in df.collect()} for df in seen["quality"])
    good, bad = ({i for i in before if labels.get(i) == y} for y in (1, 0))
    assert len(good & after) >= 0.9 * len(good) and len(bad & after) <= 0.1 * len(bad)

    rows = {r.doc_id: r.text for r in seen["near_dedup"][0].collect()}
    sets = {}
    for i, t in rows.items():
        w = WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}
    head = {i: i for i in sets}
    for _ in range(20):
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    head[a] = head[b] = min(head[a], head[b])
        if all(head[head[i]] == head[i] for i in head):
            break
    assert {r.doc_id for r in seen["near_dedup"][1].collect()} == {i for i in head if head[i] == i}

    before, after = ({r.doc_id: r for r in df.collect()} for df in seen["pii"])
    assert {i: pii.masked(r.text) for i, r in before.items()} == {i: r.text for i, r in after.items()}
    assert all(r.n_chars == len(r.text) for r in after.values())

    before, after = (df.collect() for df in seen["mix"])
    size = lambda rs, s: sum(len(WORD.findall(r.text)) for r in rs if r.source == s)
    sources = sorted({r.source for r in before})
    total, weight = sum(size(before, s) for s in sources), [1 + i % 3 for i in range(len(sources))]
    for s, w in zip(sources, weight):
        largest = max(len(WORD.findall(r.text)) for r in before if r.source == s)
        if total * w / sum(weight) < 3 * size(before, s):
            assert abs(size(after, s) - total * w / sum(weight)) <= 0.15 * total * w / sum(weight) + largest
        assert size(after, s) <= 3 * size(before, s)

    vocab = bytebpe.vocabulary(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in seen["tokens"][0].collect()}
    got = seen["tokens"][1].collect()
    assert len(got) == seen["tokens"][0].count() and all(r.round_trip for r in got)
    for r in got[:40]:
        assert np.array_equal(r.ids, enc.encode_ordinary(texts[r.doc_id]))

    again = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.n_tokens) for r in again.collect()) == sorted((r.doc_id, r.n_tokens) for r in got)
