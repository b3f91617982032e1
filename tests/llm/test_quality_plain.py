"""The quality score of whole texts against plain loops: features word by word, interactions pair by pair."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np

from tallyloom.llm import quality, vectext

TEXTS = [
    None, "", " \n\t ", "one", "One ONE one", "Plain prose, of 12 words.\nAnd a line; or two!", "BUY!! NOW!! | $$$ 100% #win #win & *", "é ü été naïve 日本 語", "a\x0bb\x0cc\rd",
    "word " * 5000 + "end", "longword" * 3000, " ".join(f"w{i % 90}" for i in range(20_000)), "x" * 45 + " " + "y" * 60,
]


def bucket(word):
    data = np.frombuffer(word, np.uint8)
    h = vectext.string_hashes(data, np.array([0]), np.array([len(data)]))[0][0]
    return int(h) >> (64 - quality.BUCKET_BITS)


def plain_features(text):
    b = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", b)
    folded = [w.lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    n, size = len(words), max(len(b), 1)
    hashed = {w: bucket(w) for w in set(folded)}
    count = Counter(hashed[w] for w in folded)
    out = {k: math.sqrt(c / n) for k, c in count.items()}
    some = max(n, 1)
    mean = sum(map(len, words)) / some
    deviation = math.sqrt(sum((len(w) - mean) ** 2 for w in words) / some)
    share = lambda test: sum(1 for c in b if test(c)) / size
    alpha, digit = (lambda c: 65 <= c <= 90 or 97 <= c <= 122), (lambda c: 48 <= c <= 57)
    stats = [
        math.log1p(len(b)) / 10, math.log1p(n) / 8, len(count) / some if n else 0.0, sum(x == y for x, y in itertools.pairwise(folded)) / some, min(mean, 40) / 10, min(deviation, 40) / 10,
        share(lambda c: 65 <= c <= 90) * 4, share(lambda c: 97 <= c <= 122), share(lambda c: 32 < c < 127 and not alpha(c) and not digit(c)) * 8, share(digit) * 8, share(lambda c: c == 10) * 20, share(lambda c: c >= 128) * 2,
        share(lambda c: chr(c) in "|!#$%&*") * 8, sum(c for c in count.values() if c > 1) / some,
    ]
    return out | {quality.STATS_AT + i: v for i, v in enumerate(stats)}


def plain_score(machine, text):
    x = plain_features(text)
    margin = machine.w0 + sum(machine.w[i] * v for i, v in x.items())
    margin += sum(float(machine.v[i] @ machine.v[j]) * x[i] * x[j] for i, j in itertools.combinations(x, 2))
    return 1 / (1 + math.exp(-max(-30, min(30, margin))))


def test_scores_equal_plain_loops(spark):
    rng = np.random.default_rng(3)
    machine = quality.Machine(0.3, rng.normal(0, 0.4, quality.DIM), rng.normal(0, 0.3, (quality.DIM, 5)))
    rows = [(i, t, "en", 1.0) for i, t in enumerate(TEXTS)] + [(None, TEXTS[5], "en", 2.0), (5, TEXTS[5], "de", 3.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    want = {t: plain_score(machine, t) for t in TEXTS}
    got = quality.score(df, machine).collect()
    texts = dict(enumerate(TEXTS)) | {None: TEXTS[5]}
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r.score, want[texts[r.doc_id]], rel_tol=1e-9, abs_tol=1e-12)
        assert r.predicted == int(want[texts[r.doc_id]] >= 0.7)
        assert r.held_out is (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    kept = quality.keep(df, machine).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(repr(r) for r in rows if want[r[1]] >= 0.7)


def test_training_is_what_the_steps_say():
    """One mini-batch of the trainer against the gradient by plain loops."""
    rows = [{3: 0.5, 9: 1.0}, {9: 0.25}, {3: 1.0, 7: 0.5}]
    y = np.array([1.0, 0.0, 1.0])
    row = np.array([i for i, r in enumerate(rows) for _ in r])
    feat = np.array([f for r in rows for f in r])
    x = np.array([v for r in rows for v in r.values()])
    before = quality.fit(row, feat, x, y, rank=2, steps=1, rate=0.0, decay=0.0)
    after = quality.fit(row, feat, x, y, rank=2, steps=1, rate=0.1, decay=0.0)
    gw, gv = Counter(), {f: np.zeros(2) for f in (3, 7, 9)}
    for r, target in zip(rows, y):
        margin = before.w0 + sum(before.w[f] * v for f, v in r.items()) + sum(float(before.v[i] @ before.v[j]) * r[i] * r[j] for i, j in itertools.combinations(r, 2))
        g = (1 / (1 + math.exp(-margin)) - target) / 3 * 16
        for f, v in r.items():
            gw[f] += g * v
            gv[f] = gv[f] + g * v * (sum(before.v[k] * u for k, u in r.items()) - before.v[f] * v)
    for f in (3, 7, 9):
        assert math.isclose(after.w[f], before.w[f] - 0.1 * gw[f] / math.sqrt(0.01 + gw[f] ** 2), rel_tol=1e-9)
        assert np.allclose(after.v[f], before.v[f] - 0.05 * gv[f] / np.sqrt(0.01 + gv[f] ** 2))
