"""Quality classifier: a factorisation machine over hashed words, structure and length.

Score of a text with features x: ``sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))``,
the pairwise interactions in time linear in the text's distinct words.

Features: hashed case-folded words (weight: share of the text's words, square
root), structure statistics (repeats, case, punctuation, digits, word lengths,
lines) and the text's length as metadata. Labels, language, source and ids are
never inputs. Training rows are a bounded sample of the labelled rows
(``max_rows``, by a hash of the id, so that reruns agree); everything else
covers all rows.

Null or empty text: its statistics are zero and it is scored like any other.
Null ids: scored, never trained on; ``held_out`` is null. Texts are read whole, however long. Empty table: no rows. A label row that is
null, not 0 or 1, or contradicts another of its id is left out of training.
With labels of one class only, or none, every text gets that class's (or
label 1's) score. Repeated rows are scored alike. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import vectext as V

BUCKET_BITS = 15
N_STATS = 14
STATS_AT = 1 << BUCKET_BITS
DIM = STATS_AT + N_STATS
BATCH = 64


def features(t: V.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of a chunk, rows ascending, features distinct within a row."""
    w = V.Words(t)
    h = w.hashes(t, fold_case=True)
    n = w.n
    row = np.repeat(np.arange(t.rows), n)
    bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    key, count = np.unique((row << BUCKET_BITS) | bucket, return_counts=True)
    r, f = key >> BUCKET_BITS, key & (STATS_AT - 1)
    x = np.sqrt(count / n[r])

    d = t.data
    size = np.diff(t.off)
    some = np.maximum(size, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[t.off[1:]] - total[t.off[:-1]]) / some

    words = np.maximum(n, 1)
    distinct = np.bincount(r, minlength=t.rows)
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    length = w.end - w.start
    per = lambda v: np.bincount(row, v, minlength=t.rows) / words
    mean = per(length.astype(float))
    upper, lower = (d >= 65) & (d <= 90), (d >= 97) & (d <= 122)
    punct = (d > 32) & (d < 127) & ~upper & ~lower & ~((d >= 48) & (d <= 57))
    stats = np.stack(
        [
            np.log1p(size) / 10,
            np.log1p(n) / 8,
            distinct / words,
            per(same),
            np.minimum(mean, 40) / 10,
            np.minimum(np.sqrt(per((length - mean[row]) ** 2.0)), 40) / 10,
            share(upper) * 4,
            share(lower),
            share(punct) * 8,
            share((d >= 48) & (d <= 57)) * 8,
            share(d == 10) * 20,
            share(d >= 128) * 2,
            share((d == 124) | (d == 33) | (d == 35) | (d == 36) | (d == 37) | (d == 38) | (d == 42)) * 8,
            (np.bincount(r, count * (count > 1), minlength=t.rows) / words),
        ],
        axis=1,
    )
    stats[n == 0, 2] = 0.0
    rows = np.concatenate([r, np.repeat(np.arange(t.rows), N_STATS)])
    feats = np.concatenate([f, np.tile(np.arange(STATS_AT, DIM), t.rows)])
    vals = np.concatenate([x, stats.reshape(-1)])
    order = np.argsort(rows, kind="stable")
    return rows[order], feats[order], vals[order]


@dataclass
class Machine:
    """Weights of a factorisation machine."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    prior: float | None = None  # a score for all, if it couldn't be trained

    def margins(self, row: np.ndarray, feat: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
        out = np.bincount(row, self.w[feat] * x, minlength=rows) + self.w0
        for f in range(self.v.shape[1]):
            vx = self.v[feat, f] * x
            out += 0.5 * (np.bincount(row, vx, minlength=rows) ** 2 - np.bincount(row, vx * vx, minlength=rows))
        return out

    def scores(self, t: V.Texts) -> np.ndarray:
        if self.prior is not None:
            return np.full(t.rows, self.prior)
        return 1 / (1 + np.exp(-np.clip(self.margins(*features(t), t.rows), -30, 30)))


#: Numbers of mini-batches among which the training rows themselves decide.
STEPS = (80, 160, 320, 640, 1280)


def fit(row: np.ndarray, feat: np.ndarray, x: np.ndarray, y: np.ndarray, rank: int = 6, steps: int | None = None, rate: float = 0.08, decay: float = 2e-5, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss, in a fixed order of mini-batches.

    ``steps`` of them; None: the number of ``STEPS`` with the least loss on a fifth of these
    rows, when trained on the others. Rows that are held out from training play no part.
    """
    if steps is None:
        rest = np.random.default_rng(seed + 1).permutation(len(y)) % 5 == 0
        mine = rest[row]
        number = np.cumsum(~rest) - 1
        if rest.any() and len(set(y[~rest])) > 1:
            part = (np.cumsum(rest) - 1)[row[mine]], feat[mine], x[mine]
            loss = {}
            for done, m in _descend(number[row[~mine]], feat[~mine], x[~mine], y[~rest], rank, STEPS, rate, decay, seed):
                margin = np.clip(m.margins(*part, int(rest.sum())), -30, 30)
                loss[done] = float(np.mean(np.log1p(np.exp(-margin * (2 * y[rest] - 1)))))
            steps = min(loss, key=loss.get)
        else:
            steps = STEPS[-2]
    return [m for _, m in _descend(row, feat, x, y, rank, (steps,), rate, decay, seed)][-1]


def _descend(row: np.ndarray, feat: np.ndarray, x: np.ndarray, y: np.ndarray, rank: int, stops: tuple[int, ...], rate: float, decay: float, seed: int) -> Iterator[tuple[int, Machine]]:
    """(mini-batches done, the machine) at each of the stops, ascending."""
    rows, done = len(y), 0
    rng = np.random.default_rng(seed)
    m = Machine(float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), np.zeros(DIM), rng.normal(0, 0.02, (DIM, rank)))
    gw, gv, g0 = np.full(DIM, 1e-2), np.full((DIM, rank), 1e-2), 1e-2
    limits = np.searchsorted(row, np.arange(rows + 1))
    while True:
        order = rng.permutation(rows)
        for a in range(0, rows, BATCH):
            b = order[a : a + BATCH]
            take = V.ragged(limits[b], limits[b + 1] - limits[b])
            r, f, z = np.repeat(np.arange(len(b)), limits[b + 1] - limits[b]), feat[take], x[take]
            vx = m.v[f] * z[:, None]
            sums = np.stack([np.bincount(r, vx[:, k], minlength=len(b)) for k in range(rank)], 1)
            out = m.w0 + np.bincount(r, m.w[f] * z, minlength=len(b)) + 0.5 * ((sums**2).sum(1) - np.bincount(r, (vx**2).sum(1), minlength=len(b)))
            g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[b]) / len(b) * 16
            used, at = np.unique(f, return_inverse=True)
            dw = np.bincount(at, g[r] * z, minlength=len(used)) + decay * m.w[used]
            part = g[r][:, None] * z[:, None] * (sums[r] - vx)
            dv = np.stack([np.bincount(at, part[:, k], minlength=len(used)) for k in range(rank)], 1) + decay * m.v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            g0 += g.sum() ** 2
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= rate * 0.5 * dv / np.sqrt(gv[used])
            m.w0 -= rate * g.sum() / np.sqrt(g0)
            done += 1
            if done in stops:
                yield done, m
            if done == stops[-1]:
                return


_SAMPLE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("feat", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.FloatType()))])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in V.chunks(batch.column(1)):
            row, feat, x = features(t)
            limits = pa.array(np.searchsorted(row, np.arange(t.rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(t.first, t.rows), batch.column(2).slice(t.first, t.rows), pa.ListArray.from_arrays(limits, pa.array(feat, pa.int32())), pa.ListArray.from_arrays(limits, pa.array(x, pa.float32()))],
                names=_SAMPLE.fieldNames(),
            )


def held_out(id_col: str) -> F.Column:
    """True where crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fit on at most ``max_rows`` labelled rows outside the held-out quarter.

    Only their features reach the driver: at most ``max_rows`` rows, each of at most
    ``2**BUCKET_BITS`` features. The sample's ids (``max_rows`` of them, a fixed
    bound) are broadcast to the scan of the texts, which so needs no shuffle.
    """
    y = F.col(label_col).cast("int")
    picked = (
        labels.select(F.col(id_col).alias("doc_id"), y.alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("most"))
        .where("y = most")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
        .select("doc_id", "y")
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")
    got = rows.mapInArrow(_featurise, _SAMPLE).toPandas().sort_values("doc_id", kind="stable")
    target = got["y"].to_numpy(dtype=float)
    if len(set(target)) < 2:
        return Machine(0.0, np.zeros(DIM), np.zeros((DIM, 1)), prior=float(target[0]) if len(target) else 1.0)
    n = got["feat"].map(len).to_numpy()
    return fit(np.repeat(np.arange(len(got)), n), np.concatenate(got["feat"].to_numpy()).astype(np.int64), np.concatenate(got["x"].to_numpy()).astype(float), target)


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row. A map over the scan."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # a fixed size: DIM x (rank + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for t in V.chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.rows).cast(pa.int64()), pa.array(m.scores(t), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep(docs: DataFrame, machine: Machine, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` scored at or above the threshold, all columns as they were."""
    schema = docs.schema
    at = schema.fieldNames().index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            good = [m.scores(t) >= threshold for t in V.chunks(batch.column(at))]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, schema)
