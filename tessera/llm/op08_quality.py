"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams over three streams of a whole text: its words (one and two), its word shapes
(one to three: case, trailing signs, whether the word repeats one of the two before it) and, per shape, the band of its
share of the text. Indicators are scaled by the log ratio of smoothed class counts, rows have unit length, and a linear
model with squared hinge loss is fitted by dual coordinate descent. A sigmoid fitted on rows held back gives the score.

Fitting takes about ``TRAIN_ROWS`` labelled rows, chosen by a hash of their id (all if there are fewer), whole texts.
Scoring reads every whole text once and shuffles nothing.

Defined results: null or wordless texts have no feature and get the score of the intercept. Labels other than 0 and 1 or
null are not learned from; without labels of both classes every score is the share of label 1 (0.5 without labels).
Repeated label rows count as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, chunks, mix, word_hashes
from .op06_langid import held_out, sampled

TRAIN_ROWS, DIM = 8000, 1 << 16
SMOOTH, COST, EPOCHS = 1.0, 1.0, 30
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 2
for _c in b".,;:!?-'\"":
    _CLASS[_c] = 4
for _c in b"|#$%&*+<=>@\\^_`{}~/()[]":
    _CLASS[_c] = 5


def _slots(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h ^ U(salt * 0x9E3779B97F4A7C15 % 2**64)) >> U(48)).astype(np.int64)


def _shapes(texts: list[bytes], h: np.ndarray, doc: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A small number per word: classes of its first, second and last two bytes, and whether it repeats a word just before."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    last = end - 1
    second = np.minimum(first + 1, last)
    before = np.maximum(last - 1, first)
    s = ((_CLASS[buf[first]].astype(U) * U(6) + _CLASS[buf[second]]) * U(6) + _CLASS[buf[before]]) * U(6) + _CLASS[buf[last]]
    again = np.zeros(len(h), U)
    again[1:] |= ((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])).astype(U)
    again[2:] |= ((h[2:] == h[:-2]) & (doc[2:] == doc[:-2])).astype(U) << U(1)
    return s * U(4) + again


def indicators(texts: list[bytes]) -> list[np.ndarray]:
    """Per text the sorted distinct feature numbers below DIM."""
    h, doc, first, end = word_hashes(texts)
    stop = np.searchsorted(doc, np.arange(len(texts) + 1))
    if not len(h):
        return [np.empty(0, np.int64)] * len(texts)
    shape = _shapes(texts, h, doc, first, end)
    one, pair = _slots(h, 1), _slots(h[:-1] * U(3) + h[1:] * U(5), 2)
    s1, s2 = _slots(shape, 3), _slots(shape[:-1] * U(40503) + shape[1:], 4)
    s3 = _slots((shape[:-2] * U(40503) + shape[1:-1]) * U(40503) + shape[2:], 5)
    out = []
    for i in range(len(texts)):
        a, b = stop[i], stop[i + 1]
        if a == b:
            out.append(np.empty(0, np.int64))
            continue
        kinds, counts = np.unique(shape[a:b], return_counts=True)
        band = np.floor(np.log2(counts / (b - a)) * 1.5).astype(np.int64) + 64
        bands = _slots(kinds * U(128) + band.astype(U), 6)
        out.append(np.unique(np.concatenate([one[a:b], pair[a : max(a, b - 1)], s1[a:b], s2[a : max(a, b - 1)], s3[a : max(a, b - 2)], bands])))
    return out


class Model:
    """Scaled indicators and a linear model; ``raw`` are margins, ``score`` probabilities."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray):
        self.ratio, self.w, self.b = np.zeros(DIM), np.zeros(DIM), 0.0
        self.slope, self.offset = 1.0, 0.0
        self.constant = None
        if not len(y) or not 0 < y.sum() < len(y):
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        back = np.arange(len(y)) % 5 == 4 if len(y) >= 100 else np.zeros(len(y), bool)
        if not 0 < y[~back].sum() < (~back).sum() or not 0 < y[back].sum() < back.sum():
            back[:] = False
        fit = np.flatnonzero(~back)
        counts = [np.full(DIM, SMOOTH), np.full(DIM, SMOOTH)]
        for i in fit:
            counts[int(y[i])][rows[i]] += 1
        self.ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        self._descend([rows[i] for i in fit], y[fit] * 2 - 1)
        seen = np.flatnonzero(back) if back.any() else fit
        self._calibrate(self.raw([rows[i] for i in seen]), y[seen])

    def _scaled(self, at: np.ndarray) -> np.ndarray:
        v = self.ratio[at]
        return v / max(np.sqrt(v @ v), 1e-9)

    def _descend(self, rows: list[np.ndarray], t: np.ndarray) -> None:
        """Dual coordinate descent of 0.5 |w|^2 + COST sum(max(0, 1 - t (w x + b))^2), classes weighted alike."""
        cost = np.where(t > 0, len(t) / (2 * (t > 0).sum()), len(t) / (2 * (t < 0).sum())) * COST
        x = [self._scaled(r) for r in rows]
        q = np.array([v @ v + 1 for v in x]) + 0.5 / cost
        alpha = np.zeros(len(t))
        rng = np.random.default_rng(0)
        for _ in range(EPOCHS):
            most = 0.0
            for i in rng.permutation(len(t)):
                at, v = rows[i], x[i]
                g = t[i] * (self.w[at] @ v + self.b) - 1 + 0.5 / cost[i] * alpha[i]
                if alpha[i] == 0 and g >= 0:
                    continue
                new = max(alpha[i] - g / q[i], 0.0)
                step = (new - alpha[i]) * t[i]
                self.w[at] += step * v
                self.b += step
                most = max(most, abs(g))
                alpha[i] = new
            if most < 1e-3:
                break

    def _calibrate(self, m: np.ndarray, y: np.ndarray) -> None:
        """Two-parameter sigmoid by Newton steps, targets smoothed by the class counts."""
        pos, neg = y.sum(), len(y) - y.sum()
        t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            r, s = t - p, p * (1 - p) + 1e-9
            g = np.array([(r * m).sum() - 1e-3 * a, r.sum()])
            hess = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
            da, db = np.clip(np.linalg.solve(hess, g), -2, 2)
            a, b = a + da, b + db
        self.slope, self.offset = max(float(a), 1e-3), float(b)

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.w[r] @ self._scaled(r) + self.b if len(r) else self.b for r in rows])

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(rows) + self.offset, -30, 30)))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y, keys = batch.column(1).to_pylist(), batch.column(2)
        for start, held in chunks(batch.column(0).to_pylist()):
            yield pa.RecordBatch.from_arrays([keys.slice(start, len(held)), pa.array(y[start : start + len(held)], pa.int32()), pa.array([r.astype(np.int32) for r in indicators(held)], pa.list_(pa.int32()))], ["key", "y", "at"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Model:
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    few = sampled(known, "id", train_rows)  # about train_rows rows of two numbers: a bounded side to broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(few), "id")
    # in an order that doesn't depend on how the rows are dealt; rows with equal keys are equal
    held = rows.select("text", "y", F.xxhash64("id", "y", "text").alias("key")).mapInArrow(_labelled, "key long, y int, at array<int>").toArrow().sort_by("key")
    at = [a.values.to_numpy().astype(np.int64) for a in held["at"]]
    return Model(at, held["y"].to_numpy() if held.num_rows else np.empty(0))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted); learned from the labels that aren't held out."""
    out = held_out(id_col, 3, 1)
    model = fit(docs, labels.where(~out), id_col, text_col, label_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in chunks(batch.column(2).to_pylist()):
                p = held.value.score(indicators(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), batch.column(1).slice(start, len(part)), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, held_out boolean, score double, predicted int")
