"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier per code bit is learned from hashed byte n-grams (two to four bytes
of lower-cased letters, square roots of counts, unit length) by logistic regression. Decoding sums, per language, the
logistic loss of each bit's margin against that language's codeword, weighted by how well the bit did on rows held back;
the nearest codeword wins. Where the second codeword is almost as near, the row is flagged as ambiguous.

Fitting takes a bounded sample: about ``TRAIN_ROWS`` labelled rows, chosen by a hash of their id, whole texts. Prediction
reads every whole text once and shuffles nothing.

Defined results: a text that is null or has no letter is ``und`` with score 0, not ambiguous. Without any labelled row all
are ``und``. With one language every text with a letter is that language, score 1. Ties go to the first language in order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import U, chunks

#: Labelled rows to fit on (about); size of the feature table; margin of probability under which a row is ambiguous.
TRAIN_ROWS, DIM, AMBIGUOUS = 6000, 2048, 0.2
UNKNOWN = "und"
#: Columns that ``identify`` adds.
FOUND = ("__lang_pred", "__lang_score", "__lang_ambiguous", "__lang_distance")
#: ASCII letters lower-cased, bytes from 128 on as they are, everything else a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ODD = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))


def features(texts: list[bytes]) -> np.ndarray:
    """One unit row of DIM hashed n-gram weights per text; whole texts, runs of other bytes count as one space.

    Every text is followed by three zero bytes, so that no n-gram reaches into the next one.
    """
    out = np.zeros((len(texts), DIM), np.float32)
    shift = U(64 - int(math.log2(DIM)))
    buf = np.frombuffer(b"".join(b" " + t.translate(_FOLD) + b" \0\0\0" for t in texts) + bytes(4), np.uint8)
    keep = np.ones(len(buf), bool)
    keep[1:] = (buf[1:] != 32) | (buf[:-1] != 32)
    place = np.cumsum(keep) - 1
    first = np.concatenate([[0], np.cumsum([len(t) + 5 for t in texts])])
    start, end = place[first[:-1]], place[first[1:] - 3]
    b = buf[keep].astype(U)
    two = b[:-1] | b[1:] << U(8)
    three = two[:-1] | b[2:] << U(16)
    four = three[:-1] | b[3:] << U(24)
    slots = [((g * m) >> shift).astype(np.int32) for g, m in zip((two, three, four), _ODD, strict=True)]
    for i in range(len(texts)):
        for s in slots:
            own = s[start[i] : end[i]]
            if len(own):
                out[i] += np.bincount(own, minlength=DIM)
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def codebook(languages: int) -> np.ndarray:
    """(languages, bits) of +1 and -1: every split of the languages, or, beyond seven, the best of 50 random codes."""
    if languages <= 1:
        return np.ones((languages, 0), np.int8)
    if languages <= 7:
        return np.array([[1 if (c >> k) & 1 else -1 for c in range(1, 1 << (languages - 1))] for k in range(languages)], np.int8)
    bits, best = math.ceil(10 * math.log2(languages)), None
    for seed in range(50):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (languages, bits))
        apart = (bits - code.astype(int) @ code.T) // 2 + bits * np.eye(languages, dtype=int)
        if best is None or apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


def has_letter(text: str | None) -> bool:
    """Whether some character is a letter by its Unicode category (signs such as ² or ½ and numerals such as Ⅷ aren't)."""
    return bool(text) and any(map(str.isalpha, text))


class Model:
    """Fitted on rows in the order given, every fifth held back: callers bring them into an order of their own."""

    def __init__(self, x: np.ndarray, y: list[str]):
        self.languages = sorted(set(y))
        self.code = codebook(len(self.languages))
        target = self.code[[self.languages.index(v) for v in y]].astype(np.float32)
        back = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
        self.w, self.b = self._fit(x, target, ~back)
        seen = back if back.any() else ~back
        wrong = ((x @ self.w + self.b) * target <= 0)[seen].mean(axis=0) if len(y) else np.zeros(0)
        wrong = np.clip(wrong, 0.005, 0.495)
        weight = np.log((1 - wrong) / wrong)
        self.weight = weight / max(weight.sum(), 1e-9)

    @staticmethod
    def _fit(x: np.ndarray, t: np.ndarray, use: np.ndarray, rounds: int = 200, rate: float = 4.0, shrink: float = 1e-4):
        """Logistic regression of all bits at once over the rows in ``use``, by accelerated full gradients."""
        w = np.zeros((x.shape[1], t.shape[1]), np.float32)
        b = np.zeros(t.shape[1], np.float32)
        vw, vb = w.copy(), b.copy()
        share = use[:, None].astype(np.float32) / max(use.sum(), 1)
        for _ in range(rounds if len(x) else 0):
            aw, ab = w + 0.9 * vw, b + 0.9 * vb
            pull = (t / (1 + np.exp(np.clip((x @ aw + ab) * t, -30, 30))) * share).astype(np.float32)
            vw = 0.9 * vw + rate * (x.T @ pull - shrink * aw)
            vb = 0.9 * vb + rate * pull.sum(axis=0)
            w, b = w + vw, b + vb
        return w, b

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language number, probability, ambiguous, distance of the nearest codeword) per row.

        The distance is a weighted mean of losses: near 0 where all bits agree with the codeword, and ln 2 where they say
        nothing, however many languages there are.
        """
        if len(self.languages) == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool), np.zeros(len(x))
        margin = x @ self.w + self.b
        loss = np.stack([(np.log1p(np.exp(-np.clip(margin * c, -30, 30))) * self.weight).sum(axis=1) for c in self.code.astype(np.float32)], axis=1)
        p = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        ranked = np.sort(p, axis=1)
        return p.argmax(axis=1), ranked[:, -1], ranked[:, -1] - ranked[:, -2] < AMBIGUOUS, loss.min(axis=1)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(1).to_pylist()
        keys = batch.column(2)
        for start, held in chunks(batch.column(0).to_pylist()):
            x = features(held)
            rows = [np.flatnonzero(r) for r in x]
            yield pa.RecordBatch.from_arrays(
                [keys.slice(start, len(held)), pa.array(langs[start : start + len(held)], pa.string()), pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([v[r] for v, r in zip(x, rows, strict=True)], pa.list_(pa.float32()))],
                ["key", "lang", "at", "v"],
            )


def held_out(id_col: str, parts: int, out: int) -> Column:
    """crc32 of the id as text modulo ``parts`` is ``out``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == out, F.lit(False))


def sampled(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df``, by a hash of their id: the same rows in any run and order; all if there are fewer."""
    n = df.count()
    return df if n <= rows else df.where(F.pmod(F.xxhash64(F.lit("fit"), F.col(id_col)), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> Model:
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    few = sampled(rows, "id", train_rows).select("text", "lang", F.xxhash64("id", "lang", "text").alias("key"))
    x, y = _matrix(few.mapInArrow(_sparse, "key long, lang string, at array<int>, v array<float>").toArrow())
    pa.default_memory_pool().release_unused()
    return Model(x, y)


def _matrix(held: pa.Table) -> tuple[np.ndarray, list[str]]:
    """Features and languages in the order of the keys, however the rows were dealt; rows with equal keys are equal."""
    order = np.argsort(held["key"].to_numpy(), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    x, n = np.zeros((held.num_rows, DIM), np.float32), 0
    for batch in held.to_batches():
        at, v = batch.column(2), batch.column(3)
        ends, cols, values = at.offsets.to_numpy(), at.values.to_numpy(), v.values.to_numpy()
        for i in range(batch.num_rows):
            x[place[n + i], cols[ends[i] : ends[i + 1]]] = values[ends[i] : ends[i + 1]]
        n += batch.num_rows
    return x, held["lang"].take(pa.array(order)).to_pylist()


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with __lang_pred, __lang_score, __lang_ambiguous and __lang_distance, one pass without a shuffle.

    Columns of ``docs`` that have such a name already are replaced.
    """
    docs = docs.drop(*FOUND)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = StructType(list(docs.schema.fields))
    for name, kind in zip(FOUND, ("string", "double", "boolean", "double"), strict=True):
        schema = schema.add(name, kind)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            lang, score, flag, far = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool), np.full(len(texts), math.log(2))
            for start, part in chunks(texts) if m.languages else ():
                n, p, unsure, distance = m.predict(features(part))
                for j in range(len(part)):
                    if has_letter(texts[start + j]):
                        lang[start + j], score[start + j], flag[start + j], far[start + j] = m.languages[n[j]], p[j], unsure[j], distance[j]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang), pa.array(score), pa.array(flag), pa.array(far)], names=[*batch.schema.names, *FOUND])

    return docs.mapInArrow(scan, schema)


def predicted_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous); learned from the rows that aren't held out."""
    out = held_out(id_col, 4, 2)
    model = fit(docs.where(~out), text_col, lang_col, id_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    found = identify(rows, model, "text")
    return found.select("doc_id", "held_out", F.col("__lang_pred").alias("lang_pred"), F.col("__lang_score").alias("score"), F.col("__lang_ambiguous").alias("ambiguous"))
