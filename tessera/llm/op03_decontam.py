"""Benchmark decontamination: SimHash over item-sized windows, a multi-index over Hamming blocks, exact verification.

A benchmark item of L words is compared with every window of L consecutive words of every whole text that holds at least
one of the benchmark's shingles (a window without one has similarity 0). Each window gets a 64-bit SimHash of its weighted
5-word shingles. Fingerprints are cut into ``BLOCKS`` blocks; two within ``RADIUS`` bits differ by at most
``RADIUS // BLOCKS`` bits in one block, so tables of the blocks' neighbours give every item within the radius. Candidates
are then verified by weighted Jaccard similarity of the two multisets of shingles, 0.75 or more.

A shingle's weight is ln(1 + items / items that hold it), so wording that many items share counts less. At 0.75 two
fingerprints differ by 11 bits on average, standard deviation 3; the radius of 22 is 3.6 deviations away.

The benchmark is the stated query set. Weights are counted once over all its items; only those of shingles that several
items hold are kept, as the others have the greatest weight, like shingles outside of the benchmark. Items are then taken
in blocks of ``BLOCK_ITEMS``, each with a broadcast of its own that is built once in a worker, so neither a broadcast nor a
task grows with the benchmark but for the shared shingles, of which ``SHARED_MAX`` are allowed (beyond it an error says
so). Results don't depend on the blocks. Documents are never shuffled.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Null, empty or wordless items and texts match
nothing. Items or texts below five words are one shingle, the whole. A document shorter than an item is one window.
Repeated rows are treated each; ties of windows go to the first.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, WORD_BASE, as_long, chunks, mix, powers, window_hashes, word_hashes

K, THRESHOLD = 5, 0.75
RADIUS, BLOCKS, BITS = 22, 8, 64
BLOCK_ITEMS, SHARED_MAX = 4096, 4_000_000
_FILTER_BITS = 22


def _hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Shingle hashes of one word sequence; below k words one for the whole."""
    if len(h) >= k:
        return window_hashes(h, k)
    return mix((h * powers(WORD_BASE, len(h))).sum(keepdims=True) + U(len(h))) if len(h) else np.empty(0, U)


class HammingIndex:
    """All fingerprints within a radius, by pigeonhole over blocks of eight bits."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        near = radius // BLOCKS
        byte = np.arange(256, dtype=np.uint8)
        distance = np.bitwise_count(byte[:, None] ^ byte[None, :])
        self.tables = np.zeros((BLOCKS, 256, (len(prints) + 7) // 8), np.uint8)
        for b in range(BLOCKS):
            own = (prints >> U(8 * b)).astype(np.uint8)
            self.tables[b] = np.packbits(distance[:, own] <= near, axis=1)

    def query(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query number, item number) of all pairs within the radius."""
        held = self.tables[0][prints.astype(np.uint8)]
        for b in range(1, BLOCKS):
            held = held | self.tables[b][(prints >> U(8 * b)).astype(np.uint8)]
        q, i = np.nonzero(np.unpackbits(held, axis=1, count=len(self.prints)))
        near = np.bitwise_count(prints[q] ^ self.prints[i]) <= self.radius
        return q[near], i[near]


class Weights:
    """Weights of shingles over all items: ``counts`` of those that more than one holds; any other has the weight ``rare``."""

    def __init__(self, items: int, counts: dict[int, int]):
        self.of = {h: math.log(1 + items / c) for h, c in counts.items()}
        self.rare = math.log(1 + items)
        self.keys = np.array(sorted(counts), U)
        self.values = np.array([self.of[int(h)] for h in self.keys])

    def each(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(h), self.rare)
        spot = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[spot] == h, self.values[spot], self.rare)


def _items(ids: list[int], texts: list[str]) -> list[tuple[int, np.ndarray]]:
    """(id, word hashes) of the items with a word."""
    words = [word_hashes([t.encode("utf-8", "surrogatepass")])[0] for t in texts]
    return [(i, w) for i, w in zip(ids, words, strict=True) if len(w)]


class Benchmark:
    """One block of items, ready for lookup."""

    def __init__(self, kept: list[tuple[int, np.ndarray]], shingles: list[np.ndarray], weights: Weights, k: int = K):
        self.k = k
        self.ids = [i for i, _ in kept]
        self.sizes = np.array([len(w) for _, w in kept], np.int64)
        self.shingles = shingles
        self.weight, self.weights, self.rare = weights.each, weights.of, weights.rare
        self.keys = np.unique(np.concatenate([*shingles, np.empty(0, U)]))
        by: dict[int, set[int]] = {}
        for n, s in zip(self.sizes.tolist(), self.shingles, strict=True):
            for h in s.tolist():
                by.setdefault(h, set()).add(n)
        self.sizes_of = [sorted(by[int(h)]) for h in self.keys]
        self.bags = [Counter(s.tolist()) for s in self.shingles]
        self.totals = [sum(self.weights.get(h, self.rare) * c for h, c in bag.items()) for bag in self.bags]
        self.short = sorted({int(n) for n in self.sizes if n < k})
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.keys >> U(64 - _FILTER_BITS)).astype(np.int64)] = True
        prints = [simhash(s, self.weight(s)) for s in self.shingles]
        self.index = HammingIndex(np.array(prints, U)) if kept else None

    def known(self, h: np.ndarray) -> np.ndarray:
        """Positions in ``h`` of benchmark shingles."""
        at = np.flatnonzero(self.maybe[(h >> U(64 - _FILTER_BITS)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        return at[self.keys[spot] == h[at]]

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of two multisets of shingles."""
        bag = Counter(window.tolist())
        both = sum(self.weights.get(h, self.rare) * min(c, bag[h]) for h, c in self.bags[item].items() if h in bag)
        total = sum(self.weights.get(h, self.rare) * c for h, c in bag.items())
        return both / (total + self.totals[item] - both)

    def matches(self, words: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """item number -> (similarity, first word, words) of the best window of one text."""
        found: dict[int, tuple[float, int, int]] = {}
        for k in [self.k, *self.short]:
            h = _hashes(words, k) if k == self.k or len(words) >= k else np.empty(0, U)
            if k != self.k and len(h):
                h = np.array([_hashes(words[i : i + k], self.k)[0] for i in range(len(words) - k + 1)], U)
            at = self.known(h)
            if not len(at):
                continue
            starts: dict[int, set[int]] = {}
            for p in at.tolist():
                spot = int(np.searchsorted(self.keys, h[p]))
                for n in self.sizes_of[spot]:
                    if (n < self.k) == (k != self.k) or len(words) < self.k:
                        span = n - k if n >= k else 0
                        last = max(0, len(words) - max(n, k))
                        starts.setdefault(n, set()).update(range(max(0, p - span), min(p, last) + 1))
            for n, own in starts.items():
                s = np.array(sorted(own))
                m = min(max(1, n - k + 1), len(h))
                prints = window_simhashes(h, self.weight, s, m)
                for q, item in zip(*self.index.query(prints), strict=True):
                    if self.sizes[item] != n:
                        continue
                    start = int(s[q])
                    sim = self.similarity(h[start : start + m], int(item))
                    if sim >= THRESHOLD and sim > found.get(int(item), (0.0, 0, 0))[0]:
                        found[int(item)] = (sim, start, min(n, len(words)))
        return found


def _signs(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").astype(np.float64) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").reshape(-1).astype(U)


def simhash(h: np.ndarray, weight: np.ndarray) -> int:
    return int(_packed((_signs(h) * weight[:, None]).sum(axis=0, keepdims=True))[0])


def window_simhashes(h: np.ndarray, weigh, starts: np.ndarray, m: int) -> np.ndarray:
    """SimHash of h[s : s + m] for each of the sorted starts, by running sums over each stretch of them."""
    out = np.empty(len(starts), U)
    cuts = np.flatnonzero(np.diff(starts) > m) + 1
    for part in np.split(np.arange(len(starts)), cuts):
        lo, hi = int(starts[part[0]]), min(int(starts[part[-1]]) + m, len(h))
        own = h[lo:hi]
        sums = np.zeros((len(own) + 1, BITS))
        np.cumsum(_signs(own) * weigh(own)[:, None], axis=0, out=sums[1:])
        a = starts[part] - lo
        # rounded, so that running sums and direct sums have the same signs
        out[part] = _packed(np.round(sums[np.minimum(a + m, len(own))] - sums[a], 9))
    return out


def _texts_with_hits(bench: Benchmark, texts: list) -> Iterator[tuple[int, dict]]:
    """(row number, matches) of the texts that match; one vectorised pass finds those that hold a shingle at all."""
    for start, held in chunks(texts):
        h, doc, _, _ = word_hashes(held)
        stop = np.searchsorted(doc, np.arange(len(held) + 1))
        hit = set(doc[bench.known(window_hashes(h, bench.k))].tolist())
        short = np.flatnonzero(np.diff(stop) < bench.k).tolist()
        rest = range(len(held)) if bench.short else short
        for i in sorted(hit | set(rest)):
            words = h[stop[i] : stop[i + 1]]
            if len(words) and (found := bench.matches(words)):
                yield start + i, found


def _item_shingles(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(h, c) of the distinct shingles of each item, and (null, number of items with a word)."""
    for batch in batches:
        kept = _items(range(batch.num_rows), batch.column(0).to_pylist())
        h = [np.unique(_hashes(w, k)) for _, w in kept]
        h, c = np.unique(np.concatenate([*h, np.empty(0, U)]), return_counts=True)
        keys = pa.concat_arrays([pa.array(as_long(h)), pa.nulls(1, pa.int64())])
        yield pa.RecordBatch.from_arrays([keys, pa.array([*c.tolist(), len(kept)], pa.int64())], ["h", "c"])


def _weights(items: DataFrame, k: int) -> Weights:
    found = items.select("t").mapInArrow(lambda it: _item_shingles(it, k), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1 or h is null")
    rows = found.limit(SHARED_MAX + 2).toArrow()
    if rows.num_rows > SHARED_MAX + 1:
        raise ValueError(f"more than {SHARED_MAX} shingles are shared by several benchmark items: split the benchmark")
    total = dict(zip(rows["h"].to_pylist(), rows["c"].to_pylist(), strict=True))
    n = total.pop(None, 0)
    return Weights(n, {h % 2**64: c for h, c in total.items()})


def _benchmarks(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, k: int) -> Iterator:
    """Functions, one for each block of items, that give the block's Benchmark on a worker; built there once."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    weights = _weights(items, k)
    sc = docs.sparkSession.sparkContext

    def block(rows):
        held = sc.broadcast((uuid.uuid4().hex, [r.i for r in rows], [r.t for r in rows], weights, k))
        return lambda: _built(*held.value)

    rows = []
    for r in items.toLocalIterator():
        rows.append(r)
        if len(rows) == BLOCK_ITEMS:
            yield block(rows)
            rows = []
    if rows:
        yield block(rows)


_BUILT: dict[str, Benchmark | None] = {}


def _built(name: str, ids: list[int], texts: list[str], weights: Weights, k: int) -> Benchmark | None:
    if name not in _BUILT:
        if len(_BUILT) >= 4:  # a worker lives for many tasks, and works on few blocks at a time
            _BUILT.pop(next(iter(_BUILT)))
        kept = _items(ids, texts)
        _BUILT[name] = Benchmark(kept, [_hashes(w, k) for _, w in kept], weights, k) if kept else None
    return _BUILT[name]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = K) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): each document and item whose best window reaches 0.75."""
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))

    def scanner(ready):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = ready()
            for batch in batches if bench else ():
                ids = batch.column(0).to_pylist()
                out = [(ids[i], bench.ids[item], sim, at, n) for i, found in _texts_with_hits(bench, batch.column(1).to_pylist()) for item, (sim, at, n) in found.items()]
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        return scan

    parts = [rows.mapInArrow(scanner(ready), schema) for ready in _benchmarks(docs, benchmark, item_col, item_text_col, k)]
    out = parts[0] if parts else docs.sparkSession.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = K) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns, one pass, no shuffle."""
    at = docs.columns.index(text_col)

    def sieve(ready):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = ready()
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for i, _ in _texts_with_hits(bench, batch.column(at).to_pylist()) if bench else ():
                    keep[i] = False
                yield batch.filter(pa.array(keep))

        return scan

    for ready in _benchmarks(docs, benchmark, item_col, item_text_col, k):
        docs = docs.mapInArrow(sieve(ready), docs.schema)
    return docs
