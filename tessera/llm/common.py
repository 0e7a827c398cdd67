"""Shared helpers of the training-data operators: lineage cuts, word windows and shingle hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

U = np.uint64

# Multipliers of the splitmix64 finaliser and two odd bases for polynomial hashing.
MIX_1, MIX_2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

#: Text bytes that one vectorised step hashes at most (a longer text is one step by itself).
CHUNK_BYTES = 1 << 19
#: Rows that the driver broadcasts as a join side; above it the join shuffles.
BROADCAST_ROWS = 1_000_000


#: Removes an execution's shuffle files when it ends, instead of whenever the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or else that of the context.

    Where neither is set, a local master gets a temporary one; on a cluster there is none that all would share.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or (found.get() if found.isDefined() else None)
    if not known:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="tessera-")
    if not found.isDefined():
        sc.setCheckpointDir(known)
    return known


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared checkpoint folder and reads it from there: lost executors don't undo it.

    The shuffles behind it go at once; the table goes with ``drop``, or at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, "cut")
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables that ``cut`` wrote and that nothing reads any more."""
    for t in tables:
        if t is not None and getattr(t, "_cut_path", None):
            remove(t.sparkSession, t._cut_path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``fresh_dir`` named."""
    at, fs = _file_system(spark, path)
    fs.delete(at, True)


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new path in the application's part of the shared folder; that part is deleted when the driver ends."""
    own = f"{shared_dir(spark).rstrip('/')}/tessera-{spark.sparkContext.applicationId}"
    at, fs = _file_system(spark, own)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{own}/{what}-{uuid.uuid4().hex}"


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def mix(x):
    """splitmix64's finaliser, a bijection of 64-bit values."""
    x = (x ^ (x >> U(30))) * MIX_1
    x = (x ^ (x >> U(27))) * MIX_2
    return x ^ (x >> U(31))


_LETTERS = mix(np.arange(1, 257, dtype=U) * U(BYTE_BASE)) | U(1)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE_INVERSE = pow(BYTE_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; grown by doubling and kept while it is short."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, U)
        while len(have) < n:
            have = np.concatenate([have, have * U(pow(base, len(have), 1 << 64))])
        if len(have) <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, first byte and end byte of each word ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased.

    Offsets are bytes in the texts laid one after another with one space between.
    """
    joined = (b" ".join(texts) + b" ").translate(_LOWER)
    buf = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    first, end = edge[0::2], edge[1::2]
    sums = np.empty(len(buf) + 1, U)
    sums[0] = 0
    np.cumsum(_LETTERS[buf] * powers(BYTE_BASE, len(buf)), out=sums[1:])
    h = mix((sums[end] - sums[first]) * powers(_BASE_INVERSE, len(buf))[first] + (end - first).astype(U))
    return h, np.searchsorted(ends, first, side="right"), first, end


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; windows that cross texts are for the caller to leave out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U)
    q = powers(WORD_BASE, k)
    out = h[:n] * q[0]
    for i in range(1, k):
        out += h[i : n + i] * q[i]
    return mix(out)


def chunks(texts, size: int = CHUNK_BYTES):
    """(start, list of UTF-8 texts) over a sequence of str or None, about ``size`` bytes each."""
    held, start, total = [], 0, 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if held and total + len(b) > size:
            yield start, held
            held, start, total = [], i, 0
        held.append(b)
        total += len(b)
    if held:
        yield start, held


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; fewer words: one for the whole; none: empty."""
    h, doc, _, _ = word_hashes(texts)
    count = np.bincount(doc, minlength=len(texts))
    stop = np.cumsum(count)
    w = window_hashes(h, k)
    out = []
    for c, e in zip(count.tolist(), stop.tolist(), strict=True):
        if c >= k:
            s = np.sort(w[e - c : e - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif c:
            out.append(mix((h[e - c : e] * powers(WORD_BASE, c)).sum(keepdims=True) + U(c)))
        else:
            out.append(np.empty(0, U))
    return out
