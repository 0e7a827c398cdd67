"""N-gram Jaccard self-join by vertical partitioning.

Every document is the set of its distinct 5-word shingles (64-bit hashes). All shingles have one global order: rare ones
before common ones, by powers of two of their counts, then by hash. The order is cut into fragments:

* the *head* of a document, the first ``n - ceil(0.75 n) + 1`` shingles: two documents that link share one of these;
* the *body*, cut by hash value into ``FRAGMENTS`` vertical partitions. For each candidate pair the overlap of every
  partition is counted separately, and the partial counts are summed per pair. No task needs two whole sets.

Documents with equal sets are one class before anything is joined, so copies cost one row. A shingle at place p of n
leaves n - p shingles from it on. At the first shingle that a linking pair shares, both leave at least
num (na + nb) / (num + den), what such a pair shares in all; so only postings that leave enough are compared, and of the
smaller set only its first n - ceil(6 n / 7) + 1 shingles are looked up. Pairs come in two steps:

* star rounds: in each bucket, of a shingle and a band of sizes, the class with the fewest shingles before it leads and is
  compared with the others; found links merge components, so that a group of copies becomes one component by as many
  comparisons as it has members;
* the exact rest: whatever two components still meet in a bucket is compared pair by pair, first by the overlap of the
  heads (with the bound that it gives for the whole), then by the bodies. No link between components is lost, and the
  pairs inside a component are never built: members of a bucket's largest component are joined with the others only.

Defined results: null or wordless texts have an empty set and component_id = doc_id. A row with null doc_id gets its
n_shingles, and null component_id, and links nothing. Repeated rows appear as often as they come in. Only
``id_col`` and ``text_col`` are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, U, as_long, chunks, cut, drop, mix, shingle_sets
from .components import connected_components

#: Words of a shingle, and the similarity as a fraction.
N, NUM, DEN = 5, 75, 100
#: Vertical partitions of the body.
FRAGMENTS = 8
#: A shingle is common from so many occurrences on; at most COMMON_MAX shingles are held as common. Those with a hash below
#: COUNTED, which come first in the order of the rare ones, are counted exactly, others as far as batches show them.
COMMON, COMMON_MAX, COUNTED = 16, 1 << 20, 1 << 63
#: Star rounds before the exact step: one where any components meet, then more, to ROUNDS at most, as long as that step
#: would look at more than WORK pairs a posting and the round before found links among one in YIELD of its pairs.
ROUNDS, WORK, YIELD = 6, 4, 8
#: Ratio of sizes in a band of the exact step.
BAND = 1.2

def head_size(n: np.ndarray | int, num: int = NUM, den: int = DEN):
    """Shingles that must be compared so that no pair of the similarity is missed."""
    return n - (num * n + den - 1) // den + 1


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    for batch in batches:
        for start, held in chunks(batch.column(batch.num_columns - 1).to_pylist()):
            yield batch, start, shingle_sets(held, n)


def _common(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(h, c): of about four million at a time the shingles with a hash below COUNTED, and others that come twice."""
    held, total = [], 0

    def counted():
        h, c = np.unique(np.concatenate(held), return_counts=True)
        keep = (c >= 2) | (h < U(COUNTED))
        return pa.RecordBatch.from_arrays([pa.array(as_long(h[keep])), pa.array(c[keep].astype(np.int64))], ["h", "c"])

    for _, _, sets in _sets(batches, n):
        held += sets
        total += sum(map(len, sets))
        if total >= 4_000_000:
            yield counted()
            held, total = [], 0
    if total:
        yield counted()


def common_shingles(docs: DataFrame, text_col: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the commonest shingles, COMMON_MAX at most.

    It only sets the global order: any set gives the same links, so the bound costs speed alone.
    """
    found = docs.select(text_col).mapInArrow(lambda it: _common(it, n), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= COMMON)
    found = cut(found)
    sizes = {r.k: r.n for r in found.groupBy(F.floor(F.log2("c")).alias("k")).agg(F.count("*").alias("n")).collect()}
    least, total = 0, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > COMMON_MAX:
            least = 2 ** (k + 1)
            break
    rows = found.where(F.col("c") >= least).toArrow()
    h, c = rows["h"].to_numpy().view(U), rows["c"].to_numpy()
    drop(found)
    order = np.argsort(h)
    return h[order], c[order]


def _heads(batches: Iterator[pa.RecordBatch], n: int, common, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """(id, n, s1, s2, head): size, 128-bit signature, and head shingles in the global order."""
    known, counts = common.value
    power = np.floor(np.log2(np.maximum(1, counts))).astype(np.int8)
    for batch, start, sets in _sets(batches, n):
        sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        rank = np.zeros(len(every), np.int8)
        if len(known):
            at = np.minimum(np.searchsorted(known, every), len(known) - 1)
            rank = np.where(known[at] == every, power[at], 0)
        stop = np.cumsum(sizes)
        s1, s2 = signatures(sets)
        heads = []
        for m, e in zip(sizes.tolist(), stop.tolist(), strict=True):
            order = np.argsort(rank[e - m : e], kind="stable")
            heads.append(every[e - m : e][order[: head_size(m, num, den) if m else 0]])
        ids = batch.column(0).slice(start, len(sets))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in heads])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(as_long(np.concatenate(heads))))
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), pa.array(as_long(s1)), pa.array(as_long(s2)), lists], ["id", "n", "s1", "s2", "head"])


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums per set."""
    s1 = np.array([x.sum() for x in sets], U)
    return s1, np.array([mix(x ^ U(0xA5A5A5A5A5A5A5A5)).sum() for x in sets], U)


def _bodies(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(cid, part, body): a set's vertical partitions, of rows (cid, s1, s2, text) whose text has that signature."""
    shift = U(64 - int(math.log2(FRAGMENTS)))
    for batch, start, sets in _sets(batches, n):
        cids, *wanted = (batch.column(k).slice(start, len(sets)).to_pylist() for k in range(3))
        out = [[], [], []]
        sigs = zip(*(as_long(x).tolist() for x in signatures(sets)), strict=True)
        for cid, sig, want, own in zip(cids, sigs, zip(*wanted, strict=True), sets, strict=True):
            if sig != want:  # another text under the same id
                continue
            at = np.searchsorted(own >> shift, np.arange(FRAGMENTS + 1).astype(U))
            for k in range(FRAGMENTS):
                if at[k] < at[k + 1]:
                    for col, v in zip(out, (cid, k, as_long(own[at[k] : at[k + 1]])), strict=True):
                        col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["cid", "part", "body"])


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to broadcast if it has BROADCAST_ROWS or fewer; else the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id): one row per row of ``docs``; see the module's text."""
    return _Join(docs, id_col, text_col, n, num, den).run()


class _Join:
    """One join: tables of classes (cid, rep, s1, s2, n) and postings (h, cid, n, p, i, use), and what links them so far."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int):
        self.n, self.num, self.den = n, num, den
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        self.edges: list[DataFrame] = []
        self.comps: DataFrame | None = None

    def run(self) -> DataFrame:
        self.prepare()
        live, count, work = self.meeting()
        for turn in range(ROUNDS):
            if work <= (WORK * count if turn else 0):
                break
            pairs, links = self.merge(self.star(live, turn))
            if not links:
                break
            drop(live)
            live, count, work = self.meeting()
            if links * YIELD < pairs:
                break
        self.merge(self.rest(live))
        drop(live, self.post)
        return self.result()

    def prepare(self) -> None:
        n, num, den = self.n, self.num, self.den
        sc = self.docs.sparkSession.sparkContext
        common = sc.broadcast(common_shingles(self.docs, "text", n))
        rows = self.docs.mapInArrow(lambda it: _heads(it, n, common, num, den), "id long, n long, s1 long, s2 long, head array<long>")
        whole = cut(rows.withColumn("row", F.monotonically_increasing_id()))
        common.unpersist()
        wordy = whole.where("n > 0 and id is not null")
        # rows whose set another row has too, but for the first of each
        first = wordy.groupBy("s1", "s2", "n").agg(F.count("*").alias("c"), F.min(F.struct("id", "row")).alias("x")).where("c > 1").select("s1", "s2", "n", F.col("x.row").alias("first"))
        copies = cut(wordy.select("s1", "s2", "n", "id", "row").join(first, ["s1", "s2", "n"]).where("row != first").select("row", "id", "s1", "s2"))
        self.repeated = not cut(wordy.groupBy("id", "s1", "s2").count().where("count > 1")).isEmpty()
        one = wordy.join(few(copies.select("row"), copies.count()), "row", "left_anti").withColumnRenamed("row", "cid")
        self.classes = cut(one.select("cid", F.col("id").alias("rep"), "s1", "s2", "n"))
        # postings of the heads, one row a class, of shingles that at least two classes have; i: whether a smaller set looks
        # it up, use: whether any class does
        index = F.lit(num + den) * (F.col("n") - F.col("p")) >= F.lit(2 * num) * F.col("n")
        post = one.select("cid", "n", F.posexplode("head").alias("p", "h")).withColumn("i", index)
        often = post.groupBy("h").agg(F.count("*").alias("c"), F.max("i").alias("use")).where("c > 1").select("h", "use")
        self.post = cut(post.join(often, "h").select("h", "cid", "n", "p", "i", "use"))
        self.sized = cut(whole.select("id", "n", "s1", "s2"))
        drop(whole, copies)

    def fits(self) -> Column:
        """Whether x and y have similar sizes and each leaves, from its place on, what they share if they link."""
        num, den, c = F.lit(self.num), F.lit(self.den), F.col
        both = c("x.n") + c("y.n")
        enough = lambda s: (num + den) * (c(f"{s}.n") - c(f"{s}.p")) >= num * both
        return (den * F.least("x.n", "y.n") >= num * F.greatest("x.n", "y.n")) & enough("x") & enough("y")

    def meeting(self) -> tuple[DataFrame, int, int]:
        """(postings of shingles where components meet, with comp and big, the shingle's largest; their number; the pairs that the exact step would look at)."""
        post = self.post.where("use").drop("use")
        known = post.withColumn("comp", F.col("cid")) if self.comps is None else post.join(self.comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        sizes = known.groupBy("h", "comp").agg(F.count("*").alias("m"), F.count_if("i").alias("looked"))
        met = sizes.groupBy("h").agg(F.max_by(F.struct("comp", "m"), F.struct("m", "comp")).alias("big"), F.sum("m").alias("c"), F.sum("looked").alias("looked")).where("big.m < c and looked > 0")
        live = cut(known.join(met.select("h", F.col("big.comp").alias("big")), "h"))
        small, large = self.sides(live)
        counted = small.select("h", "band", "side", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(large.select("h", "band", "side", F.lit(0).alias("a"), F.lit(1).alias("b")))
        work = cut(counted.groupBy("h", "band", "side").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("work")))
        found = live.count(), work.first().work
        drop(work)
        return live, *found

    def sides(self, live: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The exact step's two sides by (h, band, side): smaller sets that look a shingle up, and those that they may meet.

        The band is that of the smaller size; a larger set is in the bands of all sizes that it can link with from its place
        on. Members of a shingle's largest component (side 1) meet the other members only.
        """
        num, den, c = self.num, self.den, F.col
        band = lambda x: F.floor(F.log(x) / math.log(BAND)).cast("int")
        own = (c("comp") == c("big")).cast("int")
        small = live.where("i").select("h", band(c("n")).alias("band"), own.alias("side"), F.struct("cid", "n", "p", "comp").alias("x"))
        least, most = F.lit(num) * c("n") / den, F.least(c("n").cast("double"), (F.lit(den) * c("n") - F.lit(num + den) * c("p")) / num)
        bands = F.explode(F.sequence(band(F.greatest(F.lit(1.0), least - 0.5)), band(most + 0.5)))
        spread = live.where(most + 0.5 >= least).select("h", bands.alias("band"), own.alias("own"), F.struct("cid", "n", "p", "comp").alias("y"))
        large = spread.select("h", "band", F.explode(F.when(c("own") == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"), "y")
        return small, large

    def star(self, live: DataFrame, turn: int) -> DataFrame:
        """Pairs of a shingle's members with the leads of its bands: the class with the fewest shingles before this one, in later turns also of another component each time."""
        c = F.col
        # at first by the exact share, so that a group's centre leads under all of its shingles and pairs repeat
        share, wide = c("p") / c("n"), F.floor(F.log("n") / math.log(self.den / self.num))
        order = F.struct(F.floor(share * 20), F.xxhash64("comp", F.lit(turn)), "cid") if turn else F.struct(share, "cid")
        lead = live.groupBy("h", wide).agg(F.min_by(F.struct("cid", "n", "p", "comp"), order).alias("y")).select("h", "y")
        pairs = live.alias("x").join(lead, "h").where("comp != y.comp").where(self.fits())
        return pairs.select(c("x.cid").alias("a"), c("y.cid").alias("b"), c("x.n").alias("na"), c("y.n").alias("nb")).distinct()

    def rest(self, live: DataFrame) -> DataFrame:
        """Pairs of all other members of different components that may link."""
        c = F.col
        small, large = self.sides(live)
        one_way = (c("x.n") < c("y.n")) | ((c("x.n") == c("y.n")) & (c("x.cid") < c("y.cid")))
        both = small.join(large, ["h", "band", "side"]).where(one_way & (c("x.comp") != c("y.comp")) & self.fits())
        return both.select(c("x.cid").alias("a"), c("y.cid").alias("b"), c("x.n").alias("na"), c("y.n").alias("nb")).distinct()

    def merge(self, pairs: DataFrame) -> tuple[int, int]:
        """(pairs, links found among them); components take them in."""
        pairs = cut(pairs)
        n = pairs.count()
        if not n:
            return 0, 0
        links = self.linked(pairs)
        drop(pairs)
        m = links.count()
        if m:
            self.edges.append(links)
            old, self.comps = self.comps, connected_components(_all(self.edges))
            drop(old)
        return n, m

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b, na, nb) those that link: partial overlaps per fragment, summed per pair.

        The head is the first fragment. Of two heads one ends first in the order; what its document shares beyond it is in
        its tail. Only where head overlap and tail can reach the similarity are the bodies read.
        """
        n, num, den, c = self.n, self.num, self.den, F.col
        ends = lambda p: p.select(c("a").alias("cid")).unionByName(p.select(c("b").alias("cid"))).distinct()
        used = cut(ends(pairs))
        # what heads share is among the postings; a head's size bounds the list
        head = cut(self.post.select("cid", "h").join(few(used, used.count()), "cid").groupBy("cid").agg(F.collect_list("h").alias("head")))
        shared = pairs.join(head.select(c("cid").alias("a"), c("head").alias("ha")), "a").join(head.select(c("cid").alias("b"), c("head").alias("hb")), "b")
        tail = lambda x: F.floor((c(x) * num + (den - 1)) / den) - 1
        can = (F.size(F.array_intersect("ha", "hb")) + F.greatest(tail("na"), tail("nb"))) * (num + den) >= F.lit(num) * (c("na") + c("nb"))
        live = cut(shared.where(can).select("a", "b", "na", "nb"))
        drop(used, head)
        rows = live.count()
        need = cut(self.classes.select("cid", "rep", "s1", "s2").join(few(ends(live), 2 * rows), "cid"))
        texts = self.docs.join(few(need, 2 * rows), self.docs["id"] == need["rep"]).select("cid", "s1", "s2", "text")
        body = texts.mapInArrow(lambda it: _bodies(it, n), "cid long, part int, body array<long>")
        body = cut(body.groupBy("cid", "part").agg(F.first("body").alias("body")) if self.repeated else body)
        left = body.join(few(live.withColumnRenamed("a", "cid"), rows), "cid").select(c("cid").alias("a"), "b", "na", "nb", "part", c("body").alias("xa"))
        right = body.join(few(live.select(c("b").alias("cid")).distinct(), rows), "cid").select(c("cid").alias("b"), "part", c("body").alias("xb"))
        part = left.join(right, ["b", "part"]).select("a", "b", "na", "nb", F.size(F.array_intersect("xa", "xb")).alias("o"))
        whole = part.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
        links = cut(whole.where(F.lit(den) * c("o") >= F.lit(num) * (c("na") + c("nb") - c("o"))).select("a", "b"))
        drop(live, need, body)
        return links

    def result(self) -> DataFrame:
        c = F.col
        out = self.classes.select("s1", "s2", "n", "cid", "rep")
        if self.comps is not None:
            least = self.comps.join(self.classes.select(c("cid").alias("node"), "rep"), "node").groupBy("comp").agg(F.min("rep").alias("least"))
            named = self.comps.join(least, "comp").select(c("node").alias("cid"), "least")
            out = out.join(named, "cid", "left").withColumn("least", F.coalesce("least", "rep"))
        else:
            out = out.withColumn("least", c("rep"))
        back = self.sized.join(out.select("s1", "s2", "n", "least", "rep"), ["s1", "s2", "n"], "left")
        own = lambda x: F.when(c("id").isNull(), None).when(c("n") == 0, c("id")).otherwise(c(x)).cast("long")
        done = cut(back.select(c("id").alias("doc_id"), c("n").cast("long").alias("n_shingles"), own("least").alias("component_id"), own("rep").alias("class_id")))
        drop(self.classes, self.sized, self.comps, *self.edges)
        return done


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
whole AS (SELECT doc_id, string_agg(g, '|' ORDER BY g) AS k FROM sets GROUP BY doc_id),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id FROM whole),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sets a JOIN sets b USING (g) GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT w.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(y)::BIGINT AS component_id,
  coalesce(any_value(cls.class_id), w.doc_id)::BIGINT AS class_id
FROM w JOIN reach ON reach.x = w.doc_id LEFT JOIN sizes ON sizes.doc_id = w.doc_id LEFT JOIN cls ON cls.doc_id = w.doc_id GROUP BY w.doc_id
"""
