"""Operator 10: near-duplicate groups by ProbMinHash.

Every text is a weighted set of its three-word shingles, the weight being how often each occurs. A sketch has one register
per hash: each shingle sends a Poisson stream of arrivals at a rate of its weight, an arrival falls on a register drawn
from the shingle's own random stream, and a register keeps the shingle of its earliest arrival. A shingle stops as soon as
its next arrival is later than every register's (early termination). Two registers agree with the probability Jaccard
J_P of the two texts. Sketches are banded; texts that share a band are candidates; a candidate counts when its exact J_P,
computed from the whole texts, reaches the threshold. Groups are the connected components of what counts.

Cost at scale. Equal texts fold into one node first, so thousands of copies cost one. Within a band's bucket each node is
first paired with the bucket's least node only, which is linear, and suffices for a group of copies. Nodes of buckets that are then
still in different components are joined again by their rarest shingles. That misses nothing: J_P is at most
1 / (1 / s + 1 / t - 1), s and t being the shares of the two texts' weights that both have, so for J_P >= threshold either share is at
least the threshold, and one at least 2 threshold / (1 + threshold). In any fixed order of shingles, then, the first that two near
texts share is followed, itself included, by so much of both; with rare shingles in front few are left to ask. A passage or a
template that a million texts have, but which doesn't make them near copies, is common to all of them, hence last in the order, and
pairs nobody. Pairs within a component are never enumerated. There is no cap on a bucket.

Defined results: texts are compared in lower case by words (see _bytes). Equal texts, the empty one included, form a
group. A null text equals no other and stays alone, but rows of null text and equal doc_id count as one. A text without
words is a near copy of nothing but its equals. Of rows with equal doc_id and text one stays. Further columns of any name
are ignored by near_duplicates() and kept by deduplicated(). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import cut, fresh, table

#: Shingle length in words, bands, rows a band, least J_P of a near copy.
K, BANDS, ROWS, THRESHOLD = 3, 28, 4, 0.5
#: Counters of the shingles' rarity: texts are counted by hash, and only the order depends on it.
SLOTS = 1 << 20
_GOLD, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def sketch(doc: np.ndarray, g: np.ndarray, w: np.ndarray, n: int, m: int) -> np.ndarray:
    """(n, m) registers with the hash of the shingle that arrived first; rows without shingles stay 0."""
    q = np.full(n * m, np.inf)
    sig = np.zeros(n * m, dtype=np.uint64)
    t = np.zeros(len(g))
    done, step = 0, 1
    while len(g):
        j = np.arange(done, done + step, dtype=np.uint64) * _GOLD
        r = B.mix(g[:, None] + j[None, :])
        e = -np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0**-53) / w[:, None]
        e[:, 0] += t
        at = np.cumsum(e, axis=1)
        cell = doc[:, None] * m + ((B.mix(r ^ _TURN) >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
        t = at[:, -1]
        at, cell = at.ravel(), cell.ravel()
        early = np.flatnonzero(at < q[cell])
        at, cell = at[early], cell[early]
        np.minimum.at(q, cell, at)
        won = at == q[cell]
        sig[cell[won]] = g[early[won] // step]
        on = t < q.reshape(n, m).max(axis=1)[doc]
        doc, g, w, t = doc[on], g[on], w[on], t[on]
        done, step = done + step, min(2 * step, 64)
    return sig.reshape(n, m)


def j_p(ga: np.ndarray, va: np.ndarray, gb: np.ndarray, vb: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets (sorted hashes, weights): the sum, over the shared d, of
    1 / sum_e max(a_e / a_d, b_e / b_d)."""
    if not len(ga) or not len(gb):
        return 0.0
    shared, ia, ib = np.intersect1d(ga, gb, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    a, b = va[ia].astype(float), vb[ib].astype(float)
    only_a, only_b = va.sum() - a.sum(), vb.sum() - b.sum()
    ratio = a / b
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    lower = np.concatenate(([0.0], np.cumsum(b)))
    upper = np.concatenate((np.cumsum(a[::-1])[::-1], [0.0]))
    at = np.searchsorted(ratio, ratio, side="left")
    return float(np.sum(1.0 / ((upper[at] + only_a) / a + (lower[at] + only_b) / b)))


def _bands(bands: int, rows: int, k: int):
    @F.arrow_udf("array<bigint>")
    def keys(texts: pa.Array) -> pa.Array:
        lists: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        for _, part in B.pieces(texts):
            doc, g, w = B.shingles(B.Words(part), k)
            n = len(part)
            sig = sketch(doc, g, w, n, bands * rows)
            some = np.zeros(n, dtype=bool)
            some[doc] = True
            x = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, (n, bands)).copy()
            for r in range(rows):
                x = B.mix(x ^ sig[:, r::rows][:, :bands])
            lists.append(x[some].ravel().view(np.int64))
            sizes.append(np.where(some, bands, 0))
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if sizes else np.zeros(1)
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))

    return keys


def _verified(k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            ta, tb = batch.column("ta"), batch.column("tb")
            at = 0
            while at < batch.num_rows:
                size, to = 0, at
                while to < batch.num_rows and (to == at or size < 1 << 20):
                    size += len(ta[to].as_buffer()) + len(tb[to].as_buffer())
                    to += 1
                sides = []
                for t in (ta, tb):
                    doc, g, w = B.shingles(B.Words(t.slice(at, to - at)), k)
                    cuts = np.searchsorted(doc, np.arange(to - at + 1))
                    sides.append((g, w, cuts))
                (g1, w1, c1), (g2, w2, c2) = sides
                for i in range(to - at):
                    a, b = slice(c1[i], c1[i + 1]), slice(c2[i], c2[i + 1])
                    keep[at + i] = j_p(g1[a], w1[a], g2[b], w2[b]) >= threshold
                at = to
            yield pa.RecordBatch.from_arrays([pc.filter(batch.column(c), pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return run


def components(edges: DataFrame, spark: SparkSession, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of the edges, root being the least node it is connected with. Alternates large-star and
    small-star steps, of which there are O(log n) whatever the graph's shape; each is two shuffles of the edges."""
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
        large = low.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = low.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        new = cut(small)
        # the steps keep connectivity, so the edges are final once every node has one edge and no root has any
        forks = new.groupBy("u").count().where("count > 1").limit(1).count()
        chained = 0 if forks else new.join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()
        e = new
        if not forks and not chained:
            break
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and node, the text's digest."""
    null = F.md5(F.concat(F.lit("\0null"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))
    return docs.select("doc_id", "text", F.unhex(F.coalesce(F.md5("text"), null)).alias("node"))


def _tallied(k: int):
    """slot, n: how many texts of the partition have a shingle of each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for _, part in B.pieces(batch.column("text")):
                n += np.bincount((B.shingles(B.Words(part), k)[1] % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(n[slot], pa.int64())], names=["slot", "n"])

    return run


def _fronts(k: int, threshold: float, rarity: np.ndarray):
    """shingle, node, root, short of the rarest shingles of each text: those from which on there is `threshold` of its weight, and whether
    there is even 2 threshold / (1 + threshold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in B.pieces(batch.column("text")):
                doc, g, w = B.shingles(B.Words(part), k)
                order = np.lexsort((g, rarity[(g % np.uint64(SLOTS)).astype(np.int64)], doc))
                doc, g, w = doc[order], g[order], w[order]
                ends = np.cumsum(np.bincount(doc, weights=w, minlength=len(part)))
                before = np.cumsum(w) - w
                total = np.diff(np.concatenate(([0.0], ends)))[doc]
                left = (ends[doc] - before) / np.maximum(total, 1)
                front = np.flatnonzero(left >= threshold - 1e-9)
                rows = pa.array(doc[front] + at)
                short = pa.array(left[front] >= 2 * threshold / (1 + threshold) - 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array(g[front].view(np.int64), pa.int64()), batch.column("node").take(rows), batch.column("root").take(rows), short], names=["shingle", "node", "root", "short"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a < b) of nodes of different roots among those of a shingle, one at least having it in its short front."""
    for whole in batches:
        for start in range(0, whole.num_rows, 4096):
            lists = whole.column("those").slice(start, 4096)
            flat = lists.flatten()
            node, root = (flat.field(c).dictionary_encode() for c in ("node", "root"))
            # numbers in the order of the nodes
            rank = pc.rank(node.dictionary, tiebreaker="first").to_numpy().astype(np.int64)[node.indices.to_numpy()]
            r, short = root.indices.to_numpy(), flat.field("short").to_numpy(zero_copy_only=False)
            bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
            seen: list[np.ndarray] = []
            held = 0
            for at, to in zip(bounds[:-1], bounds[1:]):
                for begin in range(at, to, 512):
                    i, j = np.nonzero((r[begin : min(begin + 512, to), None] != r[None, at:to]) & (short[begin : min(begin + 512, to), None]))
                    x, y = rank[begin + i], rank[at + j]
                    seen.append(np.unique(np.minimum(x, y) << np.int64(32) | np.maximum(x, y)))
                    held += len(seen[-1])
                    if held > 1 << 20:
                        seen = [np.unique(np.concatenate(seen))]
                        held = 0
            found = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
            names = node.dictionary.take(pc.sort_indices(node.dictionary))
            yield pa.RecordBatch.from_arrays([names.take(pa.array((found >> 32) - 1)), names.take(pa.array((found & 0xFFFFFFFF) - 1))], names=["a", "b"])


def _grouped(docs: DataFrame, k: int, bands: int, rows: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The rows as (doc_id, node, row), and (node, root) of every node that has a near copy of another text."""
    spark = docs.sparkSession
    rows_ = cut(_keyed(docs).select("doc_id", "node", _bands(bands, rows, k)("text").alias("keys"), F.monotonically_increasing_id().alias("row")))
    nodes = rows_.groupBy("node").agg(F.any_value("keys").alias("keys"))
    spread = nodes.select("node", F.explode("keys").alias("key"))
    leads = spread.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead")
    shared = cut(spread.join(leads, "key").select("key", "node", "lead"))
    near = shared.select("node").distinct()
    texts = cut(_keyed(docs).select("node", "text").join(near, "node", "left_semi").groupBy("node").agg(F.any_value("text").alias("text")))

    def verify(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(_verified(k, threshold), "a binary, b binary")

    tried = shared.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    first = cut(verify(tried))
    roots = cut(components(first, spark))
    ids = rows_.select("doc_id", "node", "row")
    placed = cut(shared.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    mixed = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    apart = cut(placed.join(mixed, "key", "left_semi").select("node", "root").distinct())
    if apart.isEmpty():
        return ids, roots
    left = cut(texts.join(apart, "node").select("node", "root", "text"))
    tally = left.select("text").mapInArrow(_tallied(k), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS rows
    rarity = np.zeros(SLOTS, dtype=np.uint8)
    rarity[tally["slot"].to_numpy()] = np.minimum(np.log2(tally["n"].to_numpy()) * 4, 255).astype(np.uint8)
    fronts = left.mapInArrow(_fronts(k, threshold, rarity), "shingle bigint, node binary, root binary, short boolean")
    met = fronts.groupBy("shingle").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max("short").alias("any"), F.collect_list(F.struct("node", "root", "short")).alias("those"))
    pairs = met.where("r0 <> r1 AND any").select("those").mapInArrow(_met, "a binary, b binary").distinct()
    second = cut(verify(pairs.join(tried, ["a", "b"], "left_anti")))
    if second.isEmpty():
        return ids, roots
    return ids, cut(components(first.union(second), spark))


def near_duplicates(docs: DataFrame, k: int = K, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, group_id (the least doc_id of its group, null if all are null), group_size (rows), kept: whether it is the
    one of its group that stays. One row for each row of docs."""
    ids, roots = _grouped(docs, k, bands, rows, threshold)
    ids = ids.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "node", "row")).alias("first")
    groups = ids.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size"), first)
    return ids.join(groups, "root").select("doc_id", "group_id", "group_size", (F.col("row") == F.col("first.row")).alias("kept"))


def deduplicated(docs: DataFrame, k: int = K, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group the row of least doc_id."""
    ids, roots = _grouped(docs, k, bands, rows, threshold)
    best = ids.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "node")).alias("x"))
    node, keep, keep_id, rank = fresh(docs.columns, "node", "keep", "keep_id", "rank")
    stay = best.select(F.col("x.node").alias(keep), F.col("x.doc_id").alias(keep_id))
    null = F.md5(F.concat(F.lit("\0null"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))
    named = docs.withColumn(node, F.unhex(F.coalesce(F.md5("text"), null)))
    found = named.join(stay, (F.col(node) == F.col(keep)) & F.col("doc_id").eqNullSafe(F.col(keep_id)))
    one = Window.partitionBy(node).orderBy("doc_id")
    return found.withColumn(rank, F.row_number().over(one)).where(F.col(rank) == 1).select(*docs.columns)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
