"""Operator 4: exact top-k search as a Voronoi kNN join: every vector whose id is divisible by `every` is a query over all vectors.

A sample of the rows is searched first; the k-th neighbour in it bounds how far that in all rows can be. Pivots, taken by hash order, cut
the vectors into Voronoi cells. One summary a cell, with its number of queries, their radius and the k + 1 least distances to its pivot,
bounds the same by the triangle inequality. From both follows for each pair of cells in which ring about its pivot a data vector has to
lie to matter; only those are replicated to the cell's group of queries. Groups are of cells that lie together: many small ones where the
rings leave most data out, else as few as tasks can hold, so that data isn't sent again and again. What each group needs is counted first,
and groups are cut by slices of queries and slabs of data. A task holds its queries, and the data pass by them in batches. The local top-k
lists are then merged. Nothing is approximate.

Cost at scale. Where the bounds prune nothing, as with vectors without structure in many dimensions, each query is compared with each
vector, as any exact method has to there: the time grows with the square of the rows (over `every`). Data are sent once for each slice of
queries, queries once for each slab.

Defined results: distance is Euclidean, in double precision, rounded to 7 decimals; neighbours are ordered by it and then by vec_id.
A vector with a null id, with no values, or with a null value or one not below 1e150 in size neither asks nor answers. Vectors are neighbours of those of
their own dimension; the join runs once for each dimension. A vector isn't a neighbour of rows with its own vec_id; rows with equal vec_id and equal
vector count once, rows with equal vec_id and other vectors are all data, and a query is then answered from its nearest one
to each neighbour. With fewer than k others there are fewer neighbours. Further columns of any name are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut, table

K, DIGITS, EVERY = 10, 7, 50
#: Bytes of queries and of data of a local task; pivots and partitions of tasks at most; rows of queries and of data at a time, and
#: of data held before that; queries whose results are cut down together, and results found before that. They affect speed and memory alone.
TASK_BYTES, MOST_PIVOTS, MOST_TASKS, QUERIES, DATA, HELD, RANGE, PENDING = 1 << 27, 2048, 8192, 256, 2048, 8192, 1 << 14, 1 << 15
#: The share of rows, and the least rows, of the sample that gives first bounds.
SHARE, LEAST = 1 / 32, 4096
#: Squares of larger values might not be finite.
HUGE = 1e150
#: Squares below this are told apart in single precision.
SMALL = 1e36


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), dim)


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best, dist = np.zeros(len(x), dtype=np.int32), np.zeros(len(x))
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        d = (part**2).sum(1)[:, None] - 2 * part @ pivots.T + (pivots**2).sum(1)
        best[at : at + 4096] = d.argmin(1)
        dist[at : at + 4096] = np.sqrt(((part - pivots[best[at : at + 4096]]) ** 2).sum(1))
    return best, dist


class _Task:
    """Top k of the queries of one task among its data, which come after them. Distances are first found as |a|^2 + |b|^2 - 2ab, with the
    origin moved into the data, in single precision where that tells enough; whatever may belong to the k nearest, by a bound on the
    rounding of that and of DIGITS, is then measured exactly."""

    def __init__(self, k: int, dim: int, ids: np.ndarray, q: np.ndarray, reach: np.ndarray):
        self.k, self.dim, self.ids, self.q = k, dim, ids, q
        # no neighbour is farther than this, once rounded
        self.reach, self.origin = reach, None
        self.wide = np.zeros(-(-len(q) // QUERIES), dtype=bool)
        # of each RANGE of queries: lists found since they were cut down, and the first of them what was kept then
        self.found: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(0, len(q), RANGE)]
        self.pending = np.zeros(len(self.found), dtype=np.int64)
        self.block = np.empty(QUERIES * DATA, dtype=np.float32)

    def add(self, sid: np.ndarray, s: np.ndarray) -> None:
        if not len(self.q) or not len(s):
            return
        if self.origin is None:
            self.origin = s[0].astype(np.float64)
            self.own = np.concatenate([(self._moved(at) ** 2).sum(1) for at in range(0, len(self.q), QUERIES)])
            self.small = float(self.own.max()) < SMALL
            self.asked = np.concatenate([self._asked(at).astype(np.float32) for at in range(0, len(self.q), QUERIES)]) if self.small else None
        near = s - self.origin
        norm = (near**2).sum(1)
        top = float(norm.max())
        near = np.column_stack([near, norm])
        single = near.astype(np.float32) if self.small and top < SMALL else None
        # an id may have several vectors, the query's own too: k other ids are among so many rows
        most = (self.k + 1) * int(np.unique(sid, return_counts=True)[1].max())
        for n, at in enumerate(range(0, len(self.q), QUERIES)):
            part = slice(at, at + QUERIES)
            for begin in range(0, len(s), DATA):
                rows, cols = self._near(n, part, slice(begin, begin + DATA), near, single, top, most)
                if len(rows):
                    self._measure(rows + at, cols + begin, sid, s)

    def _moved(self, at: int) -> np.ndarray:
        return self.q[at : at + QUERIES] - self.origin

    def _asked(self, at: int) -> np.ndarray:
        moved = self._moved(at)
        return np.column_stack([-2 * moved, np.ones(len(moved))])

    def _limit(self, part: slice, top: float, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """The most that |b|^2 - 2ab may be, and the bound on its rounding."""
        own = self.own[part]
        err = 16 * (self.dim + 8) * (float(np.finfo(kind).eps) * (own + top) + float(np.finfo(kind).tiny))
        return (self.reach[part] + 1.1 * 10.0**-DIGITS) ** 2 * (1 + 1e-12) + err - own, err

    def _near(self, n: int, part: slice, some: slice, near: np.ndarray, single: np.ndarray | None, top: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        unbounded, rows, cols = np.isinf(self.reach[part]).any(), None, None
        if single is not None and not self.wide[n] and not unbounded:
            a, b = self.asked[part], single[some]
            d = np.matmul(a, b.T, out=self.block[: len(a) * len(b)].reshape(len(a), len(b)))
            rows, cols = _below(d, self._limit(part, top, np.float32)[0].astype(np.float32))
            if len(rows) <= d.size >> 6:
                return rows, cols
        d = self._asked(part.start) @ near[some].T
        if unbounded and d.shape[1] >= most:
            # the nearest of some rows bound those of all
            far = np.maximum(np.partition(d, most - 1, axis=1)[:, most - 1] + self.own[part], 0) + self._limit(part, top, np.float64)[1]
            self.reach[part] = np.minimum(self.reach[part], np.sqrt(far) + 10.0**-DIGITS)
        exact = _below(d, self._limit(part, top, np.float64)[0])
        self.wide[n] |= rows is not None and 2 * len(exact[0]) < len(rows)
        return exact

    def _measure(self, rows: np.ndarray, cols: np.ndarray, sid: np.ndarray, s: np.ndarray) -> None:
        b = sid[cols]
        other = self.ids[rows] != b
        rows, cols, b = rows[other], cols[other], b[other]
        d = np.empty(len(rows))
        for i in range(0, len(rows), 1 << 13):
            x = slice(i, i + (1 << 13))
            d[x] = np.sqrt(((self.q[rows[x]].astype(np.float64) - s[cols[x]]) ** 2).sum(1))
        d = np.round(d, DIGITS)
        near = d <= self.reach[rows]
        n = int(rows[0]) // RANGE if len(rows) else 0
        self.found[n].append((rows[near], b[near], d[near]))
        self.pending[n] += int(near.sum())
        if self.pending[n] > PENDING + self.k * RANGE:
            self._settle(n)

    def _settle(self, n: int) -> None:
        """Cuts a range's lists down to the k nearest."""
        self.pending[n] = 0
        if not self.found[n]:
            return
        a, b, d = (np.concatenate(c) for c in zip(*self.found[n]))
        order = np.lexsort((d, b, a))
        a, b, d = a[order], b[order], d[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, d = a[new], b[new], d[new]
        order = np.lexsort((b, d, a))
        a, b, d = a[order], b[order], d[order]
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, int)
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        last = rank == self.k - 1
        self.reach[a[last]] = np.minimum(self.reach[a[last]], d[last])
        keep = rank < self.k
        self.found[n] = [(a[keep], b[keep], d[keep])]

    def lists(self) -> Iterator[pa.RecordBatch]:
        for n in range(len(self.found)):
            self._settle(n)
            for a, b, d in self.found[n]:
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[a], pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float64())], names=["a", "b", "d"])
            self.found[n] = []


def _below(d: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of what is at most its row's limit. Few rows have any, as a rule."""
    some = np.flatnonzero(d.min(1) <= limit)
    rows, cols = np.divmod(np.flatnonzero(d[some] <= limit[some, None]), d.shape[1])
    return some[rows], cols


def _local(k: int, dim: int):
    """Runs the tasks of a partition, whose rows are ordered by task, queries first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, task, asks, data, held = None, None, [], [], 0

        def flush() -> _Task:
            nonlocal data, held
            out = task or _Task(k, dim, *(np.concatenate(c) for c in zip(*asks)))
            asks.clear()
            if data:
                out.add(*(np.concatenate(c) for c in zip(*data)))
            data, held = [], 0
            return out

        for whole in batches:
            keys = whole.column("key").to_numpy()
            ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for begin, end in zip([0, *ends], ends):
                if begin == end:
                    continue
                if keys[begin] != key:
                    if task or asks:
                        yield from flush().lists()
                    key, task, asks, data, held = keys[begin], None, [], [], 0
                b = whole.slice(begin, end - begin)
                n = int(pc.sum(b.column("asks")).as_py() or 0)
                ids, x = b.column("id").to_numpy(), _matrix(b.column("v"), dim)
                if n:
                    asks.append((ids[:n], x[:n], b.column("reach").slice(0, n).to_numpy(zero_copy_only=False).astype(np.float64)))
                if (task or asks) and n < len(ids):
                    data.append((ids[n:], x[n:]))
                    held += len(ids) - n
                    if held >= HELD:
                        task = flush()
        if task or asks:
            yield from flush().lists()

    return run


def _bounds(between: np.ndarray, radius: np.ndarray, n: np.ndarray, near: list[tuple[int, float, int]], k: int) -> np.ndarray:
    """How far the k-th neighbour of any query of each cell can be. near: (cell, distance, id) of the vectors nearest to their pivots."""
    bound = np.full(len(n), np.inf)
    if not near:
        return bound
    cell, dist, ids = (np.array(c) for c in zip(*near))
    for i in np.flatnonzero(n):
        upper = radius[i] + between[i, cell] + dist
        # k + 1 different ids are as near as this, so k other than the query's own
        size = 4 * (k + 1)
        while True:
            at = np.argpartition(upper, size - 1)[:size] if size < len(upper) else np.arange(len(upper))
            at = at[np.argsort(upper[at], kind="stable")]
            first = np.sort(np.unique(ids[at], return_index=True)[1])
            if len(first) > k:
                bound[i] = upper[at[first[k]]]
            if len(first) > k or size >= len(upper):
                break
            size *= 4
    return bound


def _divided(p: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """The group of each cell: cells are halved along the axis in which their pivots differ most until a group has `most` vectors at
    most, or one cell."""
    group, todo, made = np.zeros(len(p), dtype=np.int32), [np.arange(len(p))], 0
    while todo:
        cells = todo.pop()
        if n[cells].sum() > most and len(cells) > 1:
            axis = p[cells].var(0).argmax()
            cells = cells[np.argsort(p[cells, axis], kind="stable")]
            sums = np.cumsum(n[cells])
            half = int(np.clip(np.searchsorted(sums, sums[-1] / 2) + 1, 1, len(cells) - 1))
            todo += [cells[:half], cells[half:]]
        else:
            group[cells] = made
            made += 1
    return group


def neighbours(vectors: DataFrame, k: int = K, pivots: int | None = None, groups: int = 12, task_bytes: int = TASK_BYTES, every: int = 1) -> DataFrame:
    """vec_id, neighbour_id, rank (from 1), distance of the k nearest of every vector whose vec_id is divisible by `every`. groups: tasks
    at least (parallelism); task_bytes: what the queries, and the data, of one local task may take."""
    schema = "vec_id bigint, neighbour_id bigint, rank int, distance double"
    # floats are sent as floats, and measured as doubles
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < HUGE))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(f"array<{kind}>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & finite)
    sizes = rows.groupBy(F.size("v").alias("dim")).count().where("count > 1").orderBy("dim").collect()
    lists = [_lists(rows.where(F.size("v") == r["dim"]).distinct(), r["dim"], r["count"], k, pivots, groups, kind, task_bytes, every) for r in sizes]
    lists = [x for x in lists if x is not None]
    if not lists:
        return vectors.sparkSession.createDataFrame([], schema)
    best = _best(reduce(DataFrame.unionByName, lists), k)
    return best.select(F.col("a").alias("vec_id"), F.col("b").alias("neighbour_id"), "rank", F.col("d").alias("distance"))


def _best(lists: DataFrame, k: int) -> DataFrame:
    """The k nearest of each list (a, b, d), with their rank."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    return lists.groupBy("a", "b").agg(F.min("d").alias("d")).withColumn("rank", rank).where(F.col("rank") <= k)


def _lists(rows: DataFrame, dim: int, total: int, k: int, pivots: int | None, groups: int, kind: str, task_bytes: int, every: int) -> DataFrame | None:
    """a, b, d: lists of near vectors b of each query a among rows (id, v) of one dimension, the k nearest at least. None without queries."""
    wanted = pivots or max(1, min(MOST_PIVOTS, round(math.sqrt(total) / 2)))
    # about `wanted` pivots by a share of the hash range; only they reach the driver
    share = min(1.0, 4 * wanted / total)
    found = rows.where(F.pmod(F.xxhash64("id"), F.lit(2**30)) < int(2**30 * share)).select("v").orderBy(F.xxhash64("v")).limit(wanted).collect()
    found = found or rows.select("v").limit(1).collect()
    p = np.unique(np.array([r["v"] for r in found], dtype=np.float64), axis=0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, dist = _to_pivots(_matrix(b.column("v"), dim).astype(np.float64), p)
            asks = b.column("id").to_numpy() % every == 0
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell, pa.int32()), pa.array(dist, pa.float64()), pa.array(asks)], names=["id", "v", "cell", "dist", "asks"])

    placed = cut(rows.mapInArrow(assign, f"id bigint, v array<{kind}>, cell int, dist double, asks boolean"))
    # summaries: a row for each cell; a query's own row may be among the k + 1 least
    near = placed.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("dist"))).where(F.col("n") <= 2 * k + 1).groupBy("cell").agg(F.collect_list(F.struct("dist", "id")).alias("near"))
    asked = F.when(F.col("asks"), F.col("dist"))
    summary = placed.groupBy("cell").agg(F.count(asked).alias("n"), F.coalesce(F.max(asked), F.lit(0.0)).alias("radius")).join(near, "cell").collect()
    m = len(p)
    n, radius = np.zeros(m, dtype=np.int64), np.zeros(m)
    for r in summary:
        n[r["cell"]], radius[r["cell"]] = r["n"], r["radius"]
    queries = int(n.sum())
    if not queries:
        return None
    per = max(1, task_bytes // ((4 if kind == "float" else 8) * dim))

    # the k nearest in a sample bound those in all
    part = min(1.0, max(SHARE, LEAST / total))
    sampled = placed.withColumn("data", F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(2**30)) < int(2**30 * part)).withColumn("reach", F.lit(float("inf")))
    everywhere = np.zeros(m, dtype=np.int32), np.full((1, m), -np.inf), np.full((1, m), np.inf)
    cuts = np.array([max(math.ceil(queries / per), min(groups, math.ceil(queries / QUERIES)))]), np.array([math.ceil(max(1, total * part) / per)])
    reach = cut(_best(_searched(sampled, *everywhere, *cuts, k, dim, kind), k).where(F.col("rank") == k).select(F.col("a").alias("id"), F.col("d").alias("reach")))
    reached = placed.where("asks").select("id", "cell").join(reach, "id", "left").groupBy("cell").agg(F.max(F.coalesce("reach", F.lit(float("inf")))).alias("reach"))

    between = np.stack([np.sqrt(((p - x) ** 2).sum(1)) for x in p])
    bound = _bounds(between, radius, n, [(r["cell"], x["dist"], x["id"]) for r in summary for x in r["near"]], k)
    for r in reached.collect():  # a row for each cell
        bound[r["cell"]] = min(bound[r["cell"]], r["reach"])
    # the ring about each pivot in which a data vector has to lie to matter to a group; the margin keeps rounding from costing a neighbour
    margin = 1e-6 + 1e-12 * (float(between.max()) + float(radius.max()))

    def rings(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = int(group.max()) + 1
        least, most = np.full((count, m), np.inf), np.full((count, m), -np.inf)
        for i in np.flatnonzero(n):
            reach = radius[i] + bound[i] + margin
            least[group[i]] = np.minimum(least[group[i]], between[i] - reach)
            most[group[i]] = np.maximum(most[group[i]], between[i] + reach)
        return least, most

    # from many small groups, which serve where bounds prune, to as few as tasks can hold
    levels = [_divided(p, n, x) for x in sorted({min(per, max(1, queries // groups), max(4096, queries // 256)), min(per, max(1, queries // groups)), per})]
    ringed = [rings(group) for group in levels]
    start = np.cumsum([0, *(len(least) for least, _ in ringed)])
    least, most = (np.concatenate(x) for x in zip(*ringed))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = np.zeros(start[-1], dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                all_ += _needed(b.column("cell").to_numpy(), b.column("dist").to_numpy(), least, most).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(start[-1]), pa.int32()), pa.array(all_, pa.int64())], names=["g", "n"])

    need = np.zeros(start[-1], dtype=np.int64)
    for r in placed.select("cell", "dist").mapInArrow(tally, "g int, n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect():  # a row for each group
        need[r["g"]] = r["n"]
    plans = []
    for group, begin, end in zip(levels, start, start[1:]):
        size = np.bincount(group, weights=n, minlength=end - begin)
        slices = np.maximum(1, np.ceil(size / per)).astype(int)
        pairs = size * need[begin:end]
        slabs = np.maximum(1, np.ceil(np.maximum(need[begin:end] / per, groups * pairs / max(1.0, pairs.sum()) / slices))).astype(int)
        plans.append((int((slices * need[begin:end]).sum()), group, least[begin:end], most[begin:end], slices, slabs))
    _, *plan = next(x for x in plans if x[0] <= 2 * plans[-1][0])
    bounded = placed.join(reach, "id", "left") if every == 1 else placed.where("not asks").withColumn("reach", F.lit(None).cast("double")).unionByName(placed.where("asks").join(reach, "id", "left"))
    return _searched(bounded.withColumn("data", F.lit(True)).withColumn("reach", F.coalesce("reach", F.lit(float("inf")))), *plan, k, dim, kind)


def _needed(cell: np.ndarray, dist: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether each data vector may matter to each group."""
    return (dist[:, None] >= least[:, cell].T) & (dist[:, None] <= most[:, cell].T)


def _searched(placed: DataFrame, group: np.ndarray, least: np.ndarray, most: np.ndarray, slices: np.ndarray, slabs: np.ndarray, k: int, dim: int, kind: str) -> DataFrame:
    """a, b, d: the local lists of the tasks, which are slices of the groups' queries by slabs of the data these need."""
    first = np.cumsum([0, *(slices * slabs)])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                ids, cell = b.column("id").to_numpy(), b.column("cell").to_numpy()
                asking, data = (np.flatnonzero(b.column(c).to_numpy(zero_copy_only=False)) for c in ("asks", "data"))
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                rows_, g_ = np.nonzero(_needed(cell[data], b.column("dist").to_numpy()[data], least, most))
                # a query goes to a slice of its group and every slab, a data vector to a slab and every slice
                take, key, asks = [], [], []
                for ask, at_, of, times in ((True, asking, group[cell[asking]], slabs), (False, data[rows_], g_, slices)):
                    again = np.repeat(np.arange(len(at_)), times[of])
                    number = np.arange(len(again)) - np.repeat(np.cumsum(times[of]) - times[of], times[of])
                    at_, of = at_[again], of[again]
                    fixed = (mixed[at_] % (slices if ask else slabs)[of].astype(np.uint64)).astype(np.int64)
                    slice_, slab = (fixed, number) if ask else (number, fixed)
                    take.append(at_)
                    key.append(first[of] + slice_ * slabs[of] + slab)
                    asks.append(np.full(len(at_), ask))
                i = pa.array(np.concatenate(take))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(key), pa.int32()), pa.array(np.concatenate(asks)), *(b.column(c).take(i) for c in ("id", "reach", "v"))], names=["key", "asks", "id", "reach", "v"]
                )

    sent = placed.select("id", "v", "cell", "dist", "asks", "data", "reach").mapInArrow(spread, f"key int, asks boolean, id bigint, reach double, v array<{kind}>")
    tasks = sent.repartitionById(min(int(first[-1]), MOST_TASKS), F.col("key")).sortWithinPartitions("key", F.desc("asks"))
    return tasks.mapInArrow(_local(k, dim), "a bigint, b bigint, d double")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest others, among all embeddings, of each embedding whose vec_id is divisible by EVERY."""
    return neighbours(table(spark, sf_dir, "embeddings"), every=EVERY)


SQL = f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[64] AS v FROM embeddings),
pairs AS (SELECT a.vec_id, b.vec_id AS neighbour_id, round(array_distance(a.v, b.v), {DIGITS}) AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id)::INT AS rank FROM pairs)
SELECT vec_id, neighbour_id, rank, distance FROM ranked WHERE rank <= {K}"""
