import numpy as np

from lexiflow.llm import knn


def test_each_dimension_has_its_neighbours(spark):
    rows = [(i, [float(i), 0.0]) for i in range(1, 8)] + [(i, [float(i), 0.0, 0.0]) for i in range(11, 15)] + [(20, [1.0])]
    got = {(r.vec_id, r.neighbour_id, r.rank, r.distance) for r in knn.neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), k=2).collect()}
    want = set()
    for i, x in rows:
        near = sorted((abs(x[0] - y[0]), j) for j, y in rows if j != i and len(y) == len(x))[:2]
        want |= {(i, j, n, d) for n, (d, j) in enumerate(near, 1)}
    assert got == want


def brute(rows, k):
    out = set()
    for i, x in rows:
        near = sorted((round(float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), knn.DIGITS), j) for j, y in rows if j != i)[:k]
        out |= {(i, j, n, d) for n, (d, j) in enumerate(near, 1)}
    return out


def test_far_from_the_origin_and_cut_into_many_tasks(spark):
    rng = np.random.default_rng(4)
    for offset, scale in ((0, 1), (1e6, 1), (1e7, 1), (-1e9, 1e3)):
        rows = [(i, (rng.normal(size=16) * scale + offset).tolist()) for i in range(200)]
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
        got = {tuple(r) for r in knn.neighbours(df, k=3, pivots=9, task_bytes=8 * 16 * 40).select("vec_id", "neighbour_id", "rank", "distance").collect()}
        assert got == brute(rows, 3)


def test_clusters_are_pruned_and_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) + 100 * (i % 7)).tolist()) for i in range(280)]
    rows += [(i, [1.5, 1.5, 1.5, 1.5]) for i in range(300, 315)]  # ties
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {tuple(r) for r in knn.neighbours(df, k=4, pivots=20).select("vec_id", "neighbour_id", "rank", "distance").collect()}
    assert got == brute(rows, 4)


def test_queries_are_the_ids_divisible_by_every(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(-100, 301)]
    rows += [(i, rows[0][1]) for i in range(401, 420)]  # ties
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    want = {x for x in brute(rows, 5) if x[0] % 50 == 0}
    for task_bytes in (knn.TASK_BYTES, 4 * 8 * 60):
        got = {tuple(r) for r in knn.neighbours(df, k=5, task_bytes=task_bytes, every=50).select("vec_id", "neighbour_id", "rank", "distance").collect()}
        assert got == want
    assert knn.neighbours(df.where("vec_id % 50 <> 0"), every=50).count() == 0


def test_embeddings_of_other_ids_only_answer(spark, sf001):
    ids = {r[0] for r in spark.read.parquet(f"{sf001}/embeddings.parquet").select("vec_id").collect()}
    got = knn.op4_exact_top_k(spark, sf001).collect()
    assert {r.vec_id for r in got} == {i for i in ids if i % 50 == 0} and {r.neighbour_id for r in got} - {r.vec_id for r in got}


def test_single_precision_loses_no_neighbour():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 16))
    near = x[0] + 1e-5 * rng.normal(size=(300, 16))
    for s in (x, np.concatenate([x, near]), x * 1e-22, x + 1e5, np.concatenate([x, x * 1e18]), np.concatenate([x, x[:500]]), x * 1e140):
        ids = rng.permutation(len(s))
        for bounded in (False, True):
            asks = slice(0, None, 30)
            d = np.round(np.array([np.sqrt(((s - q) ** 2).sum(1)) for q in s[asks]]), knn.DIGITS)
            d[np.arange(len(d)), np.arange(len(s))[asks]] = np.inf
            order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :4]
            kth = np.take_along_axis(d, order[:, 3:], 1)[:, 0]
            task = knn._Task(4, 16, ids[asks], s[asks], kth if bounded else np.full(len(d), np.inf))
            for at in range(0, len(s), 1000):
                task.add(ids[at : at + 1000], s[at : at + 1000])
            got = {x for b in task.lists() for x in zip(*(c.to_pylist() for c in b.columns))}
            assert got == {(int(a), int(ids[j]), float(e[j])) for a, o, e in zip(ids[asks], order, d) for j in o}
