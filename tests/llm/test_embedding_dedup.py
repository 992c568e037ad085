import numpy as np

from haze.llm import embedding_dedup
from tests.llm.brute import Union

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows, threshold=0.9):
    fine = {i: np.array(e, np.float64) for i, e in rows
            if e is not None and all(v is not None and np.isfinite(v) for v in e) and any(e)}
    ids = sorted(fine)
    x = np.array([np.float32(fine[i]) for i in ids], np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    s = x @ x.T >= threshold
    np.fill_diagonal(s, False)
    u = Union()
    for i, _ in rows:
        u.root(i)
    for a, b in zip(*np.nonzero(s)):
        u.join(ids[a], ids[b])
    n = dict(zip(ids, s.sum(axis=1).tolist()))
    return {i: (n.get(i, 0), u.root(i), u.root(i) == i) for i, _ in rows}


def got(spark, rows, **kw):
    out = embedding_dedup.near_dedup(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}


def data(n, groups, size, noise, dims=32, seed=1):
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=dims) for _ in range(n)]
    for _ in range(groups):
        base = rng.normal(size=dims)
        x += [base + noise * rng.normal(size=dims) for _ in range(size)]
        x += [x[-1], 3 * x[-2]]
    order = rng.permutation(len(x))
    return [(int(i), [float(v) for v in x[k]]) for i, k in enumerate(order)]


def test_matches_brute_force_across_cells_and_blocks(spark):
    rows = data(600, 12, 15, 0.15)
    want = brute(rows)
    assert got(spark, rows, margin=2, block=64, cells=7) == want
    assert got(spark, rows, block=50, cells=9) == want


def test_one_large_group(spark):
    rows = data(200, 1, 700, 0.12)
    assert got(spark, rows, block=128) == brute(rows)


def test_whole_table_recall(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in t.collect()]
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_dedup(t).collect()}
    assert out == brute(rows)


def test_defined_cases(spark):
    rows = [(1, [1., 0.]), (2, [2., 0.]), (3, None), (4, [0., 0.]), (5, [float("nan"), 1.]), (6, [float("inf"), 0.]),
            (7, [None, 1.]), (8, [1., 0., 0.]), (9, []), (10, [0., 1.]), (11, [0., 1.])]
    out = got(spark, rows)
    assert out[1] == (1, 1, True) and out[2] == (1, 1, False) and out[10] == (1, 10, True) and out[11] == (1, 10, False)
    assert all(out[i] == (0, i, True) for i in range(3, 10))
    twice = embedding_dedup.near_dedup(spark.createDataFrame([(1, [1., 0.]), (1, [1., 0.]), (None, [1., 0.])], SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in twice) == [(0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True)]


def test_empty_table_and_clashing_columns(spark):
    schema = "vec_id bigint, embedding array<float>, d int, W string, cell int"
    assert embedding_dedup.near_dedup(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1., 0.5], 1, "x", 2), (2, None, None, None, None)]
    out = embedding_dedup.near_dedup(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == [(1, 0, 1, True), (2, 0, 2, True)]
