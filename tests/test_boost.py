import math
import tempfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from haze.operators import boost, learn, treeshap

NAMES = [f"f{i}" for i in range(5)]


def numbers(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 5)), 1)  # ties
    y = 3 * x[:, 0] + x[:, 1] * x[:, 2] + 2 * (x[:, 3] > 0.5) + rng.normal(size=n) / 4
    return x, np.round(y, 4)


def frame(spark, x, y, val):
    rows = [(i, *map(float, r), float(v), bool(w)) for i, (r, v, w) in enumerate(zip(x, y, val))]
    df = spark.createDataFrame(rows, ["row", *NAMES, "AQI", "is_val"]).repartition(4)
    return learn._assembled(df, NAMES)


def plain(x, y, val, est):
    """Boosting one split at a time on whole arrays: (predictions of all rows, leaves of each tree, losses)."""
    tx, ty = x[~val], y[~val]
    n = len(ty)
    cuts = [np.unique([np.sort(tx[:, f])[max(0, math.ceil(k / est.bins * n) - 1)] for k in range(1, est.bins)]) for f in range(x.shape[1])]
    pred, best, stop, out, leaves, losses = np.full(len(y), ty.mean()), None, 0, None, [], []
    best = np.mean((y[val] - pred[val]) ** 2) if val.any() else math.inf
    out = pred.copy()
    kept = 0

    def split(at):
        g = (y - pred)[at & ~val]
        found = (0.0, None, None)
        for f, cs in enumerate(cuts):
            for c in cs:
                left = x[at & ~val][:, f] <= c
                a, b = left.sum(), (~left).sum()
                if min(a, b) < max(1, est.min_rows):
                    continue
                gain = g[left].sum() ** 2 / (a + est.ridge) + g[~left].sum() ** 2 / (b + est.ridge) - g.sum() ** 2 / (len(g) + est.ridge)
                if gain > found[0] + 1e-7:
                    found = (gain, f, c)
        return found

    for r in range(1, est.rounds + 1):
        open_ = [(np.ones(len(y), bool), 0, *split(np.ones(len(y), bool)))]
        while len(open_) < est.max_leaves:
            i = max(range(len(open_)), key=lambda j: open_[j][2])
            at, depth, gain, f, c = open_[i]
            if gain <= 0:
                break
            open_.pop(i)
            for part in (at & (x[:, f] <= c), at & ~(x[:, f] <= c)):
                stopped = est.max_depth is not None and depth + 1 >= est.max_depth
                open_.append((part, depth + 1, *((0.0, None, None) if stopped else split(part))))
        if len(open_) == 1:
            break
        leaves.append(len(open_))
        new = pred.copy()
        for at, *_ in open_:
            own = at & ~val
            new[at] += est.step * (y - pred)[own].sum() / (own.sum() + est.ridge)
        pred = new
        if not val.any():
            out, kept = pred, r
            continue
        losses.append(np.mean((y[val] - pred[val]) ** 2))
        if losses[-1] < best:
            best, out, kept = losses[-1], pred, r
        elif r - kept >= est.patience:
            break
    return out, leaves[:kept], losses


@pytest.mark.parametrize("est", [boost.leafwise(rounds=7, max_leaves=12), boost.leafwise(rounds=3, bins=16, min_rows=5, max_leaves=9),
                                 boost.depthwise(rounds=3, max_depth=4), boost.depthwise(rounds=2, bins=8, max_leaves=6)],
                         ids=["leaves", "few bins", "levels", "both"])
@pytest.mark.parametrize("share", [0.0, 0.2])
def test_equal_to_one_split_at_a_time(spark, est, share):
    x, y = numbers()
    val = np.arange(len(y)) >= len(y) * (1 - share)
    df = frame(spark, x, y, val)
    model = est.fit(df)
    want, leaves, losses = plain(x, y, val, est)
    nodes = model.nodes()
    assert nodes[(nodes.left < 0) & (nodes.tree > 0)].groupby("tree").size().tolist() == leaves
    assert model.losses == pytest.approx(losses)
    got = {r["row"]: r["prediction"] for r in model.transform(df).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(want, abs=1e-5)


def test_stops_after_flat_rounds_and_keeps_the_best(spark):
    x, y = numbers(300)
    val = np.arange(len(y)) % 3 == 0
    y = np.where(val, -y, y)  # what is learnt is wrong for the validation rows, from the first round on
    y[np.arange(len(y)) % 2 == 0] += 5
    est = boost.leafwise(rounds=30, patience=3)
    model = est.fit(frame(spark, x, y, val))
    best = 0 if min(model.losses) >= np.mean((y[val] - y[~val].mean()) ** 2) else int(np.argmin(model.losses)) + 1
    assert len(model.losses) == best + 3 < 30
    assert len(model.treeWeights) == best + 1  # and the mean


def test_all_rounds_without_validation_rows(spark):
    x, y = numbers(200)
    model = boost.leafwise(rounds=6).fit(frame(spark, x, y, np.zeros(len(y), bool)))
    assert model.losses == [] and len(model.treeWeights) == 7


def test_the_same_for_any_partitions(spark):
    x, y = numbers(500)
    df = frame(spark, x, y, np.arange(len(y)) >= 450)
    est = boost.leafwise(rounds=4)
    assert est.fit(df.repartition(7)).nodes().equals(est.fit(df.coalesce(1).orderBy(F.desc("row"))).nodes())


def test_saved_and_loaded(spark):
    from haze.plans import jobs

    x, y = numbers(200)
    df = frame(spark, x, y, np.zeros(len(y), bool))
    model = boost.depthwise(rounds=2).fit(df)
    path = tempfile.mkdtemp(prefix="haze-boost-") + "/m"
    model.write().save(path)
    again = jobs.load_model(path)
    assert isinstance(again, boost.BoostedTrees) and again.nodes().equals(model.nodes())
    assert again.transform(df).orderBy("row").collect() == model.transform(df).orderBy("row").collect()
    with pytest.raises(Exception):
        jobs.load_model(path + "-none")


def test_odd_rows(spark):
    x, y = numbers(120)
    x[::7, 0], x[1, 1], x[2, 2] = np.nan, np.inf, -np.inf
    y[5], y[6] = np.nan, np.nan
    x[:, 4] = 1.0  # says nothing
    df = frame(spark, x, y, np.zeros(len(y), bool))
    model = boost.leafwise(rounds=3, min_rows=5).fit(df)
    assert (model.nodes().feature != 4).all()
    assert model.transform(df).where(F.col("prediction").isNull() | F.isnan("prediction")).isEmpty()
    assert model.transform(df.limit(0)).count() == 0
    constant = boost.leafwise(rounds=3).fit(frame(spark, x, np.ones(len(y)), np.zeros(len(y), bool)))
    assert constant.totalNumNodes == 1 and constant.transform(df).select("prediction").distinct().collect()[0][0] == 1.0
    with pytest.raises(ValueError, match="no rows"):
        boost.leafwise().fit(df.limit(0))


def test_sums_beyond_the_bound_are_refused(spark, monkeypatch):
    x, y = numbers(100)
    monkeypatch.setattr(boost, "MAX_SUMS", 100)
    with pytest.raises(ValueError, match="sums"):
        boost.leafwise(rounds=1).fit(frame(spark, x, y, np.zeros(len(y), bool)))


def test_exact_shapley_values_add_up(spark):
    x, y = numbers(150)
    df = frame(spark, x, y, np.zeros(len(y), bool))
    model = boost.leafwise(rounds=4, max_leaves=6).fit(df)
    plain_rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["row", *NAMES])
    leaves = treeshap.model_leaves(spark, model, 5)
    sums = {r["row"]: r["s"] for r in treeshap.tree_shapley(plain_rows, model, NAMES, ["row"], leaves).groupBy("row").agg(F.sum("contribution").alias("s")).collect()}
    for r in learn.score(plain_rows, model, NAMES, keep=["row"]).collect():
        assert sums[r["row"]] + leaves.expected == pytest.approx(r["predicted_aqi"], abs=1e-9)


def test_a_partition_hands_on_one_row_for_each_cell():
    """Sums past 2**53 are exact; a sliced batch has its own rows only."""
    rng = np.random.default_rng(3)
    bins, g = rng.integers(0, 4, (500, 3)), rng.integers(2 ** 55, 2 ** 56, 500)
    node = rng.choice([2, 7], 500)
    batch = pa.RecordBatch.from_arrays([pa.array(list(bins.astype(np.int16)), pa.list_(pa.int16())), pa.array(g), pa.array(node.astype(np.int32))],
                                       names=["b", "g", "node"])
    rows = [r for part in boost._cells([7, 2], 3, 4)(iter([batch.slice(0, 90), batch.slice(90)])) for r in zip(*(c.to_pylist() for c in part.columns))]
    expected = {}
    for b, v, k in zip(bins.tolist(), g.tolist(), node.tolist()):
        for f, x in enumerate(b):
            cell = ([7, 2].index(k) * 3 + f) * 4 + x
            s, n = expected.get(cell, (0, 0))
            expected[cell] = s + v, n + 1
    assert sorted(rows) == sorted((c, s, n) for c, (s, n) in expected.items())
