import itertools
import math

import numpy as np
import pytest

from haze.operators import learn, treeshap

NAMES = [f"f{i}" for i in range(8)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (240, 8)) / 2.0  # ties at thresholds
    y = 4 * x[:, 0] + x[:, 1] * x[:, 2] - 3 * (x[:, 3] > 1) * x[:, 4] + x[:, 5] ** 2 + x[:, 6] - x[:, 7] * x[:, 0]
    return spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], ["row", *NAMES, "AQI"])


def models():
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor

    return {"tree": DecisionTreeRegressor(maxDepth=9, minInstancesPerNode=2), "forest": RandomForestRegressor(numTrees=3, maxDepth=8, seed=3),
            "boosted": GBTRegressor(maxIter=3, maxDepth=4, seed=3)}


def known(nodes, x, chosen, at=0):
    """Mean prediction of a tree where only the features of ``chosen`` are known, by walking it."""
    node = nodes[at]
    if node["left"] < 0:
        return node["prediction"]
    if node["feature"] in chosen:
        return known(nodes, x, chosen, node["left"] if x[node["feature"]] <= node["threshold"] else node["right"])
    return sum(nodes[c]["cover"] / node["cover"] * known(nodes, x, chosen, c) for c in (node["left"], node["right"]))


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted"])
def test_equal_to_all_subsets(spark, data, kind):
    model = models()[kind].fit(learn._assembled(data, NAMES))
    trees = {}
    for r in treeshap.tree_nodes(spark, model).to_dict("records"):
        trees.setdefault(r["tree"], {})[r["id"]] = r
    weights = treeshap._weights(model)
    got = {}
    for r in treeshap.tree_shapley(data.where("row % 80 = 7"), model, NAMES, ["row"]).collect():
        got[r["row"], r["feature"]] = r["contribution"]
    rows = data.where("row % 80 = 7").collect()
    assert len(got) == len(rows) * 8
    for row in rows:
        x = [row[c] for c in NAMES]
        value = {s: sum(weights[t] * known(nodes, x, s) for t, nodes in trees.items())
                 for k in range(9) for s in itertools.combinations(range(8), k)}
        for i, name in enumerate(NAMES):
            want = sum(math.factorial(len(s)) * math.factorial(7 - len(s)) / math.factorial(8) * (value[tuple(sorted((*s, i)))] - v)
                       for s, v in value.items() if i not in s)
            assert got[row["row"], name] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted"])
def test_adds_up_to_the_models_own_prediction(spark, data, kind, monkeypatch):
    model = models()[kind].fit(learn._assembled(data, NAMES))
    odd = data.select("row", *[treeshap.F.when((treeshap.F.col("row") + i) % 11 > 0, treeshap.F.col(c)).alias(c) for i, c in enumerate(NAMES)])
    leaves = treeshap.model_leaves(spark, model, 8)
    sums = {r["row"]: r["s"] for r in treeshap.tree_shapley(odd, model, NAMES, ["row"], leaves).groupBy("row").agg(
        treeshap.F.sum("contribution").alias("s")).collect()}
    for r in learn.score(odd, model, NAMES, keep=["row"]).collect():
        assert sums[r["row"]] + leaves.expected == pytest.approx(r["predicted_aqi"], abs=1e-9)
    x = np.random.default_rng(1).random((40, 8)) * 3
    x[0, 0], x[1, 1], x[2, 2] = np.nan, np.inf, -np.inf
    whole = treeshap.contributions(x, leaves)
    monkeypatch.setattr(treeshap, "BLOCK", 64)
    assert np.allclose(treeshap.contributions(x, leaves), whole)


def test_models_beyond_the_broadcast_bound_are_refused(spark, data, monkeypatch):
    model = models()["tree"].fit(learn._assembled(data, NAMES))
    monkeypatch.setattr(treeshap, "MAX_LEAF_BYTES", 100)
    with pytest.raises(ValueError, match="bytes of leaves"):
        treeshap.model_leaves(spark, model, 8)


def test_influence_report_of_exact_values(spark, data):
    from haze.plans import jobs

    model = models()["tree"].fit(learn._assembled(data, NAMES))
    rows = data.withColumn("city", treeshap.F.lit("c")).withColumn("timestamp", treeshap.F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(row AS INT))"))
    report = jobs.influence_report(rows, model, NAMES, method="exact", n=None).collect()
    want = np.abs(treeshap.contributions(np.array([[r[c] for c in NAMES] for r in data.collect()]), treeshap.model_leaves(spark, model, 8))).mean(axis=0)
    assert {r["feature"]: r["importance"] for r in report} == pytest.approx(dict(zip(NAMES, want)))
