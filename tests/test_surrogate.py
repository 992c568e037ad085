import numpy as np
import pytest
from pyspark.sql import functions as F

from haze.operators import explain, learn


def test_equations_are_solved_in_columns(spark):
    rng = np.random.default_rng(2)
    rows, want = [], []
    for i in range(20):
        a = rng.normal(size=(12, 5))
        if i % 4 == 0:
            a[:, 3] = 0.0  # a feature without spread
        y = rng.normal(size=12)
        rows.append((i, np.column_stack([a.T @ a, a.T @ y]).tolist()))
        want.append(np.linalg.lstsq(a, y, rcond=None)[0])
    out = spark.createDataFrame(rows, "i int, m array<array<double>>").select("i", explain.solve(F.col("m"), 5).alias("b")).collect()
    for r in out:
        assert r["b"] == pytest.approx(list(want[r["i"]]), abs=1e-9)


def test_surrogate_of_a_tree_equals_weighted_least_squares(spark):
    from pyspark.ml.regression import DecisionTreeRegressor

    names = ["a", "b", "c", "flat"]
    rng = np.random.default_rng(7)
    data = spark.createDataFrame([(i, *map(float, rng.normal(size=3)), 2.0, float(i % 17)) for i in range(60)], ["row_id", *names, "AQI"])
    model = DecisionTreeRegressor(maxDepth=5).fit(learn._assembled(data, names))
    rows = data.where("row_id < 6").drop("AQI")
    got = explain.local_surrogate(rows, model, names, n_samples=50)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    got = {(r["row_id"], r["feature"]): r["contribution"] for r in got.collect()}
    x = rows.toPandas().set_index("row_id")
    mu, sd = x.mean(), x.std()
    draws = rows.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("s")).select("row_id", "s", *[
        learn.normal_noise(F.concat_ws("|", F.col("row_id").cast("string"), F.col("s").cast("string")), f"42:{j}").alias(c)
        for j, c in enumerate(names)]).toPandas()
    for i, g in draws.groupby("row_id"):
        z = np.where(g[["s"]].to_numpy() == 0, 0.0, g[names].to_numpy())
        z[:, 3] = 0.0
        p = x.loc[i].to_numpy() + sd.to_numpy() * z
        y = learn.score(spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(p)], ["k", *names]), model, names, ["k"]).orderBy("k").toPandas()
        w = np.sqrt(np.exp(-(z ** 2).sum(axis=1) / (4 * 0.75 ** 2)))
        b = np.linalg.lstsq(np.column_stack([np.ones(50), p])[:, :4] * w[:, None], y["predicted_aqi"].to_numpy() * w, rcond=None)[0]
        for j, c in enumerate(names[:3]):
            assert got[i, c] == pytest.approx(b[j + 1] * (x.loc[i, c] - mu[c]), abs=1e-8)
        assert got[i, "flat"] == 0.0


def test_too_few_draws_are_refused(spark):
    with pytest.raises(ValueError, match="draws"):
        explain.local_surrogate(spark.range(3).select(F.col("id").alias("row_id"), F.lit(1.0).alias("a")), None, ["a"], n_samples=2)
