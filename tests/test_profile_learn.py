import datetime as dt
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from haze.operators import clean, explain, learn, profile


def test_describe_exact_quartiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    r = profile.describe(df, ["x"]).first()
    assert r.p25 == 1.75 and r.p50 == 2.5 and r.p75 == 3.25 and r["count"] == 4
    assert r.std == pytest.approx(pd.Series([1, 2, 3, 4]).std())


def test_null_counts_and_category_counts(spark):
    df = spark.createDataFrame([("a", None), ("a", 1.0), (None, 2.0)], "c string, v double")
    nc = {r.column: r.null_count for r in profile.null_counts(df).collect()}
    assert nc == {"c": 1, "v": 1}
    cc = profile.category_counts(df, "c").collect()
    assert [(r.c, r["count"]) for r in cc] == [("a", 2)]


def test_correlation_pairwise_complete(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(200, 3)), columns=["a", "b", "c"])
    pdf.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double")
    got = {(r.col_a, r.col_b): r.corr for r in profile.correlation_matrix(df, ["a", "b", "c"]).collect()}
    exp = pdf.corr()
    for a in "abc":
        for b in "abc":
            assert got[(a, b)] == pytest.approx(exp.loc[a, b], abs=1e-12)


def test_histogram_box(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 3, 10, 100]], "x double")
    h = {r.bin: r["count"] for r in profile.histogram(df, ["x"], bins=10).collect()}
    assert sum(h.values()) == 6 and h[9] == 1
    b = profile.box_stats(df, ["x"]).first()
    assert b.n_outliers == 1 and b.whisker_hi == 10.0


def test_metrics_match_formulas(spark):
    y = np.array([3.0, 5.0, 2.0, 7.0])
    yh = np.array([2.5, 5.0, 4.0, 8.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, yh)], "y double, y_hat double")
    r = learn.regression_metrics(df).first()
    assert r.rmse == pytest.approx(np.sqrt(np.mean((y - yh) ** 2)))
    assert r.mae == pytest.approx(np.mean(np.abs(y - yh)))
    assert r.r2 == pytest.approx(1 - np.sum((y - yh) ** 2) / np.sum((y - y.mean()) ** 2))
    const = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "y double, y_hat double")
    assert learn.regression_metrics(const).first().r2 is None


def test_best_model_ties_and_nulls(spark):
    m = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None), ("d", float("nan"))], "model string, rmse double")
    assert learn.best_model(m, order=["a", "b", "c", "d"]).first().model == "a"
    only_bad = spark.createDataFrame([("c", None), ("d", 2.0)], "model string, rmse double")
    assert learn.best_model(only_bad).first().model == "d"


def test_registry_versions_and_latest(spark):
    path = tempfile.mkdtemp(prefix="haze-reg-") + "/reg"
    assert learn.register_model(spark, path, "m1", "/p/1", {"rmse": 1.0, "model": "x"}, ["a"]) == 1
    assert learn.register_model(spark, path, "m1", "/p/2", {"rmse": "0.5"}, ["a"]) == 2
    learn.register_model(spark, path, "m2", "/p/3", {"rmse": 2.0}, ["a"])
    latest = {r.name: (r.version, r.path) for r in learn.latest_versions(spark.read.parquet(path)).collect()}
    assert latest == {"m1": (2, "/p/2"), "m2": (1, "/p/3")}
    assert spark.read.parquet(path).where("name='m1' AND version=1").first().metrics == {"rmse": 1.0}


def test_numeric_metrics_and_format(spark):
    df = spark.createDataFrame([({"rmse": "1.5", "model": "rf", "ts": "2024-01-01T00:00"}, None, 1.23456)],
                               "m map<string,string>, a double, b double")
    r = df.select(learn.numeric_metrics(F.col("m")).alias("n"), learn.fmt4("a").alias("fa"),
                  learn.fmt4("b").alias("fb"), learn.display_name(F.lit("aqi_random_forest")).alias("d")).first()
    assert r.n == {"rmse": 1.5} and r.fa == "N/A" and r.fb == "1.2346" and r.d == "Random Forest"


def test_hash_sample_deterministic(spark):
    df = spark.range(0, 5000).withColumn("k", F.col("id"))
    h = learn.text_hash(F.col("k").cast("string"))
    a = learn.hash_sample(df, 0.2, h).count()
    b = learn.hash_sample(df.repartition(7), 0.2, h).count()
    assert a == b and 800 < a < 1200
    assert learn.fixed_sample(df, 100, h, ["k"]).count() == 100


def test_leave_one_out_attribution(spark):
    df = spark.createDataFrame([("x", dt.datetime(2024, 1, 1), 12.0, 100.0)],
                               "city string, timestamp timestamp_ntz, pm2_5 double, pm10 double")
    for p in ["ozone", "nitrogen_dioxide", "sulphur_dioxide", "carbon_monoxide"]:
        df = df.withColumn(p, F.lit(None).cast("double"))
    c = {r.feature: r.contribution for r in explain.leave_one_out(
        df, ["pm2_5", "pm10", "ozone", "nitrogen_dioxide", "sulphur_dioxide", "carbon_monoxide"],
        ["city", "timestamp"]).collect()}
    assert c["ozone"] == 0.0 and c["pm10"] > 0


def test_data_age_and_audit(spark):
    df = spark.createDataFrame([("x", dt.datetime(2024, 1, 1, 0), 1.0, 1.0), ("x", dt.datetime(2024, 1, 1, 0), 1.0, None),
                                ("x", dt.datetime(2024, 1, 3, 0), 300.0, 1.0)],
                               "city string, timestamp timestamp_ntz, pm2_5 double, pm10 double")
    for p in ["ozone", "nitrogen_dioxide", "sulphur_dioxide", "carbon_monoxide"]:
        df = df.withColumn(p, F.lit(None).cast("double"))
    a = clean.quality_audit(df, as_of=dt.datetime(2024, 1, 2)).first()
    assert (a.rows_in, a.future_rows, a.duplicate_rows, a.missing_pm_rows, a.no_aqi_rows) == (3, 1, 1, 1, 1)
    age = clean.data_age(df, dt.datetime(2024, 1, 4, 12)).first()
    assert age.age_hours == 36.0 and age.is_stale


def test_quantiles_match_numpy_at_any_number_of_ranges(spark):
    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.normal(size=3000).round(3), np.full(9000, 0.25)])
    df = spark.createDataFrame([(float(v), 7.0) for v in vals] + [(None, None), (float("nan"), float("nan"))], "x double, y double").repartition(5)
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    want = [pytest.approx(float(v), abs=1e-12) for v in np.quantile(vals, qs)]
    for ranges in (2, 7, 256):
        got = profile.quantiles(df, ["x", "y"], qs, ranges)
        assert got["x"] == want and got["y"] == [7.0] * 7
    assert profile.quantiles(df.limit(0), ["x"], qs) == {"x": [None] * 7}


def test_missing_numbers_are_not_counted(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (float("nan"),)], "x double")
    r = profile.describe(df, ["x"]).first()
    assert (r["count"], r["mean"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]) == (3, 2.0, 1.0, 1.5, 2.0, 2.5, 3.0)
    b = profile.box_stats(df, ["x"]).first()
    assert (b.q1, b.median, b.q3, b.n, b.n_outliers) == (1.5, 2.0, 2.5, 3, 0)


def test_noise_and_row_ids_do_not_depend_on_partitions(spark):
    rows = [(f"c{i}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), 1.0, 2, "t") for i in range(12) for h in range(20)]
    df = spark.createDataFrame(rows, "city string, timestamp timestamp_ntz, x double, n int, label string")
    key = ["city", "timestamp"]
    a, b = (sorted(learn.augment(df.repartition(k), 0.5, "all_numeric").collect()) for k in (3, 5))
    assert a == b
    noise = np.array([r.x - 1.0 for r in a]) / 0.5
    assert abs(noise.mean()) < 0.25 and 0.8 < noise.std() < 1.2 and all(r.label == "t" for r in a)
    assert df.select(learn.row_key(key).alias("k")).distinct().count() == 240


def test_registry_that_cannot_be_read_is_an_error(spark, tmp_path):
    path = tmp_path / "registry"
    path.mkdir()
    (path / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        learn.next_version(spark, str(path), "m")
    assert learn.next_version(spark, str(tmp_path / "none"), "m") == 1


def test_score_keeps_every_input_column(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    train = spark.createDataFrame([(float(i), float(i % 3), 2.0 * i) for i in range(20)], "a double, b double, label double")
    model = LinearRegression().fit(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(train))
    df = spark.createDataFrame([(1.0, None, "x", 9)], "a double, b double, city string, features int")
    out = learn.score(df, model, ["a", "b", "absent"][:2])
    assert out.columns == ["a", "b", "city", "features", "predicted_aqi"]
    r = out.first()
    assert r.b is None and r.features == 9 and r.predicted_aqi == pytest.approx(2.0, abs=0.2)
