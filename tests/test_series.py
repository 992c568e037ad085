import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from haze.operators import series


def _frame(spark, n=80, seed=3, cities=("a", "b")):
    rng = np.random.default_rng(seed)
    rows = []
    for c in cities:
        ts = pd.date_range("2024-01-01", periods=n + 5, freq="h")
        keep = sorted(rng.choice(len(ts), n, replace=False))  # gaps in time
        for i in keep:
            v = float(rng.uniform(0, 100)) if rng.random() > 0.2 else None
            w = float(rng.uniform(0, 10)) if rng.random() > 0.1 else None
            rows.append((c, ts[i].to_pydatetime(), v, w))
    return spark.createDataFrame(rows, "city string, timestamp timestamp_ntz, x double, y double")


def _pandas(df):
    return df.toPandas().sort_values(["city", "timestamp"]).reset_index(drop=True)


def test_rolling_lag_diff_parity(spark):
    df = _frame(spark)
    w = series.series_window()
    out = df.select("city", "timestamp", "x", "y",
                    F.avg("x").over(w.rowsBetween(-24, -1)).alias("m"),
                    F.stddev_samp("x").over(w.rowsBetween(-24, -1)).alias("s"),
                    F.max("x").over(w.rowsBetween(-24, -1)).alias("mx"),
                    *[c.alias(n) for n, c in series.lag_columns(["x"], [1, 24]).items()],
                    (F.col("y") - F.lag("y", 1).over(w)).alias("dy"))
    got = _pandas(out)
    for _, g in got.groupby("city"):
        x = g["x"].astype(float)
        sh = x.shift(1)
        np.testing.assert_allclose(g["m"].astype(float), sh.rolling(24, min_periods=1).mean(), equal_nan=True)
        np.testing.assert_allclose(g["s"].astype(float), sh.rolling(24, min_periods=1).std(), equal_nan=True,
                                   rtol=1e-9)
        np.testing.assert_allclose(g["mx"].astype(float), sh.rolling(24, min_periods=1).max(), equal_nan=True)
        np.testing.assert_allclose(g["x_lag_24h"].astype(float), x.shift(24), equal_nan=True)
        np.testing.assert_allclose(g["dy"].astype(float), g["y"].astype(float).diff(1), equal_nan=True)


def test_fill_both_parity(spark):
    df = _frame(spark)
    got = _pandas(series.fill_both(df, cols=["x", "y"]))
    src = _pandas(df)
    for c, g in src.groupby("city"):
        exp = g[["x", "y"]].astype(float).bfill().ffill()
        np.testing.assert_allclose(got[got.city == c][["x", "y"]].astype(float).to_numpy(), exp.to_numpy())


def test_moving_average_needs_full_window(spark):
    df = _frame(spark)
    got = _pandas(df.select("city", "timestamp", "x", series.moving_average("x", 24).alias("ma")))
    for _, g in got.groupby("city"):
        np.testing.assert_allclose(g["ma"].astype(float), g["x"].astype(float).rolling(24).mean(), equal_nan=True)


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan


def test_full_features_one_exchange_no_python(spark):
    df = _frame(spark).withColumnsRenamed({"x": "pm2_5", "y": "pm10"})
    for c in ["ozone", "temperature_2m", "relative_humidity_2m", "wind_speed_10m", "surface_pressure", "AQI"]:
        df = df.withColumn(c, F.col("pm10") * 1.5)
    out = series.full_features(df, fill="all")
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(city") == 1, plan
    assert "Python" not in plan


def test_bucketed_equals_unbucketed(spark):
    df = _frame(spark, n=150).withColumnsRenamed({"x": "pm2_5", "y": "pm10"})
    for c in ["ozone", "temperature_2m", "relative_humidity_2m", "wind_speed_10m", "surface_pressure", "AQI"]:
        df = df.withColumn(c, F.col("pm10") * 1.5)
    a = series.full_features(df, fill="none")
    b = series.bucketed_features(df, bucket_rows=32, halo=24)
    cols = ["city", "timestamp", "pm2_5_rolling_std_24h", "pm2_5_lag_24h", "temperature_change"]
    pa = a.select(cols).toPandas().sort_values(["city", "timestamp"]).reset_index(drop=True)
    pb = b.select(cols).toPandas().sort_values(["city", "timestamp"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(pa, pb, check_exact=False, rtol=1e-12)


def test_global_row_index_no_single_partition(spark):
    df = _frame(spark, n=300, cities=("a", "b", "c"))
    out = series.global_row_index(df, ["timestamp", "city"], n_parts=5)
    got = out.select("city", "timestamp", "row_idx").toPandas()
    exp = df.toPandas().sort_values(["timestamp", "city"]).reset_index(drop=True)
    exp["row_idx"] = np.arange(len(exp))
    m = got.merge(exp[["city", "timestamp", "row_idx"]], on=["city", "timestamp"], suffixes=("", "_e"))
    assert len(m) == len(exp) and (m.row_idx == m.row_idx_e).all()
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_time_split_sizes(spark):
    df = _frame(spark, n=100, cities=("a", "b"))
    out = series.time_split(df, ["timestamp", "city"], n_splits=3).toPandas()
    n = 200
    assert (out.split == "test").sum() == n // 4
    assert (out.split == "train").sum() == n - n // 4


def test_last_row_and_trend(spark):
    df = _frame(spark)
    last = series.last_row(df.select("city", "timestamp", "y")).toPandas().set_index("city")
    src = _pandas(df)
    for c, g in src.groupby("city"):
        assert last.loc[c, "timestamp"] == g["timestamp"].iloc[-1]
    tr = series.recent_trend(df.na.fill(0.0), ["x"], 24).toPandas().set_index("city")
    for c, g in src.fillna(0.0).groupby("city"):
        v = g["x"].tail(24).to_numpy()
        assert tr.loc[c, "x_trend"] == pytest.approx((v[-1] - v[0]) / len(v))


def test_tail_rows_dense_and_sparse_keys(spark):
    import datetime as dt

    rows = [("dense", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), float(h)) for h in range(100)]
    rows += [("sparse", dt.datetime(2024, 1, 1) + dt.timedelta(days=d), float(d)) for d in range(40)]
    df = spark.createDataFrame(rows, "city string, timestamp timestamp_ntz, x double")
    got = series.tail_rows(df, 24).toPandas()
    assert (got.groupby("city").size() == 24).all()
    assert sorted(got[got.city == "sparse"].x)[0] == 16.0 and sorted(got[got.city == "dense"].x)[0] == 76.0
    bound = spark.createDataFrame([("dense", dt.datetime(2024, 1, 2))], "city string, _bound timestamp_ntz")
    before = series.tail_rows(df, 5, before=bound).toPandas()
    assert sorted(before.x) == [19.0, 20.0, 21.0, 22.0, 23.0]


def test_bucketed_fill_matches_fill_both(spark):
    df = _frame(spark, n=120)
    pos = series.row_positions(df).withColumn("_b", F.floor(F.col("_pos") / 16))
    a = series.bucketed_fill(pos, ["x", "y"], ["city"], "_b", "_pos").drop("_b", "_pos")
    b = series.fill_both(df, cols=["x", "y"])
    pa = a.toPandas().sort_values(["city", "timestamp"]).reset_index(drop=True)
    pb = b.toPandas().sort_values(["city", "timestamp"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(pa[["city", "timestamp", "x", "y"]], pb[["city", "timestamp", "x", "y"]])


def _scored(spark, n=150):
    df = _frame(spark, n=n).withColumnsRenamed({"x": "pm2_5", "y": "pm10"})
    for c in ["ozone", "temperature_2m", "relative_humidity_2m", "wind_speed_10m", "surface_pressure", "AQI"]:
        df = df.withColumn(c, F.col("pm10") * 1.5)
    return df


def test_bucketed_features_match_the_window_plan(spark):
    df = _scored(spark)
    cols = ["city", "timestamp", "pm2_5_rolling_mean_24h", "pm10_lag_24h", "pm2_5", "hour_sin"]
    pa, pb = (f.select(cols).toPandas().sort_values(["city", "timestamp"]).reset_index(drop=True) for f in (
        series.full_features(df, fill="all"), series.bucketed_features(df, bucket_rows=32, fill="all")))
    pd.testing.assert_frame_equal(pa, pb, check_exact=False, rtol=1e-12)


def test_buckets_shorter_than_the_halo_are_refused(spark):
    with pytest.raises(ValueError):
        series.bucketed_features(_scored(spark, 40), bucket_rows=10)


def test_lags_by_time_are_null_in_gaps(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(hours=h), float(h)) for h in range(40) if h not in (5, 6)]
    df = spark.createDataFrame(rows, "city string, timestamp timestamp_ntz, x double")
    lags = series.lag_columns(["x"], [1, 24], by="time")
    got = {int(r.x): (r.x_lag_1h, r.x_lag_24h) for r in df.select("x", *[c.alias(n) for n, c in lags.items()]).collect()}
    assert got[4] == (3.0, None) and got[7] == (None, None) and got[29] == (28.0, None) and got[31] == (30.0, 7.0)
