import datetime as dt
import hashlib
import tempfile

from pyspark.sql import functions as F

from haze.plans import common, jobs
from haze.schemas import AIR_MEASURES, WEATHER_MEASURES
from haze.sources import payload
from haze.sources.driver_tables import air_hourly, table, weather_hourly
from haze.sources.store import FeatureTable

SF = "/root/testdata/sf0.01"


def test_ingest_train_forecast_end_to_end(spark):
    base = tempfile.mkdtemp(prefix="haze-jobs-")
    ev = table(spark, SF, "events")
    payload.build_payloads(air_hourly(ev), AIR_MEASURES).write.text(base + "/air")
    w = weather_hourly(ev).withColumn("latitude", F.lit(0.0)).withColumn("longitude", F.lit(0.0))
    payload.build_payloads(w, WEATHER_MEASURES).write.text(base + "/weather")
    t = FeatureTable(spark, base + "/features")
    # history run (whole month as the feature table) then one hourly run that adds nothing new
    t.append(common.features(spark, SF))
    n0 = t.read().count()
    as_of = dt.datetime(2024, 1, 30, 20, 30)
    hist = common.scored(spark, SF).where(F.col("timestamp") < F.lit("2024-01-29 19:00:00").cast("timestamp_ntz"))
    out = jobs.hourly_ingest(spark, base + "/air", base + "/weather", base + "/raw", t, as_of, history=hist,
                             whole_file=False)
    assert out["written"] == 0 and t.read().count() == n0

    metrics = jobs.training_run(spark, t, base + "/models", base + "/registry").collect()
    assert len(metrics) == 3 and {r.version for r in metrics} == {1}
    assert spark.read.parquet(base + "/models/metrics").count() == 3
    again = jobs.training_run(spark, t, base + "/models", base + "/registry", best_first=False).collect()
    assert {r.version for r in again} == {2} and spark.read.parquet(base + "/models/metrics").count() == 6
    for r in [*metrics, *again]:  # both runs' models are there
        assert r.path.endswith(f"/v{r.version}") and jobs.load_model(r.path) is not None
    mean_rmse = t.read().select(F.stddev_pop("AQI")).first()[0]
    assert min(r.rmse for r in metrics) < mean_rmse  # beats the mean predictor

    res = jobs.forecast_refresh(spark, t, base + "/registry", dt.datetime(2024, 1, 31))
    daily = res["daily"].collect()
    assert 1 <= len(daily) <= 9 and all(r.n_hours >= 1 for r in daily)
    assert res["hourly"].count() == 72 * 3
    imp = jobs.influence_report(t.read(), jobs.best_registered(spark, base + "/registry")[1],
                                list(spark.read.parquet(base + "/registry").first().feature_columns), n=20)
    assert imp.count() == len(spark.read.parquet(base + "/registry").first().feature_columns)


def test_backfill_features_both_plans(spark):
    base = tempfile.mkdtemp(prefix="haze-backfill-")
    raw = common.raw(spark, "/root/testdata/sf0.001")
    a = FeatureTable(spark, base + "/a")
    b = FeatureTable(spark, base + "/b")
    na = jobs.backfill_features(spark, raw, a)
    nb = jobs.backfill_features(spark, raw, b, split_rows=64)
    assert na == nb == common.features(spark, "/root/testdata/sf0.001").count()
    cols = ["city", "timestamp", "pm2_5_lag_24h", "pm2_5_rolling_std_24h", "AQI"]
    assert sorted(a.read().select(cols).collect()) == sorted(b.read().select(cols).collect())
    assert jobs.backfill_features(spark, raw, a) == 0  # idempotent


def test_training_run_on_a_sample(spark, monkeypatch):
    base = tempfile.mkdtemp(prefix="haze-sample-")
    t = FeatureTable(spark, base + "/features")
    t.append(common.features(spark, SF))
    sampled = []
    whole = jobs.series.time_split
    monkeypatch.setattr(jobs.series, "time_split", lambda df, *a, **k: sampled.append(df) or whole(df, *a, **k))
    metrics = jobs.training_run(spark, t, base + "/models", base + "/registry", sample_frac=0.5, seed=7, best_first=False).collect()
    assert len(metrics) == 3 and all(r.n > 0 for r in metrics)
    rows, all_rows = ({(r.city, r.timestamp) for r in df.select("city", "timestamp").collect()} for df in (sampled[0], t.training_set()))
    own = {(c, x) for c, x in all_rows if int(hashlib.md5(f"7:{c}|{x:%Y-%m-%d %H:%M:%S}".encode()).hexdigest()[:8], 16) < 2 ** 31}
    assert rows == own and 0 < len(rows) < len(all_rows)
