import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from haze.operators import forecast
from haze.schemas import MODEL_FEATURES


def _features(spark, last_hour=18, n=30):
    rows = []
    t_end = dt.datetime(2024, 1, 10, last_hour)
    for i in range(n):
        t = t_end - dt.timedelta(hours=n - 1 - i)
        rows.append(tuple([t, "x"] + [float(i + j) for j in range(len(MODEL_FEATURES))]))
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, city string, "
                                 + ", ".join(f"{c} double" for c in MODEL_FEATURES))


def test_grid_and_inputs(spark):
    f = _features(spark)
    base = forecast.forecast_base(f)
    grid = forecast.forecast_grid(base)
    assert grid.count() == 72
    inp = forecast.forecast_inputs(grid).orderBy("step").collect()
    # trend = (last - first) / 24 rows = 23/24 for every drifted column
    assert inp[0]["pm2_5"] == pytest.approx(29.0 + 23 / 24)
    assert inp[0]["timestamp"] == dt.datetime(2024, 1, 10, 19)
    # 19:00 UTC is local midnight (UTC+5): hour_sin = sin(0) = 0
    assert inp[0]["hour_sin"] == pytest.approx(0.0, abs=1e-12)


def test_drift_clamps_to_zero(spark):
    grid = spark.createDataFrame([("x", dt.datetime(2024, 1, 1), 2, 1.0, -5.0, None, 1.0)],
                                 "city string, timestamp timestamp_ntz, step int, a double, a_trend double, b double, b_trend double")
    r = forecast.forecast_inputs(grid, ["a", "b"]).first()
    assert (r.a, r.b) == (0.0, 0.0)


@pytest.mark.parametrize("last_hour", [18, 19])  # 23:00 and 00:00 local
def test_daily_after_as_of(spark, last_hour):
    f = _features(spark, last_hour)
    grid = forecast.forecast_grid(forecast.forecast_base(f))
    hourly = grid.select("city", "timestamp", F.col("step").cast("double").alias("predicted_aqi"))
    as_of = dt.datetime(2024, 1, 10, last_hour)
    daily = forecast.daily_forecast(hourly, as_of).orderBy("date").collect()
    assert len(daily) == 3
    today_local = (as_of + dt.timedelta(hours=5)).date()
    assert all(r.date > today_local for r in daily)
    assert daily[0].n_hours == 24


def test_landing_stream_is_idempotent(spark):
    from haze.sources.payload import build_payloads
    from haze.streaming.jobs import landed_table, landing_stream

    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), "c", 1.0, 2.0, float(h)) for h in range(30)]
    hourly = spark.createDataFrame(rows, "timestamp timestamp_ntz, city string, latitude double, longitude double, "
                                         "pm10 double")
    base = tempfile.mkdtemp(prefix="haze-stream-")
    build_payloads(hourly, ["pm10"]).write.text(base + "/land")
    build_payloads(hourly, ["pm10"]).write.text(base + "/land/again")  # duplicate landing
    for _ in range(2):
        q = landing_stream(spark, base + "/land/*", base + "/sink", base + "/ck", ["pm10"], whole_file=False)
        q.awaitTermination()
    out = landed_table(spark, base + "/sink", ["pm10"]).read()
    assert out.count() == 30
    assert out.groupBy("city", "timestamp").count().where("count > 1").count() == 0


def test_late_files_are_stored(spark):
    from haze.sources.payload import build_payloads
    from haze.streaming.jobs import landed_table, landing_stream

    base = tempfile.mkdtemp(prefix="haze-late-")
    for day in (20, 21, 5):
        rows = [(dt.datetime(2024, 1, day, h), "c", 1.0, 2.0, float(h)) for h in range(24)]
        hourly = spark.createDataFrame(rows, "timestamp timestamp_ntz, city string, latitude double, longitude double, pm10 double")
        build_payloads(hourly, ["pm10"]).write.mode("append").text(base + "/land")
        landing_stream(spark, base + "/land", base + "/sink", base + "/ck", ["pm10"], whole_file=False).awaitTermination()
    assert landed_table(spark, base + "/sink", ["pm10"]).read().count() == 72
