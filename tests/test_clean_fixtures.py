"""FIXTURES.md section 2 cases: gaps, nulls, duplicates, future rows, two cities,
short series, day edge around local midnight (UTC+5)."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from haze.functions.timefeat import calendar_columns
from haze.operators import clean, series

T0 = dt.datetime(2024, 1, 1, 0, 0)


def _raw(spark, rows):
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, city string, pm2_5 double, pm10 double")


def test_duplicates_fan_out_then_keep_first(spark):
    air = _raw(spark, [(T0, "a", 1.0, 2.0), (T0, "a", 5.0, 6.0)])
    weather = spark.createDataFrame([(T0, "a", 10.0), (T0, "a", 20.0)], "timestamp timestamp_ntz, city string, t double")
    j = clean.join_air_weather(air, weather)
    assert j.count() == 4  # both sides duplicated: the equi join fans out like the source merge
    kept = clean.dedup_first(j.withColumn("ingest_seq", F.col("pm2_5") * 100 + F.col("t")), ["city", "timestamp"])
    r = kept.collect()
    assert len(r) == 1 and r[0].pm2_5 == 1.0 and r[0].t == 10.0


def test_future_and_today_window_day_edge(spark):
    rows = [(dt.datetime(2024, 1, 9, h), "a", 1.0, 1.0) for h in range(17, 24)] + \
           [(dt.datetime(2024, 1, 10, h), "a", 1.0, 1.0) for h in range(0, 4)]
    df = _raw(spark, rows)
    as_of = dt.datetime(2024, 1, 10, 2, 30)  # 07:30 local on Jan 10
    assert clean.drop_future(df, as_of).count() == 10
    start, hour = clean.today_bounds(as_of)
    assert start == dt.datetime(2024, 1, 9, 19, 0) and hour == dt.datetime(2024, 1, 10, 2, 0)
    got = [r.timestamp.hour for r in clean.today_window(df, as_of).orderBy("timestamp").collect()]
    assert got == [19, 20, 21, 22, 23, 0, 1, 2]
    spans = clean.date_span(df).first()
    assert spans.n_dates == 2 and spans.multi_date  # 17:00-18:00 UTC are the previous local date


def test_calendar_at_local_midnight(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 6, 18, 59),), (dt.datetime(2024, 1, 6, 19, 0),)],
                               "timestamp timestamp_ntz")
    cal = df.select(*[c.alias(n) for n, c in calendar_columns("timestamp").items()]).collect()
    # 2024-01-06 23:59 local is a Saturday; 19:00 UTC is Sunday 00:00 local
    assert (cal[0].hour, cal[0].day_of_week, cal[0].is_weekend, cal[0].day_of_month) == (23, 5, 1, 6)
    assert (cal[1].hour, cal[1].day_of_week, cal[1].is_weekend, cal[1].day_of_month) == (0, 6, 1, 7)
    assert cal[1].hour_sin == pytest.approx(0.0, abs=1e-12) and cal[1].hour_cos == pytest.approx(1.0)


def test_two_cities_do_not_leak(spark):
    rows = []
    for i in range(30):
        rows.append((T0 + dt.timedelta(hours=i), "a", float(i), 1.0))
        rows.append((T0 + dt.timedelta(hours=i), "b", float(1000 + i), 1.0))
    df = _raw(spark, rows)
    out = df.select("city", "timestamp", *[c.alias(n) for n, c in series.lag_columns(["pm2_5"], [1]).items()])
    first = {r.city: r.pm2_5_lag_1h for r in out.where(F.col("timestamp") == F.lit(T0)).collect()}
    assert first == {"a": None, "b": None}
    second = {r.city: r.pm2_5_lag_1h for r in out.where(F.col("timestamp") == F.lit(T0 + dt.timedelta(hours=1))).collect()}
    assert second == {"a": 0.0, "b": 1000.0}


@pytest.mark.parametrize("n, kept", [(10, 0), (23, 0), (24, 24)])
def test_short_series_guard_and_null_lag24(spark, n, kept):
    df = _raw(spark, [(T0 + dt.timedelta(hours=i), "a", float(i), 1.0) for i in range(n)])
    assert clean.min_history(df, 24).count() == kept
    lag24 = df.select(series.lag_columns(["pm2_5"], [24])["pm2_5_lag_24h"].alias("l")).collect()
    assert all(r.l is None for r in lag24)


def test_gap_hours_rows_vs_time_frames(spark):
    hours = [h for h in range(60) if h not in (10, 11, 30)]
    df = _raw(spark, [(T0 + dt.timedelta(hours=h), "a", float(h), 1.0) for h in hours])
    rows = series.rolling_columns(["pm2_5"], by="rows")
    time = series.rolling_columns(["pm2_5"], by="time")
    out = df.select("timestamp", rows["pm2_5_rolling_max_24h"].alias("r"), time["pm2_5_rolling_max_24h"].alias("t"),
                    rows["pm2_5_rolling_mean_24h"].alias("rm"), time["pm2_5_rolling_mean_24h"].alias("tm"))
    at = {r.timestamp: r for r in out.collect()}
    r = at[T0 + dt.timedelta(hours=40)]
    assert r.r == 39.0 and r.t == 39.0
    # 24 previous rows reach back past the gap (to hour 15); 24 previous hours stop at hour 16
    prev_rows = [h for h in hours if h < 40][-24:]
    assert prev_rows[0] == 15 and r.rm == pytest.approx(sum(prev_rows) / 24)
    assert r.tm == pytest.approx(sum([h for h in hours if 16 <= h < 40]) / len([h for h in hours if 16 <= h < 40]))


def test_conform_names_metadata_types(spark):
    df = spark.createDataFrame([(T0, 1.0, "x")], "Timestamp timestamp_ntz, AQI double, City string")
    low = clean.lower_names(df)
    assert low.columns == ["timestamp", "aqi", "city"]
    back = clean.restore_names(low, ["timestamp", "city", "AQI"])
    assert back.columns == ["timestamp", "AQI", "city"]
    alias = clean.restore_names(df.select("Timestamp", "City"), ["timestamp", "city"],
                                {"Timestamp": "timestamp", "City": "city"})
    assert set(alias.columns) == {"timestamp", "city"}
    meta = clean.with_metadata(df.withColumn("latitude", F.lit(None).cast("double")), latitude=33.6, longitude=73.0)
    r = meta.first()
    assert r.latitude == 33.6 and r.longitude == 73.0
    assert clean.columns_of_type(df, "numeric") == ["AQI"] and clean.columns_of_type(df, "string") == ["City"]
    assert clean.feature_columns(spark.createDataFrame([(1.0, 2.0, T0)], "a double, AQI double, timestamp timestamp_ntz")) == ["a"]
    assert clean.conform(df, ["AQI", "nope"], on_missing="fill").columns == ["AQI", "nope"]
    with pytest.raises(ValueError):
        clean.conform(df, ["nope"], on_missing="error")
