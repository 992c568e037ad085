"""Registered queries over a series for every user: the number of series grows with the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from haze.operators import forecast, series
from haze.operators.clean import drop_missing, with_aqi
from haze.plans.catalog import R, query, rounded
from haze.plans.oracle_base import CAL, DERIVED, SCORED, USER_RAW, with_ctes
from haze.plans.q_learn import baserow_sql
from haze.plans.q_series import FULL_ALL, FULL_CTE, FULL_DOUBLES, FULL_OTHER, _sel
from haze.plans.q_store import _out, _stored_sql
from haze.schemas import MODEL_FEATURES
from haze.session import scratch_path
from haze.sources.driver_tables import user_series
from haze.sources.store import FeatureTable

USER_SCORED = with_ctes(USER_RAW, SCORED)
USER_CTES = with_ctes(USER_RAW, SCORED, CAL, DERIVED, FULL_CTE)


def scored(spark, sf):
    return drop_missing(with_aqi(drop_missing(user_series(spark, sf), ["pm2_5", "pm10"])), ["AQI"])


def features(spark, sf):
    return series.full_features(scored(spark, sf), fill="all")


@query("user_full_features", USER_CTES + _sel(FULL_DOUBLES, FULL_OTHER, src="feat"))
def q_user_full_features(spark, sf):
    return rounded(features(spark, sf).select("city", "timestamp", *FULL_ALL))


@query("user_store_append", USER_CTES + _stored_sql())
def q_user_store_append(spark, sf):
    t = FeatureTable(spark, scratch_path(spark, "users"))
    f = features(spark, sf)
    t.append(f.where(F.col("timestamp") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")))
    t.append(f)
    return _out(t.read())


@query("user_time_split", USER_SCORED + """
SELECT city, timestamp, row_idx, CASE WHEN row_idx < n - n // 4 THEN 'train' ELSE 'test' END AS split
FROM (SELECT city, timestamp, row_number() OVER (ORDER BY timestamp, city) - 1 AS row_idx, COUNT(*) OVER () AS n FROM scored)""")
def q_user_time_split(spark, sf):
    return series.time_split(scored(spark, sf).select("city", "timestamp"), ["timestamp", "city"])


@query("user_tail_rows", USER_SCORED + f"""
SELECT city, timestamp, {R('AQI')} FROM (
  SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn FROM scored) WHERE rn <= 7""")
def q_user_tail_rows(spark, sf):
    return rounded(series.tail_rows(scored(spark, sf).select("city", "timestamp", "AQI"), 7))


@query("user_forecast_inputs", baserow_sql(USER_CTES) + "SELECT city, step, timestamp, " + ", ".join(R(c) for c in MODEL_FEATURES) + " FROM inp")
def q_user_forecast_inputs(spark, sf):
    grid = forecast.forecast_grid(forecast.forecast_base(features(spark, sf)))
    return rounded(forecast.forecast_inputs(grid).select("city", "step", "timestamp", *MODEL_FEATURES))
