"""Registered queries: series windows (F1-F9) and the skew-proof bucketed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from haze.operators import series
from haze.plans import common
from haze.plans.catalog import R, query, rounded
from haze.plans.oracle_base import BASE, CAL, DERIVED, ORDER_RAW, SCORED, W, fill_sql, with_ctes
from haze.schemas import DERIVED_FEATURES, MODEL_FEATURES

RAW_DOUBLES = ["latitude", "longitude", "pm10", "pm2_5", "carbon_monoxide", "nitrogen_dioxide", "sulphur_dioxide",
               "ozone", "temperature_2m", "relative_humidity_2m", "surface_pressure", "wind_speed_10m",
               "wind_direction_10m", "precipitation"]
CAL_INTS = ["hour", "day_of_week", "day_of_month", "month", "quarter", "is_weekend"]
CYC = ["hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos"]
LAGS = ["pm2_5_lag_1h", "pm2_5_lag_24h", "pm10_lag_1h", "pm10_lag_24h", "temperature_2m_lag_1h",
        "temperature_2m_lag_24h"]
ROLLS = [f"{m}_rolling_{s}_24h" for m in ["pm2_5", "pm10", "ozone"] for s in ["mean", "std", "max"]]
DIFFS = ["temperature_change", "wind_speed_change"]

FULL_DOUBLES = RAW_DOUBLES + ["AQI"] + CYC + DERIVED_FEATURES
FULL_OTHER = ["AQI_Category"] + CAL_INTS
FULL_ALL = FULL_DOUBLES + FULL_OTHER


def _sel(cols_double, cols_other=(), src="derived", keys=("city", "timestamp")) -> str:
    return (f"SELECT {', '.join(keys)}, " + ", ".join([R(c) for c in cols_double] + list(cols_other))
            + f" FROM {src}")


@query("lag_features", with_ctes(*BASE, SCORED, CAL, DERIVED) + _sel(["pm2_5", "pm10", "temperature_2m"] + LAGS))
def q_lag_features(spark, sf):
    s = common.scored(spark, sf)
    return rounded(s.select("city", "timestamp", "pm2_5", "pm10", "temperature_2m",
                            *[c.alias(n) for n, c in series.lag_columns().items()]))


@query("diff_features", with_ctes(*BASE, SCORED, CAL, DERIVED) + _sel(["temperature_2m", "wind_speed_10m"] + DIFFS))
def q_diff_features(spark, sf):
    s = common.scored(spark, sf)
    return rounded(s.select("city", "timestamp", "temperature_2m", "wind_speed_10m",
                            *[c.alias(n) for n, c in series.diff_columns().items()]))


@query("rolling_features", with_ctes(*BASE, SCORED, CAL, DERIVED) + _sel(["pm2_5", "pm10", "ozone"] + ROLLS))
def q_rolling_features(spark, sf):
    s = common.scored(spark, sf)
    return rounded(s.select("city", "timestamp", "pm2_5", "pm10", "ozone",
                            *[c.alias(n) for n, c in series.rolling_columns().items()]))


def _ma(c):
    frame = f"{W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {frame} >= 24 THEN avg({c}) {frame} END"


@query("moving_average", with_ctes(*BASE) + f"""
SELECT city, timestamp, {R('temperature_2m')}, {R('pm2_5')},
       {R(_ma('temperature_2m'), 'temperature_2m_ma24')}, {R(_ma('pm2_5'), 'pm2_5_ma24')}
FROM raw""")
def q_moving_average(spark, sf):
    r = common.raw(spark, sf)
    return rounded(r.select("city", "timestamp", "temperature_2m", "pm2_5",
                            series.moving_average("temperature_2m", 24).alias("temperature_2m_ma24"),
                            series.moving_average("pm2_5", 24).alias("pm2_5_ma24")))


_FILL_COLS = ["pm2_5", "pm10", "ozone", "temperature_2m", "wind_speed_10m", "pm2_5_lag_24h"]


@query("fill_both", with_ctes(*BASE, SCORED, CAL, DERIVED) + "SELECT city, timestamp, " + ", ".join(
    R(fill_sql(c), c) for c in _FILL_COLS) + " FROM derived")
def q_fill_both(spark, sf):
    s = common.scored(spark, sf)
    lagged = s.select("city", "timestamp", "pm2_5", "pm10", "ozone", "temperature_2m", "wind_speed_10m",
                      series.lag_columns(["pm2_5"], [24])["pm2_5_lag_24h"].alias("pm2_5_lag_24h"))
    return rounded(series.fill_both(lagged, cols=_FILL_COLS))


FULL_CTE = "feat AS (SELECT city, timestamp, " + ", ".join(f"{fill_sql(c)} AS {c}" for c in FULL_ALL) + " FROM derived)"
FULL_CTES = with_ctes(*BASE, SCORED, CAL, DERIVED, FULL_CTE)
FULL_SQL = FULL_CTES + _sel(FULL_DOUBLES, FULL_OTHER, src="feat")


@query("full_features", FULL_SQL)
def q_full_features(spark, sf):
    f = common.features(spark, sf, fill="all")
    return rounded(f.select("city", "timestamp", *FULL_ALL))


NOFILL_SQL = with_ctes(*BASE, SCORED, CAL, DERIVED) + _sel(FULL_DOUBLES, FULL_OTHER)


@query("bucketed_features", NOFILL_SQL)
def q_bucketed_features(spark, sf):
    """Halo-bucket form: buckets of 100 rows per city (several per city at sf0.01)
    so the halo path is exercised; equal to the unbucketed features without fill."""
    b = series.bucketed_features(common.scored(spark, sf), bucket_rows=100, halo=24)
    return rounded(b.select("city", "timestamp", *FULL_ALL))


@query("bucketed_full_features", FULL_SQL)
def q_bucketed_full_features(spark, sf):
    """Skew-proof F9 including the back/forward fill across bucket borders; equals full_features."""
    b = series.bucketed_features(common.scored(spark, sf), bucket_rows=100, halo=24, fill="all")
    return rounded(b.select("city", "timestamp", *FULL_ALL))


_TREND = [c for c in MODEL_FEATURES if c != "hour_sin"]


def _trend_sql():
    full = FULL_CTES.rstrip()
    aggs = ", ".join(R(f"(arg_max({c}, timestamp) - arg_min({c}, timestamp)) / CAST(COUNT(*) AS DOUBLE)",
                       f"{c}_trend") for c in _TREND)
    return full + f""",
recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn FROM feat)
           WHERE rn <= 24)
SELECT city, COUNT(*) AS n_rows, {aggs} FROM recent GROUP BY city"""


@query("recent_trend", _trend_sql())
def q_recent_trend(spark, sf):
    f = common.features(spark, sf)
    return rounded(series.recent_trend(f, _TREND, 24))


def _last_sql():
    full = FULL_CTES.rstrip()
    cols = ", ".join(R(c) for c in MODEL_FEATURES)
    return full + f"""
SELECT city, timestamp, {cols}, {R('AQI')} FROM (
  SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn FROM feat) WHERE rn = 1"""


@query("last_row", _last_sql())
def q_last_row(spark, sf):
    f = common.features(spark, sf).select("city", "timestamp", *MODEL_FEATURES, "AQI")
    return rounded(series.last_row(f))


@query("time_split", with_ctes(*BASE, SCORED) + """
SELECT city, timestamp, row_idx,
       CASE WHEN row_idx < n - n // 4 THEN 'train' ELSE 'test' END AS split
FROM (SELECT city, timestamp, row_number() OVER (ORDER BY timestamp, city) - 1 AS row_idx, COUNT(*) OVER () AS n
      FROM scored)""")
def q_time_split(spark, sf):
    s = common.scored(spark, sf).select("city", "timestamp")
    return series.time_split(s, ["timestamp", "city"], n_splits=3).select("city", "timestamp", "row_idx", "split")


@query("row_positions", with_ctes(*BASE) + """
SELECT city, timestamp, row_number() OVER (PARTITION BY city ORDER BY timestamp) - 1 AS pos FROM raw""")
def q_row_positions(spark, sf):
    return series.row_positions(common.raw(spark, sf).select("city", "timestamp")).withColumnRenamed("_pos", "pos")



@query("order_series_features", with_ctes(ORDER_RAW, SCORED, CAL, DERIVED, FULL_CTE) + _sel(FULL_DOUBLES, FULL_OTHER, src="feat"))
def q_order_series_features(spark, sf):
    """F9 over a long series: per customer nation and order date from lineitem x orders x customer."""
    from haze.operators.clean import drop_missing, with_aqi
    from haze.sources.driver_tables import order_series

    s = drop_missing(with_aqi(drop_missing(order_series(spark, sf), ["pm2_5", "pm10"])), ["AQI"])
    f = series.full_features(s, fill="all")
    return rounded(f.select("city", "timestamp", *FULL_ALL))
