"""Registered queries: AQI functions, filters, joins, audits, time features."""

from __future__ import annotations

from pyspark.sql import functions as F

from haze.functions.aqi import aqi_category, aqi_subindex, display_band, overall_aqi
from haze.functions.timefeat import calendar_columns, local_time
from haze.operators import clean
from haze.operators.aqi_join import aqi_long_rangejoin
from haze.plans import common
from haze.plans.catalog import AS_OF, AS_OF_SQL, R, query, rounded
from haze.plans.oracle_base import (BASE, CAL, SCORED, band_sql, category_sql, d, local_sql,
                                    overall_sql, subindex_sql, with_ctes)
from haze.schemas import AQI_POLLUTANT_ORDER, HAZARD_ADVICE

RAW16 = ["timestamp", "city", "latitude", "longitude", "pm10", "pm2_5", "carbon_monoxide", "nitrogen_dioxide",
         "sulphur_dioxide", "ozone", "temperature_2m", "relative_humidity_2m", "surface_pressure",
         "wind_speed_10m", "wind_direction_10m", "precipitation"]
RAW_DOUBLES = RAW16[2:]


def raw_select_sql(src: str = "raw", where: str = "") -> str:
    cols = ", ".join(["timestamp", "city"] + [R(c) for c in RAW_DOUBLES])
    return f"SELECT {cols} FROM {src} {where}"


# ------------------------------------------------------------------ flagship
def daily_aqi(spark, sf):
    """Minimum slice: RAW -> drop missing -> AQI/category -> per city and local date."""
    s = common.scored(spark, sf)
    day = F.to_date(local_time("timestamp"))
    cats = ["Good", "Moderate", "Unhealthy for Sensitive Groups", "Unhealthy", "Very Unhealthy", "Hazardous"]
    names = ["n_good", "n_moderate", "n_usg", "n_unhealthy", "n_very_unhealthy", "n_hazardous"]
    out = s.groupBy("city", day.alias("date")).agg(
        F.count(F.lit(1)).alias("n_hours"), F.avg("AQI").alias("mean_aqi"), F.max("AQI").alias("max_aqi"),
        *[F.count_if(F.col("AQI_Category") == c).alias(n) for c, n in zip(cats, names)])
    return rounded(out)


_cats = ["Good", "Moderate", "Unhealthy for Sensitive Groups", "Unhealthy", "Very Unhealthy", "Hazardous"]
_names = ["n_good", "n_moderate", "n_usg", "n_unhealthy", "n_very_unhealthy", "n_hazardous"]
DAILY_AQI_SQL = with_ctes(*BASE, SCORED) + f"""
SELECT city, CAST({local_sql()} AS DATE) AS date, COUNT(*) AS n_hours,
       {R('avg(AQI)', 'mean_aqi')}, {R('max(AQI)', 'max_aqi')},
       {', '.join(f"COUNT(*) FILTER (WHERE AQI_Category = '{c}') AS {n}" for c, n in zip(_cats, _names))}
FROM scored GROUP BY 1, 2"""
query("daily_aqi", DAILY_AQI_SQL)(daily_aqi)


# ------------------------------------------------------------------ I1 .. I4, D4
@query("aqi_subindex", with_ctes(*BASE) + "SELECT city, timestamp, " + ", ".join(
    R(subindex_sql(p, p), f"aqi_{p}") for p in AQI_POLLUTANT_ORDER) + " FROM raw")
def q_aqi_subindex(spark, sf):
    r = common.raw(spark, sf)
    return rounded(r.select("city", "timestamp", *[aqi_subindex(p, p).alias(f"aqi_{p}") for p in AQI_POLLUTANT_ORDER]))


@query("aqi_overall", with_ctes(*BASE) + f"SELECT city, timestamp, {R(overall_sql(), 'AQI')}, "
       f"{R(overall_sql().replace('greatest', 'greatest'), 'AQI_ref')}, "
       f"{R('greatest(' + ', '.join(subindex_sql(p, p) for p in AQI_POLLUTANT_ORDER) + ')', 'AQI_skip')} FROM raw")
def q_aqi_overall(spark, sf):
    r = common.raw(spark, sf)
    return rounded(r.select("city", "timestamp", overall_aqi().alias("AQI"), overall_aqi().alias("AQI_ref"),
                            overall_aqi(nan_policy="skip").alias("AQI_skip")))


@query("aqi_category", with_ctes(*BASE) + f"""
SELECT city, timestamp, {R('AQI')}, {category_sql('AQI')} AS AQI_Category
FROM (SELECT city, timestamp, {overall_sql()} AS AQI FROM raw)""")
def q_aqi_category(spark, sf):
    r = common.raw(spark, sf).select("city", "timestamp", overall_aqi().alias("AQI"))
    return rounded(r.withColumn("AQI_Category", aqi_category("AQI")))


@query("aqi_band_lookup", with_ctes(*BASE, SCORED) + f"""
SELECT city, timestamp, {R('AQI')}, {band_sql('AQI')} AS band,
       CASE WHEN AQI > {d(200.0)} THEN '{HAZARD_ADVICE}' ELSE NULL END AS advice,
       {R(f'least(AQI, {d(500.0)}) / {d(500.0)}', 'gauge')}
FROM scored""")
def q_aqi_band_lookup(spark, sf):
    s = common.scored(spark, sf)
    return rounded(s.select("city", "timestamp", "AQI", display_band("AQI").alias("band"),
                            F.when(F.col("AQI") > F.lit(200.0), F.lit(HAZARD_ADVICE)).alias("advice"),
                            (F.least(F.col("AQI"), F.lit(500.0)) / F.lit(500.0)).alias("gauge")))


@query("aqi_long_rangejoin", with_ctes(*BASE) + f"""
, long AS (
  SELECT city, timestamp, 'pm2_5' AS pollutant, pm2_5 AS conc FROM raw UNION ALL
  SELECT city, timestamp, 'pm10', pm10 FROM raw UNION ALL
  SELECT city, timestamp, 'ozone', ozone FROM raw UNION ALL
  SELECT city, timestamp, 'nitrogen_dioxide', nitrogen_dioxide FROM raw UNION ALL
  SELECT city, timestamp, 'sulphur_dioxide', sulphur_dioxide FROM raw UNION ALL
  SELECT city, timestamp, 'carbon_monoxide', carbon_monoxide FROM raw)
SELECT city, timestamp, pollutant, {R('conc')},
       {R(" CASE pollutant " + " ".join(f"WHEN '{p}' THEN {subindex_sql('conc', p)}" for p in AQI_POLLUTANT_ORDER) + " END", 'sub_index')}
FROM long WHERE conc IS NOT NULL""".replace("WITH ", "WITH ", 1).replace("\n, long", ",\nlong"))
def q_aqi_long_rangejoin(spark, sf):
    return rounded(aqi_long_rangejoin(common.raw(spark, sf)))


# ------------------------------------------------------------------ D1, C2 .. C5, E11 .. E13
@query("air_weather_join", with_ctes(*BASE) + raw_select_sql())
def q_air_weather_join(spark, sf):
    return rounded(common.raw(spark, sf).select(*RAW16))


@query("drop_missing", with_ctes(*BASE) + raw_select_sql(where="WHERE pm2_5 IS NOT NULL AND pm10 IS NOT NULL"))
def q_drop_missing(spark, sf):
    return rounded(clean.drop_missing(common.raw(spark, sf), ["pm2_5", "pm10"]).select(*RAW16))


@query("drop_future", with_ctes(*BASE) + raw_select_sql(where=f"WHERE timestamp <= {AS_OF_SQL}"))
def q_drop_future(spark, sf):
    return rounded(clean.drop_future(common.raw(spark, sf), AS_OF).select(*RAW16))


_start, _hour = clean.today_bounds(AS_OF)


@query("today_window", with_ctes(*BASE) + raw_select_sql(
    where=f"WHERE timestamp >= TIMESTAMP '{_start}' AND timestamp <= TIMESTAMP '{_hour}'"))
def q_today_window(spark, sf):
    return rounded(clean.today_window(common.raw(spark, sf), AS_OF).select(*RAW16))


@query("city_filter", with_ctes(*BASE) + raw_select_sql(where="WHERE city = 's1'"))
def q_city_filter(spark, sf):
    return rounded(clean.city_filter(common.raw(spark, sf), "s1").select(*RAW16))


@query("quality_audit", with_ctes(*BASE) + f"""
, k AS (
  SELECT city, timestamp, COUNT(*) AS n,
         COUNT(*) FILTER (WHERE timestamp > {AS_OF_SQL}) AS nf,
         COUNT(*) FILTER (WHERE pm2_5 IS NULL OR pm10 IS NULL) AS nm,
         COUNT(*) FILTER (WHERE NOT (pm2_5 IS NULL OR pm10 IS NULL) AND {overall_sql()} IS NULL) AS na
  FROM raw GROUP BY city, timestamp)
SELECT city, CAST(SUM(n) AS BIGINT) AS rows_in, CAST(SUM(nf) AS BIGINT) AS future_rows,
       CAST(SUM(n - 1) AS BIGINT) AS duplicate_rows, CAST(SUM(nm) AS BIGINT) AS missing_pm_rows,
       CAST(SUM(na) AS BIGINT) AS no_aqi_rows
FROM k GROUP BY city""".replace("\n, k AS", ",\nk AS"))
def q_quality_audit(spark, sf):
    return clean.quality_audit(common.raw(spark, sf), as_of=AS_OF)


@query("dedup_first", with_ctes(*BASE) + f"""
, u AS (SELECT city, timestamp, pm2_5, pm10 FROM air UNION ALL SELECT city, timestamp, pm2_5, pm10 FROM air
        WHERE pm2_5 IS NOT NULL)
SELECT city, timestamp, {R('pm2_5')}, {R('pm10')} FROM (
  SELECT *, row_number() OVER (PARTITION BY city, timestamp ORDER BY pm2_5 ASC NULLS LAST, pm10 ASC NULLS LAST) AS rn
  FROM u) WHERE rn = 1""".replace("\n, u AS", ",\nu AS"))
def q_dedup_first(spark, sf):
    a = common.air(spark, sf).select("city", "timestamp", "pm2_5", "pm10")
    u = a.unionByName(a.where(F.col("pm2_5").isNotNull()))
    return rounded(clean.dedup_first(u, ["city", "timestamp"]))


@query("date_span", with_ctes(*BASE) + f"""
SELECT city, COUNT(DISTINCT CAST({local_sql()} AS DATE)) AS n_dates,
       min(CAST({local_sql()} AS DATE)) AS first_date, max(CAST({local_sql()} AS DATE)) AS last_date,
       COUNT(DISTINCT CAST({local_sql()} AS DATE)) > 1 AS multi_date
FROM raw GROUP BY city""")
def q_date_span(spark, sf):
    return clean.date_span(common.raw(spark, sf))


@query("min_history", with_ctes(*BASE, SCORED) + f"""
SELECT city, timestamp, {R('AQI')} FROM scored
WHERE city IN (SELECT city FROM scored GROUP BY city HAVING COUNT(*) >= 24)""")
def q_min_history(spark, sf):
    return rounded(clean.min_history(common.scored(spark, sf), 24).select("city", "timestamp", "AQI"))


@query("data_age", with_ctes(*BASE) + f"""
SELECT city, max(timestamp) AS last_timestamp,
       {R(f"CAST(epoch_us({AS_OF_SQL}) - epoch_us(max(timestamp)) AS DOUBLE) / {d(3.6e9)}", 'age_hours')},
       CAST(epoch_us({AS_OF_SQL}) - epoch_us(max(timestamp)) AS DOUBLE) / {d(3.6e9)} > {d(24.0)} AS is_stale
FROM raw WHERE timestamp <= {AS_OF_SQL} GROUP BY city""")
def q_data_age(spark, sf):
    r = clean.drop_future(common.raw(spark, sf), AS_OF)
    return rounded(clean.data_age(r, AS_OF))


# ------------------------------------------------------------------ C6, C12, C13
_STORED_NO_TS = ["city", "latitude", "longitude", "pm2_5", "pm10", "nitrogen_dioxide", "carbon_monoxide",
                 "relative_humidity_2m", "sulphur_dioxide", "temperature_2m", "ozone", "AQI", "AQI_Category"]


@query("feature_select", with_ctes(*BASE, SCORED) + "SELECT timestamp, " + ", ".join(
    c if c in ("city", "AQI_Category") else R(c) for c in _STORED_NO_TS) + " FROM scored")
def q_feature_select(spark, sf):
    from haze.schemas import FEATURES_STORED

    s = common.scored(spark, sf)
    return rounded(clean.conform(s, FEATURES_STORED, on_missing="skip"))


@query("fill_zero", with_ctes(*BASE) + "SELECT timestamp, city, " + ", ".join(
    R(f"coalesce({c}, {d(0.0)})", c) for c in RAW_DOUBLES) + " FROM raw")
def q_fill_zero(spark, sf):
    return rounded(clean.fill_zero(common.raw(spark, sf).select(*RAW16)))


_PREP = ["pm2_5", "pm10", "ozone", "temperature_2m", "not_in_data_a", "not_in_data_b"]


@query("prepare_features", with_ctes(*BASE) + "SELECT city, timestamp, " + ", ".join(
    R(f"coalesce({c}, {d(0.0)})", c) if not c.startswith("not_") else f"{d(0.0)} AS {c}" for c in _PREP)
    + " FROM raw")
def q_prepare_features(spark, sf):
    return rounded(clean.prepare_features(common.raw(spark, sf), _PREP, keep=["city", "timestamp"]))


# ------------------------------------------------------------------ I5 .. I9
@query("local_time", with_ctes(*BASE) + f"""
SELECT city, timestamp, {local_sql()} AS timestamp_local, CAST({local_sql()} AS DATE) AS local_date
FROM raw""")
def q_local_time(spark, sf):
    r = common.raw(spark, sf)
    lt = local_time("timestamp")
    return r.select("city", "timestamp", lt.alias("timestamp_local"), F.to_date(lt).alias("local_date"))


_CAL = ["hour", "day_of_week", "day_of_month", "month", "quarter", "is_weekend"]
_CYC = ["hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos"]


@query("calendar_features", with_ctes(*BASE, SCORED, CAL) + "SELECT city, timestamp, " + ", ".join(_CAL) + " FROM cal")
def q_calendar_features(spark, sf):
    s = common.scored(spark, sf)
    cal = calendar_columns("timestamp", cyclic_parts=False)
    return s.select("city", "timestamp", *[cal[c].alias(c) for c in _CAL])


@query("cyclic_features", with_ctes(*BASE, SCORED, CAL) + "SELECT city, timestamp, " + ", ".join(
    R(c) for c in _CYC) + " FROM cal")
def q_cyclic_features(spark, sf):
    s = common.scored(spark, sf)
    cal = calendar_columns("timestamp")
    return rounded(s.select("city", "timestamp", *[cal[c].alias(c) for c in _CYC]))


@query("interaction_features", with_ctes(*BASE) + f"""
SELECT city, timestamp, {R(f'pm2_5 / (pm10 + {d(1e-6)})', 'pm2_5_pm10_ratio')},
       {R('temperature_2m * relative_humidity_2m', 'temperature_humidity_interaction')},
       {R('wind_speed_10m * surface_pressure', 'wind_pressure_interaction')}
FROM raw""")
def q_interaction_features(spark, sf):
    from haze.operators.series import interaction_columns

    r = common.raw(spark, sf)
    return rounded(r.select("city", "timestamp", *[c.alias(n) for n, c in interaction_columns().items()]))

