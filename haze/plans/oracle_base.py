"""SQL building blocks for the DuckDB oracle of the registered queries.

These restate the adapters and column functions in plain ANSI SQL, so the
Spark results can be checked by an independent engine on the same parquet.
"""

from __future__ import annotations

import math

#: Fixed values, stated here again so that the check doesn't share them with what it checks:
#: (low, high, index low, index high) of each band, in the order that the index visits the pollutants.
BANDS = {
    "pm2_5": [("0", "12", "0", "50"), ("12.1", "35.4", "51", "100"), ("35.5", "55.4", "101", "150"),
              ("55.5", "150.4", "151", "200"), ("150.5", "250.4", "201", "300")],
    "pm10": [("0", "54", "0", "50"), ("55", "154", "51", "100"), ("155", "254", "101", "150"),
             ("255", "354", "151", "200"), ("355", "424", "201", "300")],
    "ozone": [("0", "54", "0", "50"), ("55", "70", "51", "100"), ("71", "85", "101", "150"), ("86", "105", "151", "200")],
    "nitrogen_dioxide": [("0", "53", "0", "50"), ("54", "100", "51", "100"), ("101", "360", "101", "150"), ("361", "649", "151", "200")],
    "sulphur_dioxide": [("0", "35", "0", "50"), ("36", "75", "51", "100"), ("76", "185", "101", "150"), ("186", "304", "151", "200")],
    "carbon_monoxide": [("0", "4.4", "0", "50"), ("4.5", "9.4", "51", "100"), ("9.5", "12.4", "101", "150"), ("12.5", "15.4", "151", "200")],
}
CATEGORIES = [(0, 50, "Good"), (51, 100, "Moderate"), (101, 150, "Unhealthy for Sensitive Groups"), (151, 200, "Unhealthy"),
              (201, 300, "Very Unhealthy")]
SHOWN = [(50, "Good"), (100, "Moderate"), (150, "Unhealthy for Sensitive Groups"), (200, "Unhealthy"), (300, "Very Unhealthy")]
ELSE = "Hazardous"
ZONE = "Asia/Karachi"


def number(x: str) -> str:
    return f"CAST('{x}' AS DOUBLE)"


def d(x: float) -> str:
    """Exact DOUBLE literal (DuckDB reads bare decimals as DECIMAL)."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def mean_of(kind: str) -> str:
    return (f"CAST(SUM(v) FILTER (WHERE event_type = '{kind}') AS DOUBLE) / "
            f"NULLIF(COUNT(*) FILTER (WHERE event_type = '{kind}'), 0)")


def count_of(kind: str) -> str:
    return f"COUNT(*) FILTER (WHERE event_type = '{kind}')"


EV = """ev AS (
  SELECT 's' || CAST(user_id % 3 AS VARCHAR) AS city, user_id % 3 AS k,
         date_trunc('hour', ts) AS timestamp, event_type,
         CAST(value AS DECIMAL(18,2)) AS v
  FROM events)"""

AIR = f"""air AS (
  SELECT timestamp, city,
         {d(33.5)} + CAST(k AS DOUBLE) * {d(0.25)} AS latitude,
         {d(73.0)} + CAST(k AS DOUBLE) * {d(0.25)} AS longitude,
         m_view AS pm10, m_click AS pm2_5,
         m_click / {d(20.0)} AS carbon_monoxide,
         m_view * {d(0.75)} AS nitrogen_dioxide,
         m_error * {d(0.5)} AS sulphur_dioxide,
         m_error / {d(4.0)} AS ozone
  FROM (SELECT city, k, timestamp,
               {mean_of('click')} AS m_click, {mean_of('view')} AS m_view, {mean_of('error')} AS m_error
        FROM ev WHERE event_type IN ('click', 'view', 'error')
        GROUP BY city, k, timestamp))"""

WEATHER = f"""weather AS (
  SELECT timestamp, city,
         m_purchase / {d(10.0)} AS temperature_2m,
         m_purchase / {d(5.0)} AS relative_humidity_2m,
         {d(1000.0)} + m_signup / {d(10.0)} AS surface_pressure,
         m_signup / {d(20.0)} AS wind_speed_10m,
         CAST(n_signup AS DOUBLE) * {d(45.0)} AS wind_direction_10m,
         CAST(n_purchase AS DOUBLE) / {d(4.0)} AS precipitation
  FROM (SELECT city, timestamp,
               {mean_of('purchase')} AS m_purchase, {mean_of('signup')} AS m_signup,
               {count_of('purchase')} AS n_purchase, {count_of('signup')} AS n_signup
        FROM ev WHERE event_type IN ('purchase', 'signup')
        GROUP BY city, timestamp))"""

RAW = """raw AS (
  SELECT a.timestamp, a.city, a.latitude, a.longitude,
         a.pm10, a.pm2_5, a.carbon_monoxide, a.nitrogen_dioxide, a.sulphur_dioxide, a.ozone,
         w.temperature_2m, w.relative_humidity_2m, w.surface_pressure, w.wind_speed_10m,
         w.wind_direction_10m, w.precipitation
  FROM air a JOIN weather w ON a.city = w.city AND a.timestamp = w.timestamp)"""


def subindex_sql(col: str, pollutant: str) -> str:
    parts = []
    for low, high, first, last in BANDS[pollutant]:
        slope = f"(({number(last)} - {number(first)}) / ({number(high)} - {number(low)}))"
        parts.append(f"WHEN {col} >= {number(low)} AND {col} <= {number(high)} "
                     f"THEN {slope} * ({col} - {number(low)}) + {number(first)}")
    return "(CASE " + " ".join(parts) + " ELSE NULL END)"


def overall_sql(prefix: str = "", without: str | None = None) -> str:
    order = [p for p in BANDS if p != without]
    subs = [subindex_sql(prefix + p, p) for p in order]
    first = "CASE " + " ".join(f"WHEN {prefix}{p} IS NOT NULL THEN {s}" for p, s in zip(order, subs)) + " ELSE NULL END"
    return f"(CASE WHEN ({first}) IS NULL THEN NULL ELSE greatest({', '.join(subs)}) END)"


def category_sql(col: str) -> str:
    parts = [f"WHEN {col} >= {d(lo)} AND {col} <= {d(hi)} THEN '{name}'" for lo, hi, name in CATEGORIES]
    return "(CASE " + " ".join(parts) + f" ELSE '{ELSE}' END)"


def band_sql(col: str) -> str:
    parts = [f"WHEN {col} <= {d(up)} THEN '{name}'" for up, name in SHOWN]
    return "(CASE " + " ".join(parts) + f" ELSE '{ELSE}' END)"


def local_sql(col: str = "timestamp") -> str:
    return f"(({col} AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}')"


SCORED = f"""scored AS (
  SELECT *, {category_sql('AQI')} AS AQI_Category
  FROM (SELECT *, {overall_sql()} AS AQI FROM raw WHERE pm2_5 IS NOT NULL AND pm10 IS NOT NULL)
  WHERE AQI IS NOT NULL)"""


def two_pi_over(col: str, period: int) -> str:
    return f"{d(2 * math.pi)} * CAST({col} AS DOUBLE) / {d(float(period))}"


CAL = f"""cal AS (
  SELECT *,
         sin({two_pi_over('hour', 24)}) AS hour_sin, cos({two_pi_over('hour', 24)}) AS hour_cos,
         sin({two_pi_over('day_of_week', 7)}) AS day_of_week_sin, cos({two_pi_over('day_of_week', 7)}) AS day_of_week_cos,
         sin({two_pi_over('month', 12)}) AS month_sin, cos({two_pi_over('month', 12)}) AS month_cos
  FROM (SELECT *, CAST(hour(lt) AS INTEGER) AS hour, CAST(isodow(lt) - 1 AS INTEGER) AS day_of_week,
               CAST(day(lt) AS INTEGER) AS day_of_month, CAST(month(lt) AS INTEGER) AS month,
               CAST(quarter(lt) AS INTEGER) AS quarter,
               CAST(CASE WHEN isodow(lt) - 1 >= 5 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend
        FROM (SELECT *, {local_sql()} AS lt FROM scored)))"""

W = "OVER (PARTITION BY city ORDER BY timestamp"


def derived_select() -> str:
    cols = []
    for m in ["pm2_5", "pm10", "ozone"]:
        frame = f"{W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"
        cols += [f"avg({m}) {frame} AS {m}_rolling_mean_24h",
                 f"stddev_samp({m}) {frame} AS {m}_rolling_std_24h",
                 f"max({m}) {frame} AS {m}_rolling_max_24h"]
    cols += [f"temperature_2m - lag(temperature_2m, 1) {W}) AS temperature_change",
             f"wind_speed_10m - lag(wind_speed_10m, 1) {W}) AS wind_speed_change",
             f"pm2_5 / (pm10 + {d(1e-6)}) AS pm2_5_pm10_ratio",
             "temperature_2m * relative_humidity_2m AS temperature_humidity_interaction",
             "wind_speed_10m * surface_pressure AS wind_pressure_interaction"]
    for m in ["pm2_5", "pm10", "temperature_2m"]:
        cols += [f"lag({m}, 1) {W}) AS {m}_lag_1h", f"lag({m}, 24) {W}) AS {m}_lag_24h"]
    return ",\n         ".join(cols)


DERIVED = f"""derived AS (
  SELECT *,
         {derived_select()}
  FROM cal)"""


def fill_sql(col: str) -> str:
    return (f"coalesce({col}, "
            f"first_value({col} IGNORE NULLS) {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), "
            f"last_value({col} IGNORE NULLS) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))")


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = (EV, AIR, WEATHER, RAW)


ORDER_RAW = f"""raw AS (
  SELECT CAST(o_orderdate AS TIMESTAMP) AS timestamp, 'n' || CAST(c_nationkey AS VARCHAR) AS city,
         {d(30.0)} + CAST(c_nationkey AS DOUBLE) * {d(0.25)} AS latitude,
         {d(70.0)} + CAST(c_nationkey AS DOUBLE) * {d(0.25)} AS longitude,
         sp / n / {d(200.0)} AS pm10, sq / n AS pm2_5, sd / n * {d(100.0)} AS carbon_monoxide,
         st / n * {d(1000.0)} AS nitrogen_dioxide, CAST(n AS DOUBLE) / {d(10.0)} AS sulphur_dioxide,
         sq / n * {d(2.0)} AS ozone, sd / n * {d(300.0)} AS temperature_2m,
         st / n * {d(900.0)} AS relative_humidity_2m, {d(1000.0)} + sq / n AS surface_pressure,
         sp / n / {d(5000.0)} AS wind_speed_10m, CAST(n AS DOUBLE) * {d(7.0)} AS wind_direction_10m,
         sd / n AS precipitation
  FROM (SELECT c_nationkey, o_orderdate,
               CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sq,
               CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sp,
               CAST(SUM(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS sd,
               CAST(SUM(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS st, COUNT(*) AS n
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        GROUP BY c_nationkey, o_orderdate))"""


USER_RAW = f"""raw AS (
  SELECT timestamp, 'u' || CAST(user_id AS VARCHAR) AS city,
         {d(20.0)} + CAST(user_id % 64 AS DOUBLE) * {d(0.25)} AS latitude,
         {d(60.0)} + CAST(user_id % 128 AS DOUBLE) * {d(0.25)} AS longitude,
         hi AS pm10, mean AS pm2_5, lo / {d(20.0)} AS carbon_monoxide, mean * {d(0.75)} AS nitrogen_dioxide,
         hi * {d(0.5)} AS sulphur_dioxide, hi / {d(4.0)} AS ozone, lo / {d(10.0)} AS temperature_2m,
         hi / {d(5.0)} AS relative_humidity_2m, {d(1000.0)} + mean / {d(10.0)} AS surface_pressure,
         mean / {d(20.0)} AS wind_speed_10m, n * {d(45.0)} AS wind_direction_10m, n / {d(4.0)} AS precipitation
  FROM (SELECT user_id, date_trunc('day', ts) AS timestamp,
               CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS mean,
               CAST(MAX(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS hi, CAST(MIN(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS lo,
               CAST(COUNT(*) AS DOUBLE) AS n
        FROM events GROUP BY 1, 2))"""
