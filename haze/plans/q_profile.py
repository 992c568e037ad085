"""Registered queries: profiling reports (E2-E6, E14-E16)."""

from __future__ import annotations

import math

from haze.operators import profile
from haze.plans import common
from haze.plans.catalog import R, query, rounded
from haze.plans.oracle_base import BASE, SCORED, d, with_ctes

PROFILE_COLS = ["pm10", "pm2_5", "carbon_monoxide", "temperature_2m", "wind_speed_10m"]
RAW_COLS = ["timestamp", "city", "latitude", "longitude", "pm10", "pm2_5", "carbon_monoxide", "nitrogen_dioxide",
            "sulphur_dioxide", "ozone", "temperature_2m", "relative_humidity_2m", "surface_pressure",
            "wind_speed_10m", "wind_direction_10m", "precipitation"]
NUMERIC = RAW_COLS[2:]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


@query("category_counts", with_ctes(*BASE, SCORED) + """
SELECT AQI_Category, COUNT(*) AS count FROM scored WHERE AQI_Category IS NOT NULL GROUP BY AQI_Category""")
def q_category_counts(spark, sf):
    return profile.category_counts(common.scored(spark, sf), "AQI_Category")


@query("aqi_range", with_ctes(*BASE, SCORED) + f"""
SELECT city, {R('min(AQI)', 'min_AQI')}, {R('max(AQI)', 'max_AQI')} FROM scored GROUP BY city""")
def q_aqi_range(spark, sf):
    return rounded(profile.value_range(common.scored(spark, sf), "AQI", ["city"]))


@query("null_counts", with_ctes(*BASE) + _union(
    [f"SELECT '{c}' AS \"column\", COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count FROM raw" for c in RAW_COLS]))
def q_null_counts(spark, sf):
    return profile.null_counts(common.raw(spark, sf).select(*RAW_COLS))


@query("describe", with_ctes(*BASE) + _union([f"""
SELECT '{c}' AS "column", COUNT({c}) AS count, {R(f'avg({c})', 'mean')}, {R(f'stddev_samp({c})', 'std')},
       {R(f'min({c})', 'min')}, {R(f'quantile_cont({c}, 0.25)', 'p25')}, {R(f'quantile_cont({c}, 0.5)', 'p50')},
       {R(f'quantile_cont({c}, 0.75)', 'p75')}, {R(f'max({c})', 'max')} FROM raw""" for c in PROFILE_COLS]))
def q_describe(spark, sf):
    return rounded(profile.describe(common.raw(spark, sf), PROFILE_COLS))


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(NUMERIC):
        for j, b in enumerate(NUMERIC):
            v = d(1.0) if i == j else f"corr({NUMERIC[min(i, j)]}, {NUMERIC[max(i, j)]})"
            src = "" if i == j else " FROM raw"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R(v, 'corr')}{src}")
    return with_ctes(*BASE) + _union(parts)


@query("correlation_matrix", _corr_sql())
def q_correlation_matrix(spark, sf):
    return rounded(profile.correlation_matrix(common.raw(spark, sf), NUMERIC))


def _long_cte(cols) -> str:
    return "lng AS (" + _union([f"SELECT '{c}' AS col, {c} AS value FROM raw WHERE {c} IS NOT NULL"
                                 for c in cols]) + ")"


_BOUNDS = "bnd AS (SELECT col, min(value) AS lo, max(value) AS hi FROM lng GROUP BY col)"


@query("histogram", with_ctes(*BASE, _long_cte(PROFILE_COLS), _BOUNDS) + f"""
SELECT col AS "column", bin, {R(f'lo + CAST(bin AS DOUBLE) * (hi - lo) / {d(10.0)}', 'bin_lo')},
       {R(f'lo + CAST(bin + 1 AS DOUBLE) * (hi - lo) / {d(10.0)}', 'bin_hi')}, COUNT(*) AS count
FROM (SELECT l.col, b.lo, b.hi,
             CAST(least(CASE WHEN b.hi = b.lo THEN 0 ELSE floor((l.value - b.lo) / ((b.hi - b.lo) / {d(10.0)})) END,
                        9) AS INTEGER) AS bin
      FROM lng l JOIN bnd b ON l.col = b.col)
GROUP BY col, bin, lo, hi""")
def q_histogram(spark, sf):
    return rounded(profile.histogram(common.raw(spark, sf), PROFILE_COLS, bins=10))


_KDE_STATS = ("st AS (SELECT col, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd, COUNT(value) AS n "
              "FROM lng GROUP BY col)")


@query("kde", with_ctes(*BASE, _long_cte(PROFILE_COLS), _KDE_STATS) + f""",
binned AS (
  SELECT col, lo, hi, sd, n, bin, COUNT(*) AS w FROM (
    SELECT l.col, s.lo, s.hi, s.sd, s.n,
           CAST(least(CASE WHEN (s.hi - s.lo) / {d(512.0)} = 0 THEN 0
                           ELSE floor((l.value - s.lo) / ((s.hi - s.lo) / {d(512.0)})) END, 511) AS INTEGER) AS bin
    FROM lng l JOIN st s ON l.col = s.col)
  GROUP BY col, lo, hi, sd, n, bin),
pts AS (
  SELECT *, lo + (CAST(bin AS DOUBLE) + {d(0.5)}) * ((hi - lo) / {d(512.0)}) AS c,
         {d(1.06)} * sd * pow(CAST(n AS DOUBLE), {d(-0.2)}) AS bw,
         lo + CAST(g AS DOUBLE) * (hi - lo) / {d(49.0)} AS x
  FROM binned, range(0, 50) t(g))
SELECT col AS "column", CAST(g AS INTEGER) AS point, {R('min(x)', 'x')},
       {R(f'sum(CAST(w AS DOUBLE) * exp({d(-0.5)} * ((x - c) / bw) * ((x - c) / bw)) / (CAST(n AS DOUBLE) * bw * {d(math.sqrt(2 * math.pi))}))', 'density')}
FROM pts WHERE bw > 0 GROUP BY col, g""".replace("\n,\nbinned", ",\nbinned"))
def q_kde(spark, sf):
    return rounded(profile.kde(common.raw(spark, sf), PROFILE_COLS, grid=50, bins=512))


@query("box_stats", with_ctes(*BASE, _long_cte(PROFILE_COLS)) + f""",
q AS (SELECT col, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM lng GROUP BY col)
SELECT l.col AS "column", {R('q.q1', 'q1')}, {R('q.median', 'median')}, {R('q.q3', 'q3')},
       {R(f'min(CASE WHEN value >= q1 - {d(1.5)} * (q3 - q1) AND value <= q3 + {d(1.5)} * (q3 - q1) THEN value END)', 'whisker_lo')},
       {R(f'max(CASE WHEN value >= q1 - {d(1.5)} * (q3 - q1) AND value <= q3 + {d(1.5)} * (q3 - q1) THEN value END)', 'whisker_hi')},
       COUNT(*) FILTER (WHERE NOT (value >= q1 - {d(1.5)} * (q3 - q1) AND value <= q3 + {d(1.5)} * (q3 - q1))) AS n_outliers,
       COUNT(*) AS n
FROM lng l JOIN q ON l.col = q.col GROUP BY l.col, q.q1, q.median, q.q3""")
def q_box_stats(spark, sf):
    return rounded(profile.box_stats(common.raw(spark, sf), PROFILE_COLS))


_SKEWED = "CASE WHEN event_id % 10 <> 0 THEN CAST('1.0' AS DOUBLE) WHEN event_id % 70 = 0 THEN NULL ELSE value END"


@query("describe_skewed", f"""
SELECT 'value' AS "column", COUNT(v) AS count, {R('avg(v)', 'mean')}, {R('stddev_samp(v)', 'std')}, {R('min(v)', 'min')},
       {R('quantile_cont(v, 0.25)', 'p25')}, {R('quantile_cont(v, 0.5)', 'p50')}, {R('quantile_cont(v, 0.75)', 'p75')}, {R('max(v)', 'max')}
FROM (SELECT {_SKEWED} AS v FROM events)""")
def q_describe_skewed(spark, sf):
    """A column that is one value in nine rows of ten, with NaN among the others: NaN counts as missing."""
    from haze.sources.driver_tables import table

    v = "CASE WHEN event_id % 10 <> 0 THEN 1.0D WHEN event_id % 70 = 0 THEN double('NaN') ELSE value END AS value"
    return rounded(profile.describe(table(spark, sf, "events").selectExpr(v), ["value"]))


@query("band_legend", with_ctes(*BASE, SCORED) + f"""
SELECT ordinal, CAST(above AS DOUBLE) AS above, CAST(up_to AS DOUBLE) AS up_to, band, COUNT(AQI) AS rows
FROM (VALUES (1, NULL, 50, 'Good'), (2, 50, 100, 'Moderate'), (3, 100, 150, 'Unhealthy for Sensitive Groups'),
             (4, 150, 200, 'Unhealthy'), (5, 200, 300, 'Very Unhealthy'), (6, 300, NULL, 'Hazardous')) AS t(ordinal, above, up_to, band)
LEFT JOIN scored ON (above IS NULL OR AQI > above) AND (up_to IS NULL OR AQI <= up_to) GROUP BY ALL""")
def q_band_legend(spark, sf):
    """The legend with the number of rows in each display band."""
    from pyspark.sql import functions as F

    from haze.functions.aqi import display_band, legend

    n = common.scored(spark, sf).groupBy(display_band("AQI").alias("band")).agg(F.count(F.lit(1)).alias("rows"))
    return legend(spark).join(n, "band", "left").select("ordinal", "above", "up_to", "band", F.coalesce("rows", F.lit(0)).alias("rows"))
