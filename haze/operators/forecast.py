"""72-hour forecast for every city in one distributed pass.

last row + trend per city (aggregates) -> explode 72 steps (narrow, no
shuffle) -> drifted inputs -> one batch ``transform`` -> daily means.
The per-city inputs are one row per city, so the explode produces
cities x 72 rows regardless of history size.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haze.functions.aqi import display_band
from haze.functions.timefeat import local_time
from haze.operators.series import tail_rows
from haze.schemas import FORECAST_DAYS, FORECAST_HOURS, HISTORY_ROWS, LOCAL_TZ, MODEL_FEATURES, RANDOM_STATE


def forecast_base(features: DataFrame, cols: list[str] | None = None, n: int = HISTORY_ROWS,
                  key="city", ts="timestamp") -> DataFrame:
    """Per key: last row values and (last - first)/rows trend over the last ``n`` rows.

    Both come from one aggregate over the key's last ``n`` rows (the latest
    row is among them), so the feature input is ranked once per key.
    """
    cols = cols or MODEL_FEATURES
    drift = [c for c in cols if c != "hour_sin"]
    tail = tail_rows(features.select(key, ts, *cols), n, key, ts)
    aggs = [F.expr(f"max(`{ts}`)").alias(ts), F.expr("count(1)").alias("n_rows")]
    aggs += [F.expr(f"max_by(`{c}`, `{ts}`)").alias(c) for c in cols]
    aggs += [F.expr(f"(max_by(`{c}`, `{ts}`) - min_by(`{c}`, `{ts}`)) / count(1)").alias(f"{c}_trend") for c in drift]
    return tail.groupBy(key).agg(*aggs)


def forecast_grid(base: DataFrame, horizon: int = FORECAST_HOURS, ts="timestamp") -> DataFrame:
    """One row per (key, step 1..horizon) with the future timestamp."""
    step = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    g = base.select("*", step)
    return (g.withColumn("base_timestamp", F.col(ts))
             .withColumn(ts, F.col(ts) + F.make_dt_interval(hours=F.col("step"))))


def forecast_inputs(grid: DataFrame, cols: list[str] | None = None, noise: float = 0.0,
                    seed: int = RANDOM_STATE, tz: str = LOCAL_TZ, ts="timestamp") -> DataFrame:
    """Drifted model inputs per step; ``hour_sin`` follows the future local hour.

    ``noise`` > 0 draws U(-noise, noise) per value from seeded streams.
    """
    cols = cols or MODEL_FEATURES
    out = {}
    for i, c in enumerate(cols):
        if c == "hour_sin":
            out[c] = F.expr(f"sin({2 * math.pi!r}D * hour(convert_timezone('UTC', '{tz}', `{ts}`)) / 24.0D)")
            continue
        v = f"`{c}` + `{c}_trend` * CAST(step AS DOUBLE)"
        if noise > 0:
            v = f"{v} + (rand({seed + i}) * {2 * noise!r}D - {noise!r}D) * `{c}`"
        # max(0, v) with NULL/NaN -> 0, as Python's max(0, nan) gives 0
        out[c] = F.expr(f"CASE WHEN ({v}) IS NULL OR isnan({v}) THEN 0.0D ELSE greatest(0.0D, {v}) END")
    keep = [c for c in grid.columns if c not in cols and not c.endswith("_trend")]
    return grid.select(*keep, *[v.alias(k) for k, v in out.items()])


def daily_forecast(hourly: DataFrame, as_of: dt.datetime, days: int = FORECAST_DAYS, tz: str = LOCAL_TZ,
                   key="city", ts="timestamp", value="predicted_aqi") -> DataFrame:
    """Mean per local date strictly after ``as_of``'s local date, first ``days`` dates per key."""
    from zoneinfo import ZoneInfo

    aware = as_of if as_of.tzinfo else as_of.replace(tzinfo=dt.timezone.utc)
    today = aware.astimezone(ZoneInfo(tz)).date()
    d = F.to_date(local_time(ts, tz))
    per_day = (hourly.where(d > F.lit(today))
                     .groupBy(key, d.alias("date"))
                     .agg(F.avg(value).alias(value), F.count(F.lit(1)).cast("int").alias("n_hours")))
    w = Window.partitionBy(key).orderBy("date")
    return per_day.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= days).drop("_k")


def forecast_cards(daily: DataFrame, value="predicted_aqi") -> DataFrame:
    """Card text per day: 'EEE, MMM dd' label, rounded value, display band, hazard flag."""
    return daily.select("*",
                        F.date_format("date", "EEE, MMM dd").alias("label"),
                        F.when(F.col(value).isNotNull(), F.format_string("%.0f", F.col(value))).alias("value_text"),
                        display_band(value).alias("band"),
                        (F.col(value) > F.lit(200.0)).alias("hazard"))


def forecast_72h(features: DataFrame, model, as_of: dt.datetime, noise: float = 0.0,
                 cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Hourly forecast and 3-day rollup per city with a fitted Spark ML model."""
    from haze.operators.learn import score

    cols = cols or MODEL_FEATURES
    grid = forecast_grid(forecast_base(features, cols))
    inputs = forecast_inputs(grid, cols, noise=noise)
    hourly = score(inputs, model, cols, keep=["city", "timestamp", "step"])
    hourly = hourly.withColumn("timestamp_local", local_time("timestamp")) \
                   .withColumn("date", F.to_date("timestamp_local"))
    return hourly, daily_forecast(hourly, as_of)
