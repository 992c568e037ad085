"""Projections, filters, guards, the air x weather join and row audits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haze.functions.aqi import aqi_category, overall_aqi
from haze.functions.timefeat import local_time
from haze.schemas import HAZARD_THRESHOLD, KEY, LOCAL_TZ, STALE_HOURS, TRAIN_EXCLUDE


def _ts(value) -> Column:
    """A driver-side instant as a TIMESTAMP_NTZ literal (UTC wall clock)."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if isinstance(value, dt.datetime) and value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    # an ISO string cast to NTZ involves neither the Python process zone nor the session zone
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


# ---------------------------------------------------------------- C1, C8, C9, C14
def with_metadata(df: DataFrame, **defaults) -> DataFrame:
    """Attach constant metadata; an existing column keeps its values, nulls defaulted."""
    cols = {}
    for name, value in defaults.items():
        cols[name] = F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
    return df.withColumns(cols)


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def restore_names(df: DataFrame, canonical: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """Rename lower-cased store columns back to canonical spelling.

    ``aliases`` maps a fallback spelling (``Timestamp``) to the canonical one;
    it is used only when the canonical name is absent.
    """
    lower = {c.lower(): c for c in df.columns}
    renames = {}
    for name in canonical:
        have = lower.get(name.lower())
        if have is not None and have != name and name not in df.columns:
            renames[have] = name
    out = df.withColumnsRenamed(renames) if renames else df
    for alt, name in (aliases or {}).items():
        if name not in out.columns and alt in out.columns:
            out = out.withColumnRenamed(alt, name)
    return out


# ---------------------------------------------------------------- C2 .. C7
def drop_missing(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.na.drop(how="any", subset=subset)


def drop_future(df: DataFrame, as_of, ts: str = "timestamp") -> DataFrame:
    return df.where(F.col(ts) <= _ts(as_of))


def today_bounds(as_of: dt.datetime, tz: str = LOCAL_TZ) -> tuple[dt.datetime, dt.datetime]:
    """(local midnight, current hour) of ``as_of`` as naive UTC instants.

    Computed on the driver so the filter reaching the scan is a plain
    range on the stored column (pushed down), not a predicate on a
    derived local date.
    """
    from zoneinfo import ZoneInfo

    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=dt.timezone.utc)
    local = as_of.astimezone(ZoneInfo(tz))
    start = local.replace(hour=0, minute=0, second=0, microsecond=0).astimezone(dt.timezone.utc)
    hour = as_of.astimezone(dt.timezone.utc).replace(minute=0, second=0, microsecond=0)
    return start.replace(tzinfo=None), hour.replace(tzinfo=None)


def today_window(df: DataFrame, as_of: dt.datetime, tz: str = LOCAL_TZ, ts: str = "timestamp") -> DataFrame:
    start, hour = today_bounds(as_of, tz)
    return df.where((F.col(ts) >= _ts(start)) & (F.col(ts) <= _ts(hour)))


def city_filter(df: DataFrame, city: str) -> DataFrame:
    return df.where(F.col("city") == F.lit(city))


def conform(df: DataFrame, columns: list[str], on_missing: str = "skip", fill=None) -> DataFrame:
    """Select ``columns`` in order.

    on_missing: ``"skip"`` keeps only the available subset (source
    behaviour), ``"fill"`` adds absent ones as ``fill`` (cast to double),
    ``"error"`` raises.
    """
    have = set(df.columns)
    missing = [c for c in columns if c not in have]
    if missing and on_missing == "error":
        raise ValueError(f"missing columns: {missing}")
    if on_missing == "fill":
        return df.select([F.col(c) if c in have else F.lit(fill).cast("double").alias(c) for c in columns])
    return df.select([c for c in columns if c in have])


def missing_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c not in set(df.columns)]


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = missing_columns(df, columns)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def min_history(df: DataFrame, min_rows: int = 24, key: str = "city") -> DataFrame:
    """Keep only keys with at least ``min_rows`` rows (one aggregate + semi join)."""
    ok = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows).select(key)
    return df.join(ok, on=key, how="left_semi")


# ---------------------------------------------------------------- C10 .. C13
def feature_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    ex = set(TRAIN_EXCLUDE if exclude is None else exclude)
    return [c for c in df.columns if c not in ex]


def columns_of_type(df: DataFrame, kind: str = "numeric") -> list[str]:
    numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    if kind == "numeric":
        return [f.name for f in df.schema.fields if isinstance(f.dataType, numeric)]
    if kind == "string":
        return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    raise ValueError(kind)


def fill_zero(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = columns or columns_of_type(df, "numeric")
    return df.na.fill(0, subset=cols)


def prepare_features(df: DataFrame, feature_cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Add absent features as 0, order them, NULL -> 0 (scoring input)."""
    have = set(df.columns)
    feats = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c)
             for c in feature_cols]
    return df.select([F.col(k) for k in (keep or [])] + feats)


# ---------------------------------------------------------------- C15, C16
def hazard_days(daily: DataFrame, threshold: float = HAZARD_THRESHOLD, col: str = "predicted_aqi") -> DataFrame:
    return daily.where(F.col(col) > F.lit(float(threshold)))


def data_age(df: DataFrame, as_of, key: str = "city", ts: str = "timestamp",
             stale_hours: float = STALE_HOURS) -> DataFrame:
    """Per key: last timestamp, its age in hours at ``as_of``, stale flag."""
    last = df.groupBy(key).agg(F.max(ts).alias("last_timestamp"))
    age = F.timestamp_diff("MICROSECOND", F.col("last_timestamp"), _ts(as_of)).cast("double") / F.lit(3.6e9)
    return last.select(key, "last_timestamp", age.alias("age_hours"),
                       (age > F.lit(float(stale_hours))).alias("is_stale"))


# ---------------------------------------------------------------- D1, E12
def join_air_weather(air: DataFrame, weather: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Inner equi join on (city, timestamp).

    Both sides grow with the data, so the strategy is left to the planner
    (sort-merge, or broadcast when AQE measures a small side at runtime);
    AQE skew-join splits a hot city's partitions.
    """
    keys = on or KEY
    return air.join(weather, on=keys, how="inner")


def dedup_first(df: DataFrame, key: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Keep the first row per key under an explicit order (``dropDuplicates`` is order-free).

    Implemented as one ``min_by`` aggregate, so partial aggregation runs map
    side: a group of copies holding a large share of all rows is reduced
    before the shuffle instead of being sorted in one task. ``order`` lists
    columns compared ascending with NULLs last (default: ``ingest_seq`` when
    present, then every other column as a deterministic tie-break).
    """
    keys = key or KEY
    rest = [c for c in df.columns if c not in keys]
    order_cols = list(order or [])
    if not order_cols and "ingest_seq" in df.columns:
        order_cols = ["ingest_seq"]
    order_cols += [c for c in rest if c not in order_cols]
    rank = F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(f"o{i}")
                      for i, c in enumerate(order_cols)])
    first = F.min_by(F.struct(*[F.col(c) for c in rest]), rank).alias("_r")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


# ---------------------------------------------------------------- E11, E13
def with_aqi(df: DataFrame, nan_policy: str = "first") -> DataFrame:
    """AQI + AQI_Category as codegen expressions."""
    aqi = overall_aqi(nan_policy=nan_policy)
    return df.withColumn("AQI", aqi).withColumn("AQI_Category", aqi_category("AQI"))


def quality_audit(raw: DataFrame, as_of=None, key: list[str] | None = None,
                  required: list[str] | None = None, group: str | None = "city") -> DataFrame:
    """One pass of conditional counts: rows in, future, duplicate, missing PM, no AQI.

    Duplicates = rows beyond the first per key. Keys are counted with a
    hash aggregate (partial aggregation map-side), then rolled up per
    ``group``; no per-key sort or window is needed.
    """
    keys = key or KEY
    req = required or ["pm2_5", "pm10"]
    future = (F.col("timestamp") > _ts(as_of)) if as_of is not None else F.lit(False)
    missing = F.lit(False)
    for c in req:
        missing = missing | F.col(c).isNull()
    per_key = (raw.groupBy(*keys)
               .agg(F.count(F.lit(1)).alias("_n"),
                    F.count_if(future).alias("_nf"),
                    F.count_if(missing).alias("_nm"),
                    F.count_if(~missing & overall_aqi().isNull()).alias("_na")))
    gcols = [group] if group else []
    return (per_key.groupBy(*gcols)
            .agg(F.sum("_n").cast("bigint").alias("rows_in"),
                 F.sum("_nf").cast("bigint").alias("future_rows"),
                 F.sum(F.col("_n") - F.lit(1)).cast("bigint").alias("duplicate_rows"),
                 F.sum("_nm").cast("bigint").alias("missing_pm_rows"),
                 F.sum("_na").cast("bigint").alias("no_aqi_rows")))


def date_span(df: DataFrame, tz: str = LOCAL_TZ, key: str = "city", ts: str = "timestamp") -> DataFrame:
    """Distinct local dates per key; more than one raises the multi-date flag."""
    d = F.to_date(local_time(ts, tz))
    return (df.groupBy(key)
              .agg(F.count_distinct(d).alias("n_dates"), F.min(d).alias("first_date"), F.max(d).alias("last_date"))
              .withColumn("multi_date", F.col("n_dates") > 1))


