"""Composed jobs: the hourly ingest, the training run, the forecast refresh,
the profile report and the influence report.

Each job is a lazy DataFrame plan up to its sink; the only values that reach
the driver are scalars (time bounds, metrics rows, registry rows).
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haze.operators import boost, clean, explain, forecast, learn, profile, series, treeshap
from haze.schemas import AIR_MEASURES, WEATHER_MEASURES
from haze.session import scratch_path
from haze.sources import files, fs, payload
from haze.sources.store import FeatureTable
from haze.streaming.jobs import with_history


# ------------------------------------------------------------------ P1 hourly ingest
def landed_today(spark: SparkSession, air_landing: str, weather_landing: str, as_of: dt.datetime,
                 whole_file: bool = True, source_tz: str = "UTC") -> DataFrame:
    """Landed payloads of both sides -> today's hours up to ``as_of``, joined, one row per key.

    Keep-first per key on each side before the join: the same rows as
    join-then-dedup (the first pair is the first air copy with the first
    weather copy), but a duplicated key can't fan out n x m, and the dedup is a
    map-side-combined aggregate.
    """
    def side(path, measures):
        rows = payload.read_payloads(spark, path, measures, whole_file, True, source_tz)
        return clean.dedup_first(clean.today_window(rows, as_of), ["city", "timestamp"]).drop("ingest_seq")

    raw = clean.join_air_weather(side(air_landing, AIR_MEASURES),
                                 side(weather_landing, WEATHER_MEASURES).drop("latitude", "longitude"))
    return clean.drop_missing(raw, ["pm2_5", "pm10"])


def _first_hours(raw: FeatureTable) -> str:
    return f"{raw.path}/_first_hours"


def note_cities(raw: FeatureTable, rows: DataFrame) -> None:
    """Keeps the first stored hour of every city beside the raw table: a row for a new city, or one whose first hour is older now."""
    spark, path = raw.spark, _first_hours(raw)
    first = rows.groupBy("city").agg(F.min("timestamp").alias("first"))
    if fs.has_rows(spark, path):
        known = spark.read.parquet(path).groupBy("city").agg(F.min("first").alias("known"))
        first = first.join(known, "city", "left").where(F.col("known").isNull() | (F.col("first") < F.col("known"))).drop("known")
    first.write.mode("append").parquet(path)


def stored_history(raw: FeatureTable, before: dt.datetime, cities: DataFrame, n: int, days: int = 3) -> DataFrame:
    """Scored raw rows before ``before`` that hold the last ``n`` of every city of ``cities`` (column ``city``).

    Reads the last ``days`` dates, a bound on the table's partitions, and twice as many again
    until each city has ``n`` rows there or no older one: by its first stored hour
    (``note_cities``), so that a new city doesn't read the table back to its start.
    """
    oldest = raw.first_date()
    path = _first_hours(raw)
    own = cities.select("city").distinct()
    if fs.has_rows(raw.spark, path):
        own = own.join(raw.spark.read.parquet(path).groupBy("city").agg(F.min("first").alias("first")), "city", "left")
    else:
        own = own.withColumn("first", F.lit(None).cast("timestamp_ntz"))
    while True:
        start = before - dt.timedelta(days=days)
        rows = clean.drop_missing(clean.with_aqi(raw.read(start, before - dt.timedelta(microseconds=1))), ["AQI"])
        if oldest is None or start.date() <= oldest:
            return rows
        counts = rows.groupBy("city").agg(F.count(F.lit(1)).alias("n"))
        older = F.col("first").isNull() | (F.col("first") < F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz"))
        if not own.where(older).join(counts, "city", "left").where(F.coalesce("n", F.lit(0)) < n).take(1):
            return rows
        days *= 2


def hourly_ingest(spark: SparkSession, air_landing: str, weather_landing: str, raw_sink: str,
                  table: FeatureTable, as_of: dt.datetime, history: DataFrame | None = None,
                  history_rows: int = 24, whole_file: bool = True, source_tz: str = "UTC") -> dict:
    """Landed payloads -> today's rows -> keyed raw sink -> AQI -> features -> keyed append, and replaced rows.

    The raw sink keeps each key once, however often an hour is landed. Only
    hours that it didn't have yet are worked on (``fresh``), with the stored rows of their cities from the first of
    them on, preceded by the last ``history_rows`` valid rows of each city (from the raw sink, or ``history``
    where a caller has scored rows of its own). A fresh hour changes its own row and the next ``history_rows`` of its
    city: rows of these that earlier runs have stored are replaced, date by date, so that the table
    equals a full recomputation over all stored rows without fill in whatever order hours land.
    A run reads from its first fresh hour on, a few dates unless an old hour is landed.
    """
    raw = files.raw_table(spark, raw_sink)
    staged_path, fresh_path, changed_path = (scratch_path(spark, n) for n in ("ingest", "fresh", "changed"))
    landed = landed_today(spark, air_landing, weather_landing, as_of, whole_file, source_tz)
    landed.write.parquet(staged_path)
    batch = spark.read.schema(landed.schema).parquet(staged_path)
    first, last, rows, cities = batch.agg(F.min("timestamp"), F.max("timestamp"), F.count(F.lit(1)),
                                          F.approx_count_distinct("city")).first()
    summary = {"first": first, "last": last, "rows": rows, "cities": cities, "raw_written": 0, "written": 0, "replaced": 0}
    if first is not None:
        raw.new_rows(batch).write.parquet(fresh_path)
        fresh = spark.read.schema(batch.schema).parquet(fresh_path)
        since = fresh.agg(F.min("timestamp")).first()[0]
        if since is not None:
            summary["raw_written"] = raw.append(fresh)
            note_cities(raw, fresh)
            before = history if history is not None else stored_history(raw, since, fresh, history_rows)
            changed_rows(raw.read(since), before, fresh, history_rows).write.parquet(changed_path)
            changed = spark.read.parquet(changed_path)
            summary["written"] = table.append(changed.where("_fresh").drop("_fresh"))
            summary["replaced"] = table.replace(changed.where("NOT _fresh").drop("_fresh"))
    for path in (staged_path, fresh_path, changed_path):
        fs.delete(spark, path)
    return summary


def changed_rows(stored: DataFrame, before: DataFrame, fresh: DataFrame, n: int) -> DataFrame:
    """Features of the rows that ``fresh`` hours change, with ``_fresh``: those hours and the next ``n`` valid rows of their
    cities. ``stored``: raw rows from the first fresh hour on; ``before``: scored ones before it."""
    own = fresh.select("city").distinct()
    scored = clean.drop_missing(clean.with_aqi(stored), ["AQI"]).join(own, "city", "left_semi")
    keys = fresh.select("city", "timestamp").distinct().withColumn("_new", F.lit(True))
    feats = series.full_features(with_history(scored, before.join(own, "city", "left_semi"), n), fill="none").where(~F.col("_hist"))
    marked = feats.join(keys, ["city", "timestamp"], "left").withColumn("_fresh", F.coalesce("_new", F.lit(False)))
    reach = Window.partitionBy("city").orderBy("timestamp").rowsBetween(-n, Window.currentRow)
    return marked.withColumn("_near", F.max("_fresh").over(reach)).where("_near").drop("_hist", "_new", "_near")


def backfill_features(spark: SparkSession, raw: DataFrame, table: FeatureTable, split_rows: int | None = None) -> int:
    """Historical backfill: RAW history -> AQI -> features -> keyed append. Returns the number of rows written.

    ``split_rows`` cuts every city's series into buckets of so many rows, for cities with a large
    share of all rows; the rows are the same either way."""
    scored = clean.drop_missing(clean.with_aqi(clean.drop_missing(raw, ["pm2_5", "pm10"])), ["AQI"])
    feats = (series.full_features(scored, fill="all") if split_rows is None
             else series.bucketed_features(scored, bucket_rows=split_rows, fill="all"))
    return table.append(feats)


# ------------------------------------------------------------------ P2 training
def training_run(spark: SparkSession, table: FeatureTable, model_dir: str, registry_path: str,
                 sample_frac: float | None = None, augment_std: float = 0.0, seed: int = 42,
                 features: list[str] | None = None, metrics_path: str | None = None, best_first: bool = True) -> DataFrame:
    """Scan -> sample -> augment -> temporal split -> fit three models -> metrics -> register all + best.

    The boosted models are those of ``boost``, or with ``best_first=False`` Spark's level-wise trees, which know no flat rounds.

    Every model is written once, to ``<name>/v<version>``, before its registry row; the metrics of each run are
    appended to ``metrics_path`` (by default ``metrics`` beside the models)."""
    df = table.training_set()
    if sample_frac and 0 < sample_frac < 1:
        df = learn.hash_sample(df, sample_frac, learn.text_hash(learn.key_text(["city", "timestamp"]), seed))
    numeric = set(clean.columns_of_type(df, "numeric"))
    feats = features or [c for c in clean.feature_columns(df) if c in numeric]
    if augment_std > 0:
        df = learn.augment(df, augment_std, feats, seed)
    idx = series.time_split(df, ["timestamp", "city"], n_splits=3)
    train = idx.where(F.col("split") == "train").persist()
    test = idx.where(F.col("split") == "test").persist()
    candidates = [("aqi_random_forest", learn.forest_regressor(seed)),
                  ("aqi_lightgbm", boost.leafwise() if best_first else learn.gbt_regressor("shallow", seed)),
                  ("aqi_xgboost", boost.depthwise() if best_first else learn.gbt_regressor("deep", seed))]
    rows = []
    for name, est in candidates:
        model, m = learn.fit_and_evaluate(train, test, feats, est, name)
        version = learn.next_version(spark, registry_path, name)
        path = f"{model_dir.rstrip('/')}/{name}/v{version}"
        model.write().save(path)
        r = m.first()
        metrics = {"rmse": r.rmse, "mae": r.mae, "r2": r.r2}
        learn.register_model(spark, registry_path, name, path, metrics, feats, version=version)
        rows.append((name, version, path, r.rmse, r.mae, r.r2, r.n))
    train.unpersist()
    test.unpersist()
    table_df = spark.createDataFrame(rows, "model string, version int, path string, rmse double, mae double, r2 double, n bigint")
    (table_df.withColumn("created_at", F.lit(dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz"))
     .write.mode("append").parquet(metrics_path or f"{model_dir.rstrip('/')}/metrics"))
    best = learn.best_model(table_df, order=[n for n, _ in candidates]).first()
    learn.register_model(spark, registry_path, f"aqi_best_{best.model.replace('aqi_', '')}", best.path,
                         {"rmse": best.rmse, "mae": best.mae, "r2": best.r2}, feats)
    return table_df


def load_model(path: str):
    """Load a saved model by the class that its metadata names; a folder that can't be read is an error."""
    from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressionModel

    known = {c.__name__: c for c in (DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressionModel, boost.BoostedTrees)}
    named = json.loads(SparkSession.active().read.text(f"{path}/metadata").first()[0])["class"].rsplit(".", 1)[-1]
    if named not in known:
        raise ValueError(f"{path} holds a {named}")
    return known[named].load(path)


def best_registered(spark: SparkSession, registry_path: str, names: list[str] | None = None):
    """Latest version per name, then argmin rmse (NULL last, ties by name order)."""
    reg = spark.read.parquet(registry_path)
    if names:
        reg = reg.where(F.col("name").isin(*names))
    latest = learn.latest_versions(reg).withColumn("rmse", F.col("metrics")["rmse"]).withColumnRenamed("name", "model")
    best = learn.best_model(latest, order=names).first()
    return best, load_model(best.path)


# ------------------------------------------------------------------ P3 forecast refresh
def forecast_refresh(spark: SparkSession, table: FeatureTable, registry_path: str, as_of: dt.datetime,
                     min_rows: int = 24, names: list[str] | None = None):
    """Features -> guard -> best model -> 72 h forecast -> 3 daily means -> hazard days + status."""
    names = names or ["aqi_lightgbm", "aqi_xgboost", "aqi_random_forest"]
    feats = clean.min_history(table.read(), min_rows)
    best, model = best_registered(spark, registry_path, names)
    hourly, daily = forecast.forecast_72h(feats, model, as_of, cols=list(best.feature_columns))
    return {"hourly": hourly, "daily": forecast.forecast_cards(daily), "hazards": clean.hazard_days(daily),
            "status": clean.data_age(feats, as_of), "model": best.model}


# ------------------------------------------------------------------ reports
def profile_report(raw: DataFrame, cols: list[str] | None = None) -> dict[str, DataFrame]:
    cols = cols or ["pm10", "pm2_5", "carbon_monoxide", "temperature_2m", "wind_speed_10m"]
    numeric = clean.columns_of_type(raw, "numeric")
    return {
        "null_counts": profile.null_counts(raw),
        "describe": profile.describe(raw, numeric),
        "categories": {c: profile.category_counts(raw, c) for c in clean.columns_of_type(raw, "string")},
        "histogram": profile.histogram(raw, cols),
        "kde": profile.kde(raw, cols),
        "box": profile.box_stats(raw, cols),
        "moving_average": raw.select("city", "timestamp", "temperature_2m", "pm2_5",
                                     series.moving_average("temperature_2m").alias("temperature_2m_ma24"),
                                     series.moving_average("pm2_5").alias("pm2_5_ma24")),
        "correlation": profile.correlation_matrix(raw, numeric),
    }


def influence_report(features: DataFrame, model, feature_cols: list[str], out_csv: str | None = None,
                     method: str = "shapley", n: int | None = 100, seed: int = 42) -> DataFrame:
    """Mean |contribution| per feature on a fixed-size hashed sample (``n=None``: all rows); optional CSV sink.

    ``method``: ``shapley`` (sampled orders, any model), ``exact`` (tree models) or ``surrogate``."""
    sample = features.withColumn("row_id", learn.row_key(["city", "timestamp"], seed))
    if n is not None:
        sample = learn.fixed_sample(sample, n, F.col("row_id"), ["city", "timestamp"])
    if method == "shapley":
        contrib = explain.shapley_values(sample, model, feature_cols, seed=seed)
    elif method == "exact":
        contrib = treeshap.tree_shapley(sample, model, feature_cols, ["row_id"])
    else:
        contrib = explain.local_surrogate(sample, model, feature_cols, seed=seed)
    imp = explain.mean_abs_importance(contrib)
    if out_csv:
        imp.coalesce(1).write.mode("overwrite").option("header", True).csv(out_csv)
    return imp


__all__ = ["hourly_ingest", "landed_today", "stored_history", "training_run", "load_model", "best_registered", "forecast_refresh",
           "profile_report", "influence_report", "backfill_features"]
