"""Learning operators: samples, augmentation, metrics, model choice, the
model registry, MLlib trainers and batch scoring.

Only metrics and registry rows return to the driver; training and scoring
run on executors through Spark ML.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.schemas import RANDOM_STATE

# ---------------------------------------------------------------- G4, G5
HASH_MOD = 4294967296   # 2**32


def key_text(cols: list[str]) -> Column:
    """The key columns as one text; timestamps in ISO form, so that other engines can make the same."""
    return F.concat_ws("|", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss") if c == "timestamp" else F.col(c).cast("string") for c in cols])


def text_hash(key: Column, seed: int | str = RANDOM_STATE) -> Column:
    """Hash in [0, 2**32) of a text: the first 8 hexadecimal digits of the MD5 of seed and text, as in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("bigint")


def row_key(cols: list[str], seed: int = RANDOM_STATE) -> Column:
    """60-bit id of a row from its key columns, whatever their number of values."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key_text(cols))), 1, 15), 16, 10).cast("bigint")


def hash_sample(df: DataFrame, fraction: float, h: Column) -> DataFrame:
    """Reproducible Bernoulli sample: keep rows whose hash falls below ``fraction``.

    Independent of partitioning and task retries (unlike ``sample``).
    """
    return df.where(h < F.lit(int(fraction * HASH_MOD)))


def fixed_sample(df: DataFrame, n: int, h: Column, tiebreak: list[str] | None = None) -> DataFrame:
    """Exactly ``min(n, rows)`` rows: the ``n`` smallest hashes (TakeOrderedAndProject, no full sort)."""
    return df.orderBy(h, *[F.col(c) for c in (tiebreak or [])]).limit(n)


# ---------------------------------------------------------------- I10
def normal_noise(key: Column, seed: int | str) -> Column:
    """Standard normal noise from a row's key (Box-Muller on two hashes): the same for any partitioning or retry."""
    u = (text_hash(key, f"{seed}a") + F.lit(1)).cast("double") / F.lit(float(HASH_MOD + 1))
    v = text_hash(key, f"{seed}b").cast("double") / F.lit(float(HASH_MOD))
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)


def augment(df: DataFrame, std: float, columns: list[str] | str, seed: int = RANDOM_STATE,
            key: list[str] | None = None) -> DataFrame:
    """Add N(0, std) noise to ``columns`` (``"all_numeric"``: every numeric one but the label and the keys), drawn
    for each column from a hash of the row's key."""
    from haze.operators.clean import columns_of_type
    from haze.schemas import TRAIN_EXCLUDE

    if std <= 0:
        return df
    if columns == "all_numeric":
        columns = [c for c in columns_of_type(df, "numeric") if c not in TRAIN_EXCLUDE]
    text = key_text(key or ["city", "timestamp"])
    return df.withColumns({c: F.col(c) + F.lit(float(std)) * normal_noise(text, f"{seed}:{c}") for c in columns})


# ---------------------------------------------------------------- E7, E8, E9
def regression_metrics(pred: DataFrame, y: str = "y", y_hat: str = "y_hat", group: list[str] | None = None) -> DataFrame:
    """rmse, mae, r2, n per group; r2 = 1 - SSE / (n * var_pop(y)), NULL when y is constant."""
    e = F.col(y) - F.col(y_hat)
    scored = pred.where(F.col(y).isNotNull() & F.col(y_hat).isNotNull())
    return scored.groupBy(*(group or [])).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), F.count(F.lit(1)) * F.var_pop(F.col(y)))).alias("r2"),
        F.count(F.lit(1)).alias("n"))


def best_model(metrics: DataFrame, by: str = "rmse", model: str = "model", group: list[str] | None = None,
               order: list[str] | None = None) -> DataFrame:
    """argmin of ``by`` per group; NULL/NaN metrics last, ties by ``order`` (fixed model order)."""
    rank = F.lit(0)
    if order:
        rank = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in order]), F.col(model)), F.lit(len(order) + 1))
    bad = F.col(by).isNull() | F.isnan(F.col(by))
    key = F.struct(bad.alias("bad"), F.when(~bad, F.col(by)).alias("v"), rank.alias("rank"), F.col(model).alias("m"))
    return metrics.groupBy(*(group or [])).agg(F.min_by(F.struct(*metrics.columns), key).alias("b")).select("b.*")


def latest_versions(registry: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """Latest version per model name: ``max_by``, combined before the shuffle."""
    cols = [c for c in registry.columns if c != name]
    return registry.groupBy(name).agg(F.max_by(F.struct(*cols), F.col(version)).alias("r")).select(name, "r.*")


# ---------------------------------------------------------------- I17, I18, I16
def display_name(model: str | Column) -> Column:
    """'aqi_random_forest' -> 'Random Forest'."""
    m = F.col(model) if isinstance(model, str) else model
    return F.initcap(F.replace(F.replace(m, F.lit("aqi_"), F.lit("")), F.lit("_"), F.lit(" ")))


def fmt4(x: str | Column) -> Column:
    """4-decimal text, or 'N/A' for NULL/NaN (``format_string`` of NULL is the text 'null')."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.isNull() | F.isnan(c), F.lit("N/A")).otherwise(F.format_string("%.4f", c))


def numeric_metrics(meta: Column) -> Column:
    """map<string,string> -> map<string,double> keeping only values castable to double."""
    kept = F.map_filter(meta, lambda k, v: v.try_cast("double").isNotNull())
    return F.transform_values(kept, lambda k, v: v.try_cast("double"))


# ---------------------------------------------------------------- registry
REGISTRY_SCHEMA = ("name string, version int, path string, metrics map<string,double>, "
                   "feature_columns array<string>, created_at timestamp_ntz")


def next_version(spark: SparkSession, registry_path: str, name: str) -> int:
    """1 for a name that isn't registered; a registry that can't be read is an error."""
    from haze.sources import fs

    if not fs.has_rows(spark, registry_path):
        return 1
    last = spark.read.parquet(registry_path).where(F.col("name") == name).agg(F.max("version")).first()[0]
    return (last or 0) + 1


def register_model(spark: SparkSession, registry_path: str, name: str, path: str, metrics: dict,
                   feature_columns: list[str], created_at: dt.datetime | None = None, version: int | None = None) -> int:
    """Append one registry row with the next version for ``name``; returns the version.

    Single writer per name is assumed (as with the source's registry).
    """
    version = version or next_version(spark, registry_path, name)
    numeric = {}
    for k, v in (metrics or {}).items():
        try:
            numeric[k] = float(v)
        except (TypeError, ValueError):
            pass
    row = [(name, version, path, numeric, list(feature_columns), created_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))]
    spark.createDataFrame(row, REGISTRY_SCHEMA).write.mode("append").parquet(registry_path)
    return version


# ---------------------------------------------------------------- L1 .. L3, L5
def _assembled(df: DataFrame, features: list[str], label: str | None = "AQI") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    va = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    extra = [F.col(label).alias("label")] if label else []
    keep = [c for c in df.columns if c not in features and c != label]
    return va.transform(df.select(*keep, *cols, *extra))


def forest_regressor(seed: int = RANDOM_STATE, max_memory_mb: int = 64):
    """100 trees, depth 20, leaf >= 2, all features per split, seed 42.

    ``maxMemoryInMB`` is the histogram budget of *each* concurrent task; 64 MB
    keeps 8+ tasks per executor inside a default heap (more passes, same trees:
    with all features per split and seeded bootstraps the node grouping does
    not change the result).
    """
    from pyspark.ml.regression import RandomForestRegressor

    return RandomForestRegressor(numTrees=100, maxDepth=20, minInstancesPerNode=2, featureSubsetStrategy="all",
                                 seed=seed, maxMemoryInMB=max_memory_mb, cacheNodeIds=True, checkpointInterval=10)


def gbt_regressor(kind: str = "shallow", seed: int = RANDOM_STATE):
    """Boosted trees with the two source libraries' documented defaults re-aimed at Spark's GBT."""
    from pyspark.ml.regression import GBTRegressor

    if kind == "shallow":
        return GBTRegressor(maxIter=100, stepSize=0.1, maxDepth=5, seed=seed,
                            validationIndicatorCol="is_val", validationTol=0.001)
    return GBTRegressor(maxIter=100, stepSize=0.3, maxDepth=6, seed=seed,
                        validationIndicatorCol="is_val", validationTol=0.001)


def _validates(estimator) -> bool:
    """Whether an estimator asks for validation rows."""
    if hasattr(estimator, "hasParam"):
        return estimator.hasParam("validationIndicatorCol") and estimator.isSet("validationIndicatorCol")
    return getattr(estimator, "validates", False)


def fit_and_evaluate(train: DataFrame, test: DataFrame, features: list[str], estimator, name: str,
                     val_fraction: float = 0.1):
    """Fit on ``train`` (its time-ordered tail is the validation slice when the
    estimator asks for one) and evaluate on ``test``. Returns (model, metrics DataFrame)."""
    tr = _assembled(train, features)
    if _validates(estimator):
        since = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("timestamp"))
        cutoff = train.select(F.percentile_approx(since,
                                                  1.0 - val_fraction, 10000)).first()[0]
        tr = tr.withColumn("is_val", since > F.lit(cutoff))
    model = estimator.fit(tr)
    pred = model.transform(_assembled(test, features)).select(F.col("label").alias("y"),
                                                               F.col("prediction").alias("y_hat"))
    metrics = regression_metrics(pred).withColumn("model", F.lit(name))
    return model, metrics


def score(df: DataFrame, model, features: list[str], keep: list[str] | None = None,
          out: str = "predicted_aqi") -> DataFrame:
    """Batch scoring on executors: the input columns (or those of ``keep``) with the prediction appended.

    Absent features and NULL count as 0 for the model only; the columns returned are as they came.
    """
    from pyspark.ml.feature import VectorAssembler

    keep = list(df.columns) if keep is None else list(keep)
    have = set(df.columns)
    inputs = {f"_x{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
              for i, c in enumerate(features)}
    vector = VectorAssembler(inputCols=list(inputs), outputCol=model.getFeaturesCol(), handleInvalid="keep")
    kept = {f"_k{i}": F.col(c) for i, c in enumerate(keep)}  # so that no input column clashes with the model's
    res = model.transform(vector.transform(df.select(*[v.alias(k) for k, v in {**kept, **inputs}.items()])))
    return res.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], F.col(model.getPredictionCol()).alias(out))
