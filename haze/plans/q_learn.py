"""Registered queries: metrics, model choice, registry, samples, MLlib
trainers, forecasting and feature influence."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from haze.functions.aqi import overall_aqi
from haze.operators import boost, explain, forecast, learn, series, treeshap
from haze.plans import common
from haze.plans.catalog import R, query, rounded
from haze.plans.oracle_base import BASE, SCORED, band_sql, d, local_sql, overall_sql, with_ctes
from haze.plans.q_series import FULL_CTES
from haze.schemas import AQI_POLLUTANT_ORDER, MODEL_FEATURES

PRED_MODELS = ["persistence", "seasonal_naive", "rolling_mean"]


# ------------------------------------------------------------------ baseline predictions
def predictions(spark, sf):
    """(model, city, timestamp, y, y_hat) of three baseline forecasters of AQI."""
    s = common.scored(spark, sf).select("city", "timestamp", "AQI")
    w = series.series_window()
    wide = s.select("city", "timestamp", F.col("AQI").alias("y"),
                    F.lag("AQI", 1).over(w).alias("persistence"),
                    F.lag("AQI", 24).over(w).alias("seasonal_naive"),
                    F.avg("AQI").over(w.rowsBetween(-24, -1)).alias("rolling_mean"))
    return wide.unpivot(["city", "timestamp", "y"], PRED_MODELS, "model", "y_hat")


PRED_CTE = """w AS (SELECT city, timestamp, AQI AS y,
             lag(AQI, 1) OVER (PARTITION BY city ORDER BY timestamp) AS persistence,
             lag(AQI, 24) OVER (PARTITION BY city ORDER BY timestamp) AS seasonal_naive,
             avg(AQI) OVER (PARTITION BY city ORDER BY timestamp ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS rolling_mean
      FROM scored),
pred AS (
  SELECT city, timestamp, y, 'persistence' AS model, persistence AS y_hat FROM w UNION ALL
  SELECT city, timestamp, y, 'seasonal_naive', seasonal_naive FROM w UNION ALL
  SELECT city, timestamp, y, 'rolling_mean', rolling_mean FROM w)"""


def _metrics_sql(group: str) -> str:
    e = "(y - y_hat)"
    return f"""SELECT {group}, {R(f'sqrt(avg({e} * {e}))', 'rmse')}, {R(f'avg(abs({e}))', 'mae')},
       {R(f'{d(1.0)} - sum({e} * {e}) / (CAST(COUNT(*) AS DOUBLE) * var_pop(y))', 'r2')}, COUNT(*) AS n
FROM pred WHERE y IS NOT NULL AND y_hat IS NOT NULL GROUP BY {group}"""


@query("regression_metrics", with_ctes(*BASE, SCORED, PRED_CTE) + _metrics_sql("model"))
def q_regression_metrics(spark, sf):
    return rounded(learn.regression_metrics(predictions(spark, sf), group=["model"]))


@query("best_model", with_ctes(*BASE, SCORED, PRED_CTE) + f""",
m AS ({_metrics_sql('model, city')})
SELECT model, city, rmse, mae, r2, n FROM (
  SELECT *, row_number() OVER (PARTITION BY city ORDER BY rmse NULLS LAST,
     CASE model WHEN 'persistence' THEN 1 WHEN 'seasonal_naive' THEN 2 ELSE 3 END) AS rk FROM m) WHERE rk = 1""")
def q_best_model(spark, sf):
    m = rounded(learn.regression_metrics(predictions(spark, sf), group=["model", "city"]))
    return learn.best_model(m, "rmse", group=["city"], order=PRED_MODELS)


# ------------------------------------------------------------------ registry (weekly re-fits)
def registry(spark, sf):
    """One registry row per (model, week): version = week order per model."""
    p = predictions(spark, sf).withColumn("week", F.date_trunc("week", F.col("timestamp").cast("timestamp")))
    m = learn.regression_metrics(p, group=["model", "week"])
    last_ts = p.groupBy("model", "week").agg(F.max("timestamp").alias("created_at"))
    m = rounded(m).join(last_ts, ["model", "week"])
    v = F.dense_rank().over(Window.partitionBy("model").orderBy("week"))
    name = F.concat(F.lit("aqi_"), F.col("model"))
    return m.select(name.alias("name"), v.cast("int").alias("version"),
                    F.concat(F.lit("models/"), name, F.lit("/v"), v.cast("string")).alias("path"),
                    "rmse", "mae", "r2", "created_at")


REG_CTE = f""",
pw AS (SELECT *, date_trunc('week', timestamp) AS week FROM pred),
mw AS (SELECT model, week, {R('sqrt(avg((y - y_hat) * (y - y_hat)))', 'rmse')}, {R('avg(abs(y - y_hat))', 'mae')},
              {R(f'{d(1.0)} - sum((y - y_hat) * (y - y_hat)) / (CAST(COUNT(*) AS DOUBLE) * var_pop(y))', 'r2')}
       FROM pw WHERE y IS NOT NULL AND y_hat IS NOT NULL GROUP BY model, week),
lw AS (SELECT model, week, max(timestamp) AS created_at FROM pw GROUP BY model, week),
reg AS (SELECT 'aqi_' || mw.model AS name,
               CAST(dense_rank() OVER (PARTITION BY mw.model ORDER BY mw.week) AS INTEGER) AS version,
               'models/aqi_' || mw.model || '/v' || CAST(dense_rank() OVER (PARTITION BY mw.model ORDER BY mw.week) AS VARCHAR) AS path,
               rmse, mae, r2, created_at
        FROM mw JOIN lw ON mw.model = lw.model AND mw.week = lw.week)"""


@query("latest_model", with_ctes(*BASE, SCORED, PRED_CTE) + REG_CTE + """
SELECT name, version, path, rmse, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY version DESC) AS rk FROM reg) WHERE rk = 1""")
def q_latest_model(spark, sf):
    return learn.latest_versions(registry(spark, sf)).select("name", "version", "path", "rmse", "created_at")


@query("registry_metrics", with_ctes(*BASE, SCORED, PRED_CTE) + REG_CTE + """
SELECT name, version, metric, value FROM (
  SELECT name, version, 'rmse' AS metric, rmse AS value FROM reg UNION ALL
  SELECT name, version, 'mae', mae FROM reg UNION ALL
  SELECT name, version, 'r2', r2 FROM reg) WHERE value IS NOT NULL""")
def q_registry_metrics(spark, sf):
    r = registry(spark, sf)
    meta = F.create_map(F.lit("model"), F.col("name"), F.lit("rmse"), F.col("rmse").cast("string"),
                        F.lit("mae"), F.col("mae").cast("string"), F.lit("r2"), F.col("r2").cast("string"),
                        F.lit("timestamp"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"))
    kept = r.select("name", "version", learn.numeric_metrics(meta).alias("m"))
    return kept.select("name", "version", F.explode("m").alias("metric", "value"))


def _title_sql(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({x}, ' '), "
            f"lambda w: upper(w[1]) || lower(w[2:])), ' ')")


@query("model_display_names", with_ctes(*BASE, SCORED, PRED_CTE) + REG_CTE + f"""
SELECT DISTINCT name, {_title_sql("replace(replace(name, 'aqi_', ''), '_', ' ')")} AS display_name,
       split_part(name, '_', 2) AS family, upper(trim(name)) AS upper_name FROM reg""")
def q_model_display_names(spark, sf):
    r = registry(spark, sf).select("name").distinct()
    return r.select("name", learn.display_name("name").alias("display_name"),
                    F.split_part(F.col("name"), F.lit("_"), F.lit(2)).alias("family"),
                    F.upper(F.trim(F.col("name"))).alias("upper_name"))


def _fmt_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 'N/A' ELSE printf('%.4f', {x}) END"


@query("metrics_table", with_ctes(*BASE, SCORED, PRED_CTE) + f""",
m AS ({_metrics_sql('model')})
SELECT {_title_sql("replace(replace('aqi_' || model, 'aqi_', ''), '_', ' ')")} AS Model,
       {_fmt_sql('rmse')} AS RMSE, {_fmt_sql('mae')} AS MAE, {_fmt_sql('r2')} AS R2 FROM m""")
def q_metrics_table(spark, sf):
    m = rounded(learn.regression_metrics(predictions(spark, sf), group=["model"]))
    return m.select(learn.display_name(F.concat(F.lit("aqi_"), F.col("model"))).alias("Model"),
                    learn.fmt4("rmse").alias("RMSE"), learn.fmt4("mae").alias("MAE"), learn.fmt4("r2").alias("R2"))


# ------------------------------------------------------------------ samples, augmentation
def _text_hash_sql(seed: str, key: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT)"


_KEY_COLS = ["city", "timestamp"]
_KEY_SQL = "(city || '|' || strftime(timestamp, '%Y-%m-%d %H:%M:%S'))"
_HASH_SQL = _text_hash_sql("42", _KEY_SQL)
_ROW_SQL = f"CAST('0x' || substr(md5('42:' || {_KEY_SQL}), 1, 15) AS BIGINT)"


@query("hash_sample", with_ctes(*BASE, SCORED) + f"""
SELECT city, timestamp, {R('AQI')} FROM scored WHERE {_HASH_SQL} < {int(0.3 * 4294967296)}""")
def q_hash_sample(spark, sf):
    s = common.scored(spark, sf)
    return rounded(learn.hash_sample(s, 0.3, learn.text_hash(learn.key_text(_KEY_COLS))).select("city", "timestamp", "AQI"))


@query("fixed_sample", with_ctes(*BASE, SCORED) + f"""
SELECT city, timestamp, {R('AQI')} FROM scored ORDER BY {_HASH_SQL}, city, timestamp LIMIT 100""")
def q_fixed_sample(spark, sf):
    s = common.scored(spark, sf)
    return rounded(learn.fixed_sample(s, 100, learn.text_hash(learn.key_text(_KEY_COLS)), ["city", "timestamp"])
                   .select("city", "timestamp", "AQI"))


def _noise_sql(col: str) -> str:
    u = f"(CAST({_text_hash_sql(f'42:{col}a', _KEY_SQL)} + 1 AS DOUBLE) / {d(4294967297.0)})"
    v = f"(CAST({_text_hash_sql(f'42:{col}b', _KEY_SQL)} AS DOUBLE) / {d(4294967296.0)})"
    return f"(sqrt({d(-2.0)} * ln({u})) * cos({d(2 * 3.141592653589793)} * {v}))"


@query("augment", FULL_CTES + "SELECT city, timestamp, " + ", ".join(
    R(f"{c} + {d(0.5)} * {_noise_sql(c)}", c) for c in MODEL_FEATURES) + f", {R('AQI')} FROM feat")
def q_augment(spark, sf):
    f = common.features(spark, sf).select("city", "timestamp", *MODEL_FEATURES, "AQI")
    return rounded(learn.augment(f, 0.5, "all_numeric", seed=42))


# ------------------------------------------------------------------ MLlib
AS_OF_FORECAST = dt.datetime(2024, 1, 31, 0, 0, 0)


def _split(spark, sf):
    f = common.features(spark, sf)
    idx = series.time_split(f, ["timestamp", "city"], n_splits=3)
    return idx.where(F.col("split") == "train"), idx.where(F.col("split") == "test")


def _train(spark, sf, estimator, name):
    """(model, one row): rows of both folds, and whether the model beats the mean of the training fold."""
    tr, te = _split(spark, sf)
    model, metrics = learn.fit_and_evaluate(tr, te, MODEL_FEATURES, estimator, name)
    n_train, mean = tr.agg(F.count(F.lit(1)), F.avg("AQI")).first()
    flat = te.agg(F.sqrt(F.avg(F.pow(F.col("AQI") - F.lit(mean), 2)))).first()[0]
    return model, metrics.select("model", F.lit(n_train).cast("bigint").alias("n_train"), F.col("n").alias("n_test"),
                                 (F.col("rmse") < F.lit(flat)).alias("beats_mean"))


def _fold_sql(model: str) -> str:
    return FULL_CTES + f"""
SELECT '{model}' AS model, n - n // 4 AS n_train, n // 4 AS n_test, true AS beats_mean FROM (SELECT COUNT(*) AS n FROM feat)"""


@query("train_forest", _fold_sql("RandomForest"))
def q_train_forest(spark, sf):
    return _train(spark, sf, learn.forest_regressor(), "RandomForest")[1]


@query("train_gbt_shallow", _fold_sql("BoostedShallow"))
def q_train_gbt_shallow(spark, sf):
    return _train(spark, sf, learn.gbt_regressor("shallow"), "BoostedShallow")[1]


@query("train_gbt_deep", _fold_sql("BoostedDeep"))
def q_train_gbt_deep(spark, sf):
    return _train(spark, sf, learn.gbt_regressor("deep"), "BoostedDeep")[1]


@query("train_boosted_leafwise", _fold_sql("BoostedLeafwise"))
def q_train_boosted_leafwise(spark, sf):
    return _train(spark, sf, boost.leafwise(), "BoostedLeafwise")[1]


@query("train_boosted_depthwise", _fold_sql("BoostedDepthwise"))
def q_train_boosted_depthwise(spark, sf):
    return _train(spark, sf, boost.depthwise(), "BoostedDepthwise")[1]


STUMP_ROUNDS = 3


def _stumps_sql() -> str:
    """Boosting of stumps spelled out: quantile cuts by rank, whole-number residuals, the largest gain of each round."""
    long = " UNION ALL ".join(f"SELECT i, {f} AS f, coalesce({c}, {d(0.0)}) AS x FROM tr" for f, c in enumerate(MODEL_FEATURES))
    one = d(float(2 ** 30))
    ctes = [f"""numbered AS (SELECT *, row_number() OVER (ORDER BY timestamp, city) - 1 AS i, COUNT(*) OVER () AS n_all FROM feat),
tr AS (SELECT * FROM numbered WHERE i < n_all - n_all // 4),
x AS ({long}),
pos AS (SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) AS rn, COUNT(*) OVER (PARTITION BY f) AS n FROM x),
cut AS (SELECT DISTINCT f, x AS c FROM pos JOIN (SELECT range AS k FROM range(1, 255)) ON rn = CAST(ceil(CAST(k AS DOUBLE) / {d(255.0)} * CAST(n AS DOUBLE)) AS BIGINT)),
y0 AS (SELECT i, AQI AS y, (SELECT avg(AQI) FROM tr) AS m FROM tr)"""]
    for r in range(1, STUMP_ROUNDS + 1):
        ctes.append(f"""g{r} AS (SELECT i, CAST(floor((y - m) * {one} + {d(0.5)}) AS BIGINT) AS g FROM y{r - 1}),
s{r} AS (SELECT f, c, CAST(sum(g) FILTER (WHERE x <= c) AS DOUBLE) AS gl, CAST(coalesce(sum(g) FILTER (WHERE x > c), 0) AS DOUBLE) AS gr,
           COUNT(*) FILTER (WHERE x <= c) AS nl, COUNT(*) FILTER (WHERE x > c) AS nr
    FROM cut JOIN x USING (f) JOIN g{r} USING (i) GROUP BY f, c),
b{r} AS (SELECT f, c, nl, nr, {d(0.1)} * gl / {one} / CAST(nl AS DOUBLE) AS lv, {d(0.1)} * gr / {one} / CAST(nr AS DOUBLE) AS rv
    FROM s{r} WHERE nl >= 20 AND nr >= 20 ORDER BY gl * gl / CAST(nl AS DOUBLE) + gr * gr / CAST(nr AS DOUBLE) DESC, f, c LIMIT 1),
y{r} AS (SELECT y.i, y.y, y.m + CASE WHEN x.x <= b.c THEN b.lv ELSE b.rv END AS m FROM y{r - 1} y JOIN x ON y.i = x.i JOIN b{r} b ON x.f = b.f)""")
    names = ", ".join(f"'{c}'" for c in MODEL_FEATURES)
    rows = " UNION ALL ".join(f"SELECT {r} AS round, list_extract([{names}], f + 1) AS feature, {R('c', 'threshold')}, nl AS n_left, nr AS n_right, "
                              f"{R('lv', 'left_value')}, {R('rv', 'right_value')} FROM b{r}" for r in range(1, STUMP_ROUNDS + 1))
    return FULL_CTES.rstrip() + ",\n" + ",\n".join(ctes) + "\n" + rows


@query("boosted_stumps", _stumps_sql())
def q_boosted_stumps(spark, sf):
    """The splits and steps of the first rounds of trees with two leaves, on the training fold."""
    tr, _ = _split(spark, sf)
    model = boost.leafwise(rounds=STUMP_ROUNDS, max_leaves=2, validates=False).fit(learn._assembled(tr, MODEL_FEATURES))
    nodes = spark.createDataFrame(model.nodes().drop(columns=["categories"]), boost.NODE_SCHEMA).where("tree > 0")
    child = nodes.select("tree", "id", F.col("cover").cast("bigint").alias("n"), F.col("prediction").alias("value"))
    left, right = (child.select("tree", F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("value").alias(f"{side}_value"))
                   for side in ("left", "right"))
    names = F.array(*[F.lit(c) for c in MODEL_FEATURES])
    return rounded(nodes.where("left >= 0").join(left, ["tree", "left"]).join(right, ["tree", "right"]).select(
        F.col("tree").alias("round"), names[F.col("feature")].alias("feature"), "threshold", "n_left", "n_right", "left_value", "right_value"))


def _fitted_forest(spark, sf):
    """A forest fitted on the training fold, and the range of its labels, which bounds what a forest predicts."""
    tr, te = _split(spark, sf)
    model, _ = learn.fit_and_evaluate(tr, te, MODEL_FEATURES, learn.forest_regressor(), "RandomForest")
    return model, tr.agg(F.min("AQI"), F.max("AQI")).first()


def _in_range(bounds):
    return F.col("predicted_aqi").between(F.lit(bounds[0] - 1e-9), F.lit(bounds[1] + 1e-9)).alias("in_range")


@query("score", FULL_CTES + "SELECT city, timestamp, " + ", ".join(R(c) for c in MODEL_FEATURES) + ", true AS in_range FROM feat")
def q_score(spark, sf):
    """Predictions appended to the input rows: every input column stays, each prediction is inside the label range."""
    model, bounds = _fitted_forest(spark, sf)
    f = common.features(spark, sf).select("city", "timestamp", *MODEL_FEATURES)
    scored = learn.score(f, model, MODEL_FEATURES)
    return rounded(scored.select(*f.columns, _in_range(bounds)))


def _forecast_sql() -> str:
    return BASEROW_SQL + "SELECT city, date, n_hours, true AS in_range FROM daily"


def q_forecast_72h(spark, sf):
    model, bounds = _fitted_forest(spark, sf)
    _, daily = forecast.forecast_72h(common.features(spark, sf), model, AS_OF_FORECAST)
    return daily.select("city", "date", "n_hours", _in_range(bounds))


def _sampled(spark, sf):
    f = common.features(spark, sf).withColumn("row_id", learn.row_key(_KEY_COLS))
    return learn.fixed_sample(f, 100, F.col("row_id"), _KEY_COLS)


_SAMPLE_CTE = FULL_CTES.rstrip() + f""",
sample AS (SELECT *, {_ROW_SQL} AS row_id FROM feat ORDER BY {_ROW_SQL}, city, timestamp LIMIT 100)
"""


@query("shapley", _SAMPLE_CTE + f"SELECT row_id, {len(MODEL_FEATURES)} AS n_features, true AS adds_up FROM sample")
def q_shapley(spark, sf):
    """Per sampled row: the contributions add up to the prediction less that of the reference point."""
    model, _ = _fitted_forest(spark, sf)
    sample = _sampled(spark, sf).persist()
    contrib = explain.shapley_values(sample, model, MODEL_FEATURES, n_perm=32)
    means = sample.agg(*[F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in MODEL_FEATURES])
    reference = learn.score(means, model, MODEL_FEATURES).first()["predicted_aqi"]
    sums = contrib.groupBy("row_id").agg(F.sum("contribution").alias("s"), F.count(F.lit(1)).cast("int").alias("n_features"))
    at = learn.score(sample, model, MODEL_FEATURES, keep=["row_id"])
    return sums.join(at, "row_id").select("row_id", "n_features",
                                          (F.abs(F.col("s") - (F.col("predicted_aqi") - F.lit(reference))) < 1e-6).alias("adds_up"))


@query("tree_shapley", FULL_CTES + f"SELECT city, timestamp, {len(MODEL_FEATURES)} AS n_features, true AS adds_up FROM feat")
def q_tree_shapley(spark, sf):
    """Exact values for every row: the trees' leaves give them, the model's own prediction is what they must add up to."""
    model, _ = _fitted_forest(spark, sf)
    leaves = treeshap.model_leaves(spark, model, len(MODEL_FEATURES))
    f = common.features(spark, sf)
    contrib = treeshap.tree_shapley(f, model, MODEL_FEATURES, ["city", "timestamp"], leaves)
    sums = contrib.groupBy("city", "timestamp").agg(F.sum("contribution").alias("s"), F.count(F.lit(1)).cast("int").alias("n_features"))
    at = learn.score(f, model, MODEL_FEATURES, keep=["city", "timestamp"])
    adds_up = F.abs(F.col("s") + F.lit(leaves.expected) - F.col("predicted_aqi")) < 1e-6
    return sums.join(at, ["city", "timestamp"]).select("city", "timestamp", "n_features", adds_up.alias("adds_up"))


class LinearPredictor:
    """A known linear function with the interface of a fitted model, for checking explanations."""

    def __init__(self, weights: list[float]):
        self.weights = weights

    def transform(self, df):
        from pyspark.ml.functions import vector_to_array

        x = vector_to_array("features")
        return df.withColumn("prediction", sum((x[i] * F.lit(w) for i, w in enumerate(self.weights)), F.lit(1.0)))


_WEIGHTS = [0.5 * (i + 1) for i in range(len(MODEL_FEATURES))]


def _surrogate_sql() -> str:
    parts = [f"SELECT row_id, '{c}' AS feature, floor({d(w)} * ({c} - (SELECT avg({c}) FROM sample)) * {d(256.0)} + {d(0.5)}) AS contribution_256 "
             f"FROM sample" for c, w in zip(MODEL_FEATURES, _WEIGHTS)]
    return _SAMPLE_CTE + "\nUNION ALL\n".join(parts)


@query("local_surrogate", _surrogate_sql())
def q_local_surrogate(spark, sf):
    """On a known linear function the surrogate's contributions are weight * (value - mean), here in 256ths."""
    sample = _sampled(spark, sf).persist()
    contrib = explain.local_surrogate(sample, LinearPredictor(_WEIGHTS), MODEL_FEATURES, n_samples=200)
    return contrib.select("row_id", "feature", F.floor(F.col("contribution") * F.lit(256.0) + F.lit(0.5)).cast("double").alias("contribution_256"))


# ------------------------------------------------------------------ forecast (index model)
_DRIFT = [c for c in MODEL_FEATURES if c != "hour_sin"]


def _grid(spark, sf):
    return forecast.forecast_grid(forecast.forecast_base(common.features(spark, sf)))


def _inputs(spark, sf):
    return forecast.forecast_inputs(_grid(spark, sf))


def _index_hourly(spark, sf):
    """Forecast AQI from the drifted pollutant inputs with the banded index itself."""
    inp = _inputs(spark, sf)
    return inp.select("city", "timestamp", "step", overall_aqi(AQI_POLLUTANT_ORDER).alias("predicted_aqi"))


def baserow_sql(ctes: str) -> str:
    return ctes.rstrip() + f""",
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn FROM feat)
         WHERE rn = 1),
tr AS (SELECT city, {', '.join(f"(arg_max({c}, timestamp) - arg_min({c}, timestamp)) / CAST(COUNT(*) AS DOUBLE) AS {c}_trend" for c in _DRIFT)}
       FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn FROM feat)
             WHERE rn <= 24) GROUP BY city),
grid AS (SELECT l.*, {', '.join(f't.{c}_trend' for c in _DRIFT)}, s.step,
                l.timestamp AS base_timestamp, l.timestamp + to_hours(s.step) AS ts_f
         FROM last l JOIN tr t ON l.city = t.city, (SELECT CAST(range AS INTEGER) AS step FROM range(1, 73)) s),
inp AS (SELECT city, step, ts_f AS timestamp, base_timestamp,
               {', '.join(f"CASE WHEN {c} + {c}_trend * CAST(step AS DOUBLE) IS NULL OR isnan({c} + {c}_trend * CAST(step AS DOUBLE)) THEN {d(0.0)} ELSE greatest({d(0.0)}, {c} + {c}_trend * CAST(step AS DOUBLE)) END AS {c}" for c in _DRIFT)},
               sin({d(2 * 3.141592653589793)} * CAST(hour({local_sql('ts_f')}) AS DOUBLE) / {d(24.0)}) AS hour_sin
        FROM grid),
hourly AS (SELECT city, timestamp, step, {overall_sql()} AS predicted_aqi FROM inp),
daily AS (SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY city ORDER BY date) AS k FROM (
              SELECT city, CAST({local_sql()} AS DATE) AS date, avg(predicted_aqi) AS predicted_aqi,
                     CAST(COUNT(*) AS INTEGER) AS n_hours
              FROM hourly WHERE CAST({local_sql()} AS DATE) > DATE '2024-01-31' GROUP BY 1, 2))
          WHERE k <= 3)
"""


BASEROW_SQL = baserow_sql(FULL_CTES)


query("forecast_72h", _forecast_sql())(q_forecast_72h)


@query("forecast_grid", BASEROW_SQL + "SELECT city, step, ts_f AS timestamp, base_timestamp FROM grid")
def q_forecast_grid(spark, sf):
    return _grid(spark, sf).select("city", "step", "timestamp", "base_timestamp")


@query("forecast_inputs", BASEROW_SQL + "SELECT city, step, timestamp, " + ", ".join(
    R(c) for c in MODEL_FEATURES) + " FROM inp")
def q_forecast_inputs(spark, sf):
    return rounded(_inputs(spark, sf).select("city", "step", "timestamp", *MODEL_FEATURES))


@query("daily_forecast", BASEROW_SQL + f"SELECT city, date, {R('predicted_aqi')}, n_hours FROM daily")
def q_daily_forecast(spark, sf):
    return rounded(forecast.daily_forecast(_index_hourly(spark, sf), AS_OF_FORECAST))


@query("hazard_days", BASEROW_SQL + f"SELECT city, date, {R('predicted_aqi')}, n_hours FROM daily "
       f"WHERE predicted_aqi > {d(200.0)}")
def q_hazard_days(spark, sf):
    from haze.operators.clean import hazard_days

    return rounded(hazard_days(forecast.daily_forecast(_index_hourly(spark, sf), AS_OF_FORECAST)))


@query("forecast_cards", BASEROW_SQL + f"""
SELECT city, date, {R('predicted_aqi')}, n_hours, strftime(date, '%a, %b %d') AS label,
       printf('%.0f', predicted_aqi) AS value_text, {band_sql('predicted_aqi')} AS band,
       predicted_aqi > {d(200.0)} AS hazard FROM daily""")
def q_forecast_cards(spark, sf):
    return rounded(forecast.forecast_cards(forecast.daily_forecast(_index_hourly(spark, sf), AS_OF_FORECAST)))


# ------------------------------------------------------------------ influence of the index
def _loo_sql():
    parts = [f"SELECT city, timestamp, '{p}' AS feature, {overall_sql()} - {overall_sql(without=p)} AS contribution FROM scored"
             for p in AQI_POLLUTANT_ORDER]
    return "loo AS (" + " UNION ALL ".join(parts) + ")"


@query("mean_abs_importance", with_ctes(*BASE, SCORED, _loo_sql()) + f"""
SELECT feature, {R('avg(abs(contribution))', 'importance')} FROM loo GROUP BY feature""")
def q_mean_abs_importance(spark, sf):
    s = common.scored(spark, sf)
    return rounded(explain.mean_abs_importance(explain.leave_one_out(s, AQI_POLLUTANT_ORDER, ["city", "timestamp"])))


@query("top_features", with_ctes(*BASE, SCORED, _loo_sql()) + f"""
SELECT feature, importance FROM (SELECT feature, {R('avg(abs(contribution))', 'importance')} FROM loo GROUP BY feature)
ORDER BY importance DESC, feature LIMIT 3""")
def q_top_features(spark, sf):
    s = common.scored(spark, sf)
    imp = rounded(explain.mean_abs_importance(explain.leave_one_out(s, AQI_POLLUTANT_ORDER, ["city", "timestamp"])))
    return explain.top_features(imp, k=3)
