"""Feature influence: aggregation of contributions, top-k, sampled
permutation Shapley values and a local linear surrogate.

Shapley (Strumbelj & Kononenko, 2014): for each sampled row and random
feature order, features enter one at a time; a feature's contribution is the
change in prediction when it enters. All (row, order, prefix) inputs are
built with ``explode`` on executors and scored in one batch ``transform``;
rows x orders x (features + 1) inputs in total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haze.schemas import RANDOM_STATE, TOP_K


def mean_abs_importance(contrib: DataFrame, feature: str = "feature", value: str = "contribution",
                        group: list[str] | None = None) -> DataFrame:
    """Mean |contribution| per feature (and group), largest first."""
    g = [*(group or []), feature]
    return (contrib.groupBy(*g).agg(F.avg(F.abs(F.col(value))).alias("importance"))
                   .orderBy(F.col("importance").desc(), F.col(feature)))


def top_features(importance: DataFrame, k: int = TOP_K, col: str = "importance", feature: str = "feature") -> DataFrame:
    """Top-k by importance (TakeOrderedAndProject); ties by feature name."""
    return importance.orderBy(F.col(col).desc(), F.col(feature)).limit(k)


def leave_one_out(df: DataFrame, pollutants: list[str], row_key: list[str]) -> DataFrame:
    """Attribution of the banded index itself: AQI(x) - AQI(x without pollutant p); one projection, no join."""
    from haze.functions.aqi import overall_aqi

    parts = F.array(*[F.struct(F.lit(p).alias("feature"), overall_aqi(pollutants, without=p).alias("rest")) for p in pollutants])
    rows = df.select(*row_key, overall_aqi(pollutants).alias("_full"), F.explode(parts).alias("_p"))
    return rows.select(*row_key, F.col("_p.feature").alias("feature"), (F.col("_full") - F.col("_p.rest")).alias("contribution"))


def shapley_values(sample: DataFrame, model, features: list[str], background: DataFrame | None = None,
                   n_perm: int = 32, seed: int = RANDOM_STATE, row_id: str = "row_id") -> DataFrame:
    """Sampled permutation Shapley values: (row_id, feature, contribution).

    ``background`` supplies the reference point (default: the sample's
    column means, a one-row aggregate broadcast to every task).
    """
    from haze.operators.learn import _assembled

    nf = len(features)
    bg = (background if background is not None else sample).agg(
        *[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"_bg_{c}") for c in features])
    rows = sample.select(F.col(row_id), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    perms = F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("perm")
    # random order of feature indices per (row, perm): sort indices by a seeded hash
    order = F.transform(
        F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(nf - 1)),
                                 lambda i: F.struct(F.xxhash64(F.lit(seed), F.col(row_id), F.col("perm"), i).alias("h"),
                                                    i.alias("i")))),
        lambda s: s["i"])
    prefix = F.explode(F.sequence(F.lit(0), F.lit(nf))).alias("k")
    # the reference point is one aggregate row of len(features) numbers: inline it as literals
    bg_row = bg.first().asDict()
    grid = (rows.select("*", perms).withColumn("order", order).select("*", prefix)
                .withColumns({k: F.lit(v).cast("double") for k, v in bg_row.items()}))
    # feature j is "in" when its position in the order is < k
    pos = {c: F.array_position(F.col("order"), F.lit(j)) - 1 for j, c in enumerate(features)}
    mixed = grid.select(row_id, "perm", "k", "order",
                        *[F.when(pos[c] < F.col("k"), F.col(c)).otherwise(F.col(f"_bg_{c}")).alias(c)
                          for c in features])
    pred = model.transform(_assembled(mixed, features, label=None)).select(row_id, "perm", "k", "order", "prediction")
    w = Window.partitionBy(row_id, "perm").orderBy("k")
    steps = (pred.withColumn("delta", F.col("prediction") - F.lag("prediction", 1).over(w))
                 .where(F.col("k") > 0)
                 .withColumn("fidx", F.element_at(F.col("order"), F.col("k"))))
    names = F.array(*[F.lit(c) for c in features])
    return (steps.groupBy(row_id, "fidx").agg(F.avg("delta").alias("contribution"))
                 .select(row_id, F.element_at(names, F.col("fidx") + 1).alias("feature"), "contribution"))


def local_surrogate(sample: DataFrame, model, features: list[str], n_samples: int = 200, kernel_width: float | None = None,
                    seed: int = RANDOM_STATE, row_id: str = "row_id") -> DataFrame:
    """Per-row weighted linear fit of the model around each sampled row:
    (row_id, feature, contribution = coefficient * (x - mean)).

    Perturbations are normal noise from a hash of row and draw, scaled by the
    feature's std, and scored in one batch. The fit's sufficient statistics, sums of weighted products of the
    noise and the prediction, are one grouped aggregate, combined before the shuffle; the equations of each row,
    features + 1, are solved by elimination in column expressions. A feature without spread contributes 0.
    """
    from haze.operators.learn import _assembled, normal_noise

    nf = len(features)
    if n_samples <= nf + 1:
        raise ValueError(f"{n_samples} draws can't fit {nf} features and a constant")
    kw = kernel_width or (nf ** 0.5) * 0.75
    st = sample.agg(*[F.avg(F.col(c).cast("double")).alias(f"_mu_{c}") for c in features],
                    *[F.coalesce(F.stddev_samp(F.col(c).cast("double")), F.lit(0.0)).alias(f"_sd_{c}")
                      for c in features])
    rows = sample.select(F.col(row_id), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    s = F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("s")
    st_row = st.first().asDict()  # one aggregate row (2 x len(features) numbers) inlined as literals
    mean = {c: F.lit(st_row[f"_mu_{c}"]).cast("double") for c in features}
    spread = {c: F.lit(st_row[f"_sd_{c}"]).cast("double") for c in features}
    draw = F.concat_ws("|", F.col(row_id).cast("string"), F.col("s").cast("string"))
    noise = [F.when((F.col("s") == 0) | (spread[c] == 0), 0.0).otherwise(normal_noise(draw, f"{seed}:{j}")).alias(f"_z{j}")
             for j, c in enumerate(features)]
    drawn = rows.select("*", s).select("*", *noise)
    away = [F.try_divide(F.col(c) - mean[c], spread[c]) for c in features]  # how many spreads the row is from the mean
    perturbed = drawn.select(row_id, F.array(*away).alias("_away"), *[F.col(f"_z{j}") for j in range(nf)],
                             *[(F.col(c) + spread[c] * F.col(f"_z{j}")).alias(c) for j, c in enumerate(features)])
    z = [F.col(f"_z{j}") for j in range(nf)]
    terms = [F.lit(1.0), *z, F.col("prediction")]
    weight = F.exp(-sum(v * v for v in z) / F.lit(kw * kw))
    scored = (model.transform(_assembled(perturbed, features, label=None)).withColumn("_w", weight)
                   .select(row_id, "_away", *[(F.col("_w") * terms[i] * terms[j]).alias(f"_m{i}_{j}")
                                              for i in range(nf + 1) for j in range(i, nf + 2)]))
    sums = scored.groupBy(row_id).agg(F.any_value("_away").alias("_away"), *[
        F.sum(f"_m{i}_{j}").alias(f"_m{i}_{j}") for i in range(nf + 1) for j in range(i, nf + 2)])
    equations = F.array(*[F.array(*[F.col(f"_m{min(i, j)}_{max(i, j)}") for j in range(nf + 2)]) for i in range(nf + 1)])
    solved = sums.select(row_id, "_away", solve(equations, nf + 1).alias("_b"))
    names = F.array(*[F.lit(c) for c in features])
    parts = F.arrays_zip(names.alias("feature"), F.slice("_b", 2, nf).alias("b"), F.col("_away").alias("away"))
    return solved.select(row_id, F.explode(parts).alias("_p")).select(
        row_id, F.col("_p.feature").alias("feature"), F.coalesce(F.col("_p.b") * F.col("_p.away"), F.lit(0.0)).alias("contribution"))


def solve(equations: Column, n: int) -> Column:
    """Solution of ``n`` symmetric equations (rows of ``n`` factors and the right side) by Gauss-Jordan elimination; an unknown
    whose pivot vanishes beside the first factor, as that of a constant, is 0."""
    def step(m: Column, k: Column) -> Column:
        own = F.element_at(m, k)
        pivot = F.element_at(own, k)
        least = F.abs(F.element_at(F.element_at(equations, 1), 1)) * F.lit(1e-12)
        scaled = F.transform(own, lambda v: F.try_divide(v, pivot))
        cleared = F.transform(m, lambda row, i: F.when(i + 1 == k, scaled).otherwise(
            F.zip_with(row, scaled, lambda a, b: a - F.element_at(row, k) * b)))
        void = F.transform(m, lambda row, i: F.when(i + 1 == k, F.array_repeat(F.lit(0.0), n + 1)).otherwise(row))
        return F.when(F.abs(pivot) > least, cleared).otherwise(void)

    done = F.reduce(F.sequence(F.lit(1), F.lit(n)), equations, step)
    return F.transform(done, lambda row: F.element_at(row, n + 1))


__all__ = ["mean_abs_importance", "top_features", "leave_one_out", "shapley_values", "local_surrogate", "solve"]
