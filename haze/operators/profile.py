"""Profiling operators: counts, ranges, null counts, summary statistics,
correlations, histograms, kernel density and box-plot statistics.

Each report is one or two hash aggregates with partial aggregation, so the
input is scanned once and only per-group partial states are shuffled. Wide
reports are computed as one wide row and unpivoted to long form.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haze.session import scratch_path
from haze.sources import fs


def category_counts(df: DataFrame, col: str) -> DataFrame:
    """Value counts, nulls excluded, most frequent first."""
    return (df.where(F.col(col).isNotNull()).groupBy(col)
              .agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.col("count").desc(), F.col(col)))


def value_range(df: DataFrame, col: str, group: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(group or [])).agg(F.min(col).alias(f"min_{col}"), F.max(col).alias(f"max_{col}"))


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, null_count) in one pass."""
    cols = cols or df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "null_count")


def _unpivot_stats(wide: DataFrame, cols: list[str], stats: list[str]) -> DataFrame:
    """Wide row with ``<stat>__<col>`` fields -> one row per column."""
    structs = [F.struct(F.lit(c).alias("column"), *[F.col(f"{s}__{c}").alias(s) for s in stats]) for c in cols]
    return wide.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


#: Ranges that the distinct values of a column are cut into for the selection of order statistics.
RANGES = 256


def _number(c: str):
    """A column as double, NaN as NULL: a missing value is neither counted nor ranked."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def quantiles(df: DataFrame, cols: list[str], qs: list[float], ranges: int = RANGES) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of each column, one method at any size.

    Rows are counted by distinct value first (combined before the shuffle, so a value that most rows have is one
    row); the counts are written once. The distinct values are cut into ranges at approximate quantiles, the ranges'
    sums tell which of them hold the wanted positions, and only in those are the counts summed up in order.
    To the driver come ``ranges`` sums and a few values for each column.
    """
    spark = df.sparkSession
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), _number(c).alias("v")) for i, c in enumerate(cols)])
    counts = (df.select(F.explode(pairs).alias("p")).select("p.*").where("v IS NOT NULL")
              .groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")))
    path = scratch_path(spark, "counts")
    counts.write.parquet(path)
    stored = spark.read.schema(counts.schema).parquet(path)
    cuts = {r.i: sorted(set(r.s)) for r in stored.groupBy("i").agg(
        F.percentile_approx("v", [k / ranges for k in range(1, ranges)], 10_000).alias("s")).collect()}
    part = F.lit(0)
    for i, c in cuts.items():
        below = F.size(F.filter(F.array(*[F.lit(x) for x in c]), lambda x: x < F.col("v")))
        part = F.when(F.col("i") == i, below).otherwise(part)
    parted = stored.withColumn("part", part)
    sums: dict[int, dict[int, int]] = {}
    for r in parted.groupBy("i", "part").agg(F.sum("n").alias("n")).collect():
        sums.setdefault(r.i, {})[r.part] = r.n
    wanted: dict[int, list[tuple[int, int, float]]] = {}  # by column: positions below and above each quantile, and between
    places: dict[tuple[int, int], list[int]] = {}  # by column and range: positions in the range
    owner: dict[tuple[int, int], tuple[int, int]] = {}
    for i, own in sums.items():
        n = sum(own.values())
        for q in qs:
            h = (n - 1) * q
            low = int(h)
            wanted.setdefault(i, []).append((low, min(low + 1, n - 1), h - low))
        for pos in {x for w in wanted[i] for x in w[:2]}:
            before = 0
            for k in sorted(own):
                if pos < before + own[k]:
                    places.setdefault((i, k), []).append(pos - before)
                    owner[i, pos] = (k, pos - before)
                    break
                before += own[k]
    found: dict[tuple[int, int, int], float] = {}
    if places:
        keys = spark.createDataFrame([(i, k, sorted(v)) for (i, k), v in places.items()], "i int, part int, at array<bigint>")
        order = Window.partitionBy("i", "part").orderBy("v")
        # two positions for each column and quantile at most
        upto = parted.join(F.broadcast(keys), ["i", "part"]).withColumn("to", F.sum("n").over(order))
        hit = upto.select("i", "part", "v", F.explode(F.filter("at", lambda x: (x < F.col("to")) & (x >= F.col("to") - F.col("n")))).alias("at"))
        found = {(r.i, r.part, r.at): r.v for r in hit.collect()}
    fs.delete(spark, path)
    out = {}
    for i, c in enumerate(cols):
        at = lambda pos, i=i: found[(i, *owner[i, pos])]
        out[c] = [at(lo) + (at(hi) - at(lo)) * part for lo, hi, part in wanted[i]] if i in wanted else [None for _ in qs]
    return out


def _quartiles(df: DataFrame, cols: list[str], exact: bool) -> dict[str, list[float | None]]:
    qs = [0.25, 0.5, 0.75]
    if exact:
        return quantiles(df, cols, qs)
    row = df.agg(*[F.percentile_approx(_number(c), qs, 10_000).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    return {c: list(row[f"q{i}"] or [None] * 3) for i, c in enumerate(cols)}


def describe(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """count, mean, std, min, 25%, 50%, 75%, max per column, linear-interpolated quartiles like ``pandas.describe``.

    NaN counts as missing. ``exact=False`` takes the quartiles from ``percentile_approx``.
    """
    fixed = _quartiles(df, cols, exact)
    aggs = []
    for c in cols:
        x = _number(c)
        aggs += [F.count(x).alias(f"count__{c}"), F.avg(x).alias(f"mean__{c}"), F.stddev_samp(x).alias(f"std__{c}"),
                 F.min(x).alias(f"min__{c}"), F.max(x).alias(f"max__{c}")]
    wide = df.agg(*aggs).withColumns({f"p{p}__{c}": F.lit(v).cast("double") for c in cols for p, v in zip((25, 50, 75), fixed[c])})
    return _unpivot_stats(wide, cols, ["count", "mean", "std", "min", "p25", "p50", "p75", "max"])


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation, long form (col_a, col_b, corr), full square matrix.

    One aggregate computes each unordered pair once; a single ``stack``
    projection emits both orders and the unit diagonal.
    """
    df = df.select(*[_number(c).alias(c) for c in cols])  # NaN is missing
    aggs = [F.expr(f"corr(`{a}`, `{b}`)").alias(f"c{i}_{j}")
            for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    wide = df.agg(*aggs) if aggs else df.agg(F.count(F.lit(1)).alias("_n"))
    triples = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            v = "1.0D" if i == j else f"c{min(i, j)}_{max(i, j)}"
            triples.append(f"'{a}', '{b}', {v}")
    return wide.selectExpr(f"stack({len(triples)}, {', '.join(triples)}) AS (col_a, col_b, corr)")


def _bounds(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.min(_number(c)).alias(f"lo__{c}") for c in cols], *[F.max(_number(c)).alias(f"hi__{c}") for c in cols])


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value) pairs, nulls dropped; a narrow explode, no shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("value").isNotNull() & ~F.isnan("value"))


def histogram(df: DataFrame, cols: list[str], bins: int = 10) -> DataFrame:
    """Equal-width histogram per column over [min, max]; the max lands in the last bin.

    The one-row bounds table is broadcast (size fixed by the column count).
    """
    lo_hi = _bounds(df, cols)
    bounds = lo_hi.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"lo__{c}").alias("lo"), F.col(f"hi__{c}").alias("hi"))
        for c in cols])).alias("b")).select("b.*")
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    raw_bin = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.floor((F.col("value") - F.col("lo")) / width).cast("int"))
    b = F.least(raw_bin, F.lit(bins - 1))
    j = _long(df, cols).join(F.broadcast(bounds), "column")
    counted = j.groupBy("column", b.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("count"))
    return counted.select(
        "column", "bin",
        (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / F.lit(float(bins))).alias("bin_lo"),
        (F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / F.lit(float(bins))).alias("bin_hi"),
        "count")


def kde(df: DataFrame, cols: list[str], grid: int = 50, bins: int = 512) -> DataFrame:
    """Gaussian kernel density per column on ``grid`` points over [min, max].

    Scott's bandwidth ``1.06 * std * n^(-1/5)``. Values are first binned to
    ``bins`` centres (a hash aggregate), so the kernel sum costs bins x grid
    per column whatever the row count; the bin/grid pairing is a
    fixed-size explode on each (small) bin row, never a cross join of data.
    """
    stats = df.agg(*[F.min(_number(c)).alias(f"lo__{c}") for c in cols], *[F.max(_number(c)).alias(f"hi__{c}") for c in cols],
                   *[F.stddev_samp(_number(c)).alias(f"sd__{c}") for c in cols], *[F.count(_number(c)).alias(f"n__{c}") for c in cols])
    per_col = stats.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"lo__{c}").alias("lo"), F.col(f"hi__{c}").alias("hi"),
                 F.col(f"sd__{c}").alias("sd"), F.col(f"n__{c}").alias("n")) for c in cols])).alias("s")).select("s.*")
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    binned = (_long(df, cols).join(F.broadcast(per_col), "column")
              .withColumn("bin", F.least(F.when(step == 0, F.lit(0)).otherwise(
                  F.floor((F.col("value") - F.col("lo")) / step).cast("int")), F.lit(bins - 1)))
              .groupBy("column", "lo", "hi", "sd", "n", "bin").agg(F.count(F.lit(1)).alias("w")))
    centre = F.col("lo") + (F.col("bin") + F.lit(0.5)) * step
    bw = F.lit(1.06) * F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    g = F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("g")
    pts = binned.select("*", centre.alias("c"), bw.alias("bw"), g)
    x = F.col("lo") + F.col("g") * (F.col("hi") - F.col("lo")) / F.lit(float(grid - 1))
    z = (x - F.col("c")) / F.col("bw")
    dens = F.col("w") * F.exp(F.lit(-0.5) * z * z) / (F.col("n") * F.col("bw") * F.lit(math.sqrt(2 * math.pi)))
    return (pts.where(F.col("bw") > 0).groupBy("column", "g").agg(F.first(x).alias("x"), F.sum(dens).alias("density"))
               .select("column", F.col("g").alias("point"), "x", "density"))


def box_stats(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """Quartiles as in ``describe``, 1.5*IQR whiskers (most extreme values inside the fences) and outlier counts."""
    fixed = _quartiles(df, cols, exact)
    fences = df.sparkSession.createDataFrame([(c, *fixed[c]) for c in cols], "column string, q1 double, median double, q3 double")
    iqr = F.col("q3") - F.col("q1")
    lo_f = F.col("q1") - F.lit(1.5) * iqr
    hi_f = F.col("q3") + F.lit(1.5) * iqr
    v = F.col("value")
    inside = (v >= lo_f) & (v <= hi_f)
    j = _long(df, cols).join(F.broadcast(fences), "column")
    return j.groupBy("column", "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("whisker_lo"),
        F.max(F.when(inside, v)).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))


__all__ = ["category_counts", "value_range", "null_counts", "quantiles", "describe", "correlation_matrix",
           "histogram", "kde", "box_stats"]
