"""Per-key series operators: lags, differences, rolling statistics, fills,
trends, last rows and a distributed global row index.

All windows of one series share one spec, ``partitionBy(key).orderBy(ts)``,
so a whole feature set costs one hash exchange; the descending spec used by
the back-fill reuses that exchange (only the in-partition sort differs).

Frames never end in UNBOUNDED FOLLOWING: such frames are re-evaluated per
row (quadratic in the group size). Back-fill is a running ``last`` over the
descending order instead.

Hourly series are short per key (about 8.8k rows per city-year), so the
key alone partitions well. For keys with a large share of all rows the caller
asks for ``bucketed_features``, which splits the series into fixed-size row buckets with a
halo of the preceding rows, computes the same columns per bucket and drops
the halo, which is exact for frames reaching back at most ``halo`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haze.functions.timefeat import calendar_columns
from haze.schemas import LAG_MEASURES, LAGS, RATIO_EPS, ROLL_WINDOW, ROLLING_MEASURES


def series_window(key: str | list[str] = "city", ts: str = "timestamp", tiebreak: list[str] | None = None):
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(F.col(ts).asc(), *[F.col(c).asc() for c in (tiebreak or [])])


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def over(key, ts, frame: str | None = None, desc: bool = False) -> str:
    """OVER clause text for one series window (a single expression per column keeps
    plan construction to one call per feature)."""
    part = ", ".join(f"`{k}`" for k in _keys(key))
    order = f"`{ts}` {'DESC' if desc else 'ASC'}"
    return f"OVER (PARTITION BY {part} ORDER BY {order}{' ' + frame if frame else ''})"


def _rows(lo: int, hi: int) -> str:
    def b(x):
        if x == 0:
            return "CURRENT ROW"
        return f"{-x} PRECEDING" if x < 0 else f"{x} FOLLOWING"
    return f"ROWS BETWEEN {b(lo)} AND {b(hi)}"


def _desc_window(key, ts, tiebreak=None):
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(F.col(ts).desc(), *[F.col(c).desc() for c in (tiebreak or [])])


# ---------------------------------------------------------------- F1, F2
def lag_columns(measures=None, lags=None, key="city", ts="timestamp", by: str = "rows") -> dict[str, Column]:
    """Values ``k`` rows earlier; with ``by="time"`` those of exactly ``k`` hours earlier, NULL in a gap."""
    measures, lags = measures or LAG_MEASURES, lags or LAGS
    if by == "rows":
        o = over(key, ts)
        return {f"{m}_lag_{k}h": F.expr(f"lag(`{m}`, {k}) {o}") for m in measures for k in lags}
    part = ", ".join(f"`{k}`" for k in _keys(key))
    frame = lambda k: (f"OVER (PARTITION BY {part} ORDER BY {_seconds(ts)} "  # noqa: E731
                       f"RANGE BETWEEN {k * 3600} PRECEDING AND {k * 3600} PRECEDING)")
    return {f"{m}_lag_{k}h": F.expr(f"last(`{m}`) {frame(k)}") for m in measures for k in lags}


def _seconds(ts: str) -> str:
    return f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{ts}`)"


def diff_columns(pairs: dict[str, str] | None = None, key="city", ts="timestamp") -> dict[str, Column]:
    pairs = pairs or {"temperature_change": "temperature_2m", "wind_speed_change": "wind_speed_10m"}
    o = over(key, ts)
    return {name: F.expr(f"`{src}` - lag(`{src}`, 1) {o}") for name, src in pairs.items()}


# ---------------------------------------------------------------- F3, F4
def rolling_columns(measures=None, window: int = ROLL_WINDOW, key="city", ts="timestamp",
                    by: str = "rows") -> dict[str, Column]:
    """Trailing mean / sample std / max over the previous ``window`` rows (current row excluded).

    ``by="time"`` uses a range frame of ``window`` hours on epoch seconds instead.
    """
    keys = _keys(key)
    if by == "rows":
        o = over(key, ts, _rows(-window, -1))
    else:
        part = ", ".join(f"`{k}`" for k in keys)
        o = f"OVER (PARTITION BY {part} ORDER BY {_seconds(ts)} RANGE BETWEEN {window * 3600} PRECEDING AND 1 PRECEDING)"
    out = {}
    for m in measures or ROLLING_MEASURES:
        out[f"{m}_rolling_mean_{window}h"] = F.expr(f"avg(`{m}`) {o}")
        out[f"{m}_rolling_std_{window}h"] = F.expr(f"stddev_samp(`{m}`) {o}")
        out[f"{m}_rolling_max_{window}h"] = F.expr(f"max(`{m}`) {o}")
    return out


def moving_average(col: str, window: int = 24, key="city", ts="timestamp") -> Column:
    """Mean over the last ``window`` rows including the current one; NULL until
    ``window`` non-null values are present (pandas ``rolling(window).mean()``)."""
    o = over(key, ts, _rows(-(window - 1), 0))
    return F.expr(f"CASE WHEN count(`{col}`) {o} >= {window} THEN avg(`{col}`) {o} END")


# ---------------------------------------------------------------- F5
def fill_both(df: DataFrame, cols: list[str] | None = None, key="city", ts="timestamp",
              tiebreak: list[str] | None = None) -> DataFrame:
    """Back-fill then forward-fill within each key: coalesce(v, next non-null, previous non-null)."""
    keys = _keys(key)
    targets = cols if cols is not None else [c for c in df.columns if c not in keys and c != ts]
    if tiebreak:
        asc = series_window(key, ts, tiebreak).rowsBetween(Window.unboundedPreceding, 0)
        desc = _desc_window(key, ts, tiebreak).rowsBetween(Window.unboundedPreceding, 0)
        fills = {c: F.coalesce(F.col(c), F.last(c, ignorenulls=True).over(desc),
                               F.last(c, ignorenulls=True).over(asc)) for c in targets}
        return df.withColumns(fills)
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    o_desc, o_asc = over(key, ts, frame, desc=True), over(key, ts, frame)
    return df.withColumns({c: F.expr(f"coalesce(`{c}`, last(`{c}`, true) {o_desc}, last(`{c}`, true) {o_asc})")
                           for c in targets})


# ---------------------------------------------------------------- F9
def interaction_columns() -> dict[str, Column]:
    return {
        "pm2_5_pm10_ratio": F.expr(f"try_divide(pm2_5, pm10 + {RATIO_EPS!r}D)"),
        "temperature_humidity_interaction": F.expr("temperature_2m * relative_humidity_2m"),
        "wind_pressure_interaction": F.expr("wind_speed_10m * surface_pressure"),
    }


def derived_columns(key="city", ts="timestamp", by: str = "rows") -> dict[str, Column]:
    cols = {}
    cols.update(rolling_columns(key=key, ts=ts, by=by))
    cols.update(diff_columns(key=key, ts=ts))
    cols.update(interaction_columns())
    cols.update(lag_columns(key=key, ts=ts, by=by))
    return cols


def full_features(scored: DataFrame, key="city", ts="timestamp", fill: str = "all",
                  by: str = "rows") -> DataFrame:
    """Calendar + cyclic + rolling + diff + interaction + lag features, then fill.

    ``scored`` carries AQI already. ``fill``: ``"all"`` back/forward-fills
    every non-key column (source behaviour), ``"derived"`` only the
    window-derived ones, ``"none"`` leaves NULLs.
    """
    derived = derived_columns(key, ts, by)
    out = scored.withColumns(calendar_columns(ts)).withColumns(derived)
    if fill == "all":
        out = fill_both(out, key=key, ts=ts)
    elif fill == "derived":
        out = fill_both(out, cols=list(derived), key=key, ts=ts)
    return out


# ---------------------------------------------------------------- halo buckets
def row_positions(df: DataFrame, key="city", ts="timestamp", granularity: str = "day") -> DataFrame:
    """Exact per-key row position (0-based, ordered by ts) without sorting a whole key in one task.

    Rows are numbered inside (key, time bucket) partitions; the same window
    gives each bucket's size. The per-bucket sizes (one row per bucket, taken
    from that same windowed frame, so its exchange is reused rather than
    re-reading the input) are turned into starting offsets with a window over
    the small bucket table and joined back.
    """
    keys = [key] if isinstance(key, str) else list(key)
    b = F.date_trunc(granularity, F.col(ts).cast("timestamp"))
    iw = Window.partitionBy(*keys, "_tb").orderBy(ts)
    cw = Window.partitionBy(*keys, "_tb")
    numbered = (df.withColumn("_tb", b)
                  .withColumn("_rn", F.row_number().over(iw))
                  .withColumn("_cnt", F.count(F.lit(1)).over(cw)))
    ow = Window.partitionBy(*keys).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (numbered.where(F.col("_rn") == 1).select(*keys, "_tb", "_cnt")
                       .withColumn("_off", F.coalesce(F.sum("_cnt").over(ow), F.lit(0))).drop("_cnt"))
    return (numbered.join(offsets, on=[*keys, "_tb"])
                    .withColumn("_pos", F.col("_off") + F.col("_rn") - 1)
                    .drop("_off", "_tb", "_rn", "_cnt"))


def bucketed_features(scored: DataFrame, bucket_rows: int = 4096, halo: int = ROLL_WINDOW,
                      key="city", ts="timestamp", fill: str = "none") -> DataFrame:
    """Skew-proof F1-F3 (+ calendar, interactions, optional fill): each task sees at
    most ``bucket_rows + halo`` rows of one key, whatever the key's share of data.

    A row in the last ``halo`` positions of its bucket is also emitted (by an
    ``explode``, in the same pass) as a halo row of the next bucket. Exact for
    frames reaching back at most ``halo`` rows (lag 24, rolling 24).
    ``fill="all"`` / ``"derived"`` back/forward-fills across bucket borders
    with ``bucketed_fill`` (exact, also skew-proof).
    """
    if bucket_rows < halo:
        raise ValueError(f"buckets of {bucket_rows} rows are shorter than the halo of {halo}: frames would reach past one bucket")
    keys = _keys(key)
    pos = row_positions(scored, key, ts)
    bucket = F.floor(F.col("_pos") / bucket_rows)
    in_tail = (F.col("_pos") % bucket_rows) >= bucket_rows - halo
    copies = F.when(in_tail, F.array(F.struct(bucket.alias("b"), F.lit(False).alias("h")),
                                     F.struct((bucket + 1).alias("b"), F.lit(True).alias("h")))) \
              .otherwise(F.array(F.struct(bucket.alias("b"), F.lit(False).alias("h"))))
    both = (pos.withColumn("_c", F.explode(copies))
               .withColumn("_bucket", F.col("_c.b")).withColumn("_halo", F.col("_c.h")).drop("_c"))
    derived = derived_columns(key=[*keys, "_bucket"], ts="_pos")
    out = both.withColumns(calendar_columns(ts)).withColumns(derived).where(~F.col("_halo")).drop("_halo")
    if fill != "none":
        targets = list(derived) if fill == "derived" else \
            [c for c in out.columns if c not in keys and c not in (ts, "_bucket", "_pos")]
        out = bucketed_fill(out, targets, keys, "_bucket", "_pos")
    return out.drop("_bucket", "_pos")


def bucketed_fill(df: DataFrame, cols: list[str], keys: list[str], bucket: str, pos: str) -> DataFrame:
    """Back-fill then forward-fill across row buckets without a per-key window.

    Inside a bucket: running ``last`` over (key, bucket) in both directions.
    Across buckets: each bucket's first and last non-null value per column
    (one aggregate row per bucket), carried with windows over the small
    bucket table, then joined back on (key, bucket).
    """
    part = ", ".join(f"`{k}`" for k in [*keys, bucket])
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    o_desc = f"OVER (PARTITION BY {part} ORDER BY `{pos}` DESC {frame})"
    o_asc = f"OVER (PARTITION BY {part} ORDER BY `{pos}` ASC {frame})"
    summary = df.groupBy(*keys, bucket).agg(
        *[F.expr(f"min_by(`{c}`, CASE WHEN `{c}` IS NOT NULL THEN `{pos}` END)").alias(f"_first_{c}") for c in cols],
        *[F.expr(f"max_by(`{c}`, CASE WHEN `{c}` IS NOT NULL THEN `{pos}` END)").alias(f"_last_{c}") for c in cols])
    kp = ", ".join(f"`{k}`" for k in keys)
    before = f"OVER (PARTITION BY {kp} ORDER BY `{bucket}` ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    after = f"OVER (PARTITION BY {kp} ORDER BY `{bucket}` DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carries = summary.select(*keys, bucket,
                             *[F.expr(f"last(`_last_{c}`, true) {before}").alias(f"_prev_{c}") for c in cols],
                             *[F.expr(f"last(`_first_{c}`, true) {after}").alias(f"_next_{c}") for c in cols])
    j = df.join(carries, on=[*keys, bucket])
    filled = {c: F.expr(f"coalesce(`{c}`, last(`{c}`, true) {o_desc}, `_next_{c}`, "
                        f"last(`{c}`, true) {o_asc}, `_prev_{c}`)") for c in cols}
    return j.withColumns(filled).drop(*[f"_prev_{c}" for c in cols], *[f"_next_{c}" for c in cols])


def tail_rows(df: DataFrame, n: int, key="city", ts="timestamp", before=None,
              granularity: str = "day") -> DataFrame:
    """The last ``n`` rows per key (optionally before a per-key or global bound), exactly.

    Rows are counted per (key, day) with a hash aggregate; a descending
    running sum over that small count table gives, per key, the earliest day
    still needed to reach ``n`` rows. Only rows from that day on reach the
    ranking window, so a key with a huge history never sorts it all in one
    task, and no driver round trips are needed.
    """
    keys = _keys(key)
    src = df
    if before is not None:
        if isinstance(before, DataFrame):  # per-key bound: columns keys + "_bound"
            src = src.join(before, on=keys).where(F.col(ts) < F.col("_bound")).drop("_bound")
        else:
            src = src.where(F.col(ts) < before)
    day = F.date_trunc(granularity, F.col(ts).cast("timestamp"))
    counts = src.groupBy(*keys, day.alias("_day")).agg(F.count(F.lit(1)).alias("_c"))
    kp = ", ".join(f"`{k}`" for k in keys)
    running = F.expr(f"sum(_c) OVER (PARTITION BY {kp} ORDER BY _day DESC "
                     f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    floors = (counts.withColumn("_cum", running)
                    .where(F.col("_cum") - F.col("_c") < n)   # days still needed before reaching n rows
                    .groupBy(*keys).agg(F.min("_day").alias("_floor")))
    cand = src.join(floors, on=keys).where(day >= F.col("_floor")).drop("_floor")
    w = f"OVER (PARTITION BY {kp} ORDER BY `{ts}` DESC)"
    return cand.withColumn("_rn", F.expr(f"row_number() {w}")).where(F.col("_rn") <= n).drop("_rn")


# ---------------------------------------------------------------- F6, F7
def last_row(df: DataFrame, key="city", ts="timestamp") -> DataFrame:
    """Latest row per key: one ``max_by`` over the whole row, combined before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ts)).alias("_r"))
              .select(*keys, "_r.*"))


def recent_trend(df: DataFrame, cols: list[str], n: int = 24, key="city", ts="timestamp") -> DataFrame:
    """(last - first) / rows over the last ``n`` rows per key."""
    keys = _keys(key)
    recent = tail_rows(df.select(*keys, ts, *cols), n, key, ts)
    aggs = [F.expr("count(1)").alias("n_rows")]
    aggs += [F.expr(f"(max_by(`{c}`, `{ts}`) - min_by(`{c}`, `{ts}`)) / count(1)").alias(f"{c}_trend") for c in cols]
    return recent.groupBy(*keys).agg(*aggs)


# ---------------------------------------------------------------- F8
def global_row_index(df: DataFrame, order: list[str], n_parts: int | None = None,
                     index_col: str = "row_idx") -> DataFrame:
    """0-based position of each row in the total order ``order``, computed without a single-partition window.

    The frame is range-partitioned on ``order`` (plus a row hash so that a
    hot key can be split), checkpointed to the shared checkpoint folder so
    partition contents are stable, numbered inside partitions, and shifted
    by the sizes of all earlier partitions (one small count per partition).
    """
    from haze.session import ensure_checkpoint_dir

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    tie = F.xxhash64(*[F.col(c) for c in df.columns]).alias("_tie")
    keyed = df.withColumn("_tie", tie)
    order_cols = [*[F.col(c) for c in order], F.col("_tie")]
    # without an explicit count AQE sizes the ranges from the data (coalescing only adjacent
    # ranges, so the order across partition ids is kept); n_parts pins it when given
    ranged = keyed.repartitionByRange(n_parts, *order_cols) if n_parts else keyed.repartitionByRange(*order_cols)
    ranged = (ranged.sortWithinPartitions(*order, "_tie")
                    .withColumn("_mid", F.monotonically_increasing_id())
                    .checkpoint(eager=True))
    pid = F.shiftright(F.col("_mid"), 33)
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    # one count per partition (n values, bounded by the partition count, not the data)
    sizes = dict(ranged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_c")).collect())
    offsets, run = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(run)
        run += sizes.get(p, 0)
    table = F.array(*[F.lit(o).cast("bigint") for o in offsets]) if offsets else F.array(F.lit(0).cast("bigint"))
    return (ranged.withColumn(index_col, F.element_at(table, (pid + 1).cast("int")) + local)
                  .drop("_mid", "_tie"))


def time_split(df: DataFrame, order: list[str] | None = None, n_splits: int = 3, fold: int | None = None,
               index_col: str = "row_idx") -> DataFrame:
    """Expanding-window split (train on the past, test on the next block).

    ``fold`` = 0-based fold number (default: the last). Adds ``split`` =
    'train' / 'test' and drops rows after the test block.
    """
    order = order or ["timestamp", "city"]
    indexed = global_row_index(df, order, index_col=index_col)
    n = indexed.count()
    test_size = n // (n_splits + 1)
    k = n_splits - 1 if fold is None else fold
    test_start = n - (n_splits - k) * test_size
    idx = F.col(index_col)
    return (indexed.where(idx < test_start + test_size)
                   .withColumn("split", F.when(idx < test_start, F.lit("train")).otherwise(F.lit("test"))))
