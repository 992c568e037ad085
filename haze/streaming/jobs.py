"""Structured Streaming forms of the hourly jobs.

J1a  landing stream: payload files -> rows -> keyed append, late files included
J1b  feature increment: new raw rows + per-city history -> features -> keyed append
     (a batch function; also usable as a ``foreachBatch`` body)
J2   daily mean AQI alerts: tumbling local-day windows, as a stream (days that the
     watermark has closed) and as a batch (every day)

Event time on streams must be TIMESTAMP (watermarks reject TIMESTAMP_NTZ),
so the UTC wall clock is turned into an instant with exact integer math,
independent of the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.schemas import HAZARD_THRESHOLD, HISTORY_ROWS

EPOCH_NTZ = "1970-01-01 00:00:00"


def ntz_to_instant(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), col))


def instant_to_ntz(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.lit(EPOCH_NTZ).cast("timestamp_ntz") + F.make_dt_interval(secs=F.unix_micros(col) / F.lit(1_000_000))


def landing_stream(spark: SparkSession, landing: str, sink: str, checkpoint: str, measures: list[str],
                   whole_file: bool = True, source_tz: str = "UTC"):
    """Start the J1a query (availableNow trigger); returns the StreamingQuery.

    Each micro batch is a keyed append to the table at ``sink``, so a key is
    stored once, a batch that is run again adds nothing, and a late file, however
    old, is stored like any other: there is no watermark to drop it.
    ``whole_file``: one JSON document per file (landed API responses);
    False reads one document per line.
    """
    from haze.sources.payload import parse_payloads

    texts = spark.readStream.format("text").option("wholetext", whole_file).load(landing)
    table = landed_table(spark, sink, measures)
    return (parse_payloads(texts, measures, source_tz=source_tz).writeStream
            .foreachBatch(lambda rows, _: table.append(rows) and None)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def landed_table(spark: SparkSession, sink: str, measures: list[str]):
    """The keyed table that ``landing_stream`` writes."""
    from haze.sources.store import FeatureTable

    return FeatureTable(spark, sink, name="landed", columns=["timestamp", "city", "latitude", "longitude", *measures])


def with_history(new_raw: DataFrame, history_raw: DataFrame, n: int = HISTORY_ROWS) -> DataFrame:
    """Prepend the last ``n`` valid history rows per city (before the batch's first hour).

    The history is cut per city by ``tail_rows`` (a widening time floor, then
    a top-n window over the few rows above it), so no task sorts a city's
    whole history.
    """
    from haze.operators.series import tail_rows

    first = new_raw.groupBy("city").agg(F.min("timestamp").alias("_bound"))
    tail = tail_rows(history_raw, n, "city", "timestamp", before=first)
    return tail.withColumn("_hist", F.lit(True)).unionByName(new_raw.withColumn("_hist", F.lit(False)))


def feature_increment(new_scored: DataFrame, history_scored: DataFrame, table, n: int = HISTORY_ROWS,
                      fill: str = "none") -> int:
    """J1b: features for the new rows computed with history, then a keyed append.

    Back-fill needs later rows, so incremental runs default to ``fill="none"``;
    training-time reads may fill. Returns the number of appended rows.
    """
    from haze.operators.series import full_features

    both = with_history(new_scored, history_scored, n)
    feats = full_features(both, fill=fill).where(~F.col("_hist")).drop("_hist")
    return table.append(feats)


def daily_alerts_stream(scored_stream: DataFrame, threshold: float = HAZARD_THRESHOLD,
                        watermark: str = "1 day", utc_offset_hours: int = 5, only_alerts: bool = False) -> DataFrame:
    """Daily mean AQI per city on local (fixed-offset) days, emitted once the
    watermark passes the day's end, with ``alert`` = mean above ``threshold``
    (``only_alerts`` keeps just the hazard days)."""
    start = f"{(24 - utc_offset_hours) % 24} hours"
    ev = scored_stream.withColumn("event_time", ntz_to_instant("timestamp"))
    agg = (ev.withWatermark("event_time", watermark)
             .groupBy("city", F.window("event_time", "1 day", startTime=start).alias("w"))
             .agg(F.avg("AQI").alias("mean_aqi"), F.count(F.lit(1)).alias("n_hours")))
    out = agg.select("city", instant_to_ntz(F.col("w.start")).alias("day_start_utc"), "mean_aqi", "n_hours",
                     (F.col("mean_aqi") > F.lit(float(threshold))).alias("alert"))
    return out.where(F.col("alert")) if only_alerts else out


def daily_alerts(scored: DataFrame, threshold: float = HAZARD_THRESHOLD, utc_offset_hours: int = 5,
                 only_alerts: bool = False) -> DataFrame:
    """The batch twin of ``daily_alerts_stream``: every local day with any hour, the last ones included."""
    shift = F.make_dt_interval(hours=F.lit(utc_offset_hours))
    day = F.to_date(F.col("timestamp") + shift).cast("timestamp_ntz") - shift
    agg = scored.groupBy("city", day.alias("day_start_utc")).agg(F.avg("AQI").alias("mean_aqi"), F.count(F.lit(1)).alias("n_hours"))
    out = agg.withColumn("alert", F.col("mean_aqi") > F.lit(float(threshold)))
    return out.where(F.col("alert")) if only_alerts else out
