"""Streams with state: the air x weather join (D1 / J1a) and the feature stream (J1b).

``joined_stream``   two landing folders -> one stream-stream join -> keyed raw table; hours whose other
                    side hasn't come by the watermark -> a side table
``feature_stream``  raw rows -> the last rows of each city as keyed state -> features -> keyed append,
                    without reading the stored history

A micro batch is staged once (a second read would run its stateful part again) and written by keyed appends,
so a batch that is run again after a failure adds nothing. State is kept by Spark, in the folder of the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from haze.operators import clean, series
from haze.schemas import AIR_MEASURES, BASE_FEATURES, HISTORY_ROWS, WEATHER_MEASURES
from haze.session import scratch_path
from haze.sources import files, fs
from haze.sources.payload import parse_payloads
from haze.sources.store import FeatureTable
from haze.streaming.jobs import EPOCH_NTZ, instant_to_ntz, ntz_to_instant

PLACE = ["latitude", "longitude"]
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def staged(rows: DataFrame, spark: SparkSession, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path


@contextmanager
def starting(spark: SparkSession, settings: dict[str, str | int | None]) -> Iterator[None]:
    """Settings that a query reads when it starts (None: as they are), put back afterwards."""
    wanted = {k: str(v) for k, v in settings.items() if v is not None}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# ---------------------------------------------------------------- D1 / J1a
def unmatched_table(spark: SparkSession, path: str) -> FeatureTable:
    """Hours of one side only: ``side`` (air or weather) and that side's measures."""
    return FeatureTable(spark, path, name="unmatched", primary_key=("timestamp", "city", "side"),
                        columns=["timestamp", "city", "side", *PLACE, *BASE_FEATURES])


def joined_stream(spark: SparkSession, air_landing: str, weather_landing: str, raw_sink: str, unmatched_sink: str,
                  checkpoint: str, wait: str = "2 days", whole_file: bool = True, source_tz: str = "UTC", partitions: int | None = None):
    """Start the join of both landing folders (availableNow trigger); returns the StreamingQuery.

    Each side's first copy of a (city, hour) is joined with the other's, whichever lands first. The watermark is that of the
    side that is behind, less ``wait``, and moves in runs that have new files of both: join and copies keep state for hours after it
    only, however long the stream runs. An hour that it passes without its other side goes to ``unmatched_sink``; one that lands behind it is left
    to the batch job, which reads the landing folders whole (``jobs.hourly_ingest``), and an hour found in both tables is matched.
    ``partitions`` of the state are fixed by the first start (default: the session's shuffle partitions).
    """
    def side(landing: str, measures: list[str], prefix: str) -> DataFrame:
        texts = spark.readStream.format("text").option("wholetext", whole_file).load(landing)
        rows = parse_payloads(texts, measures, source_tz=source_tz)
        rows = rows.withColumn("at", ntz_to_instant("timestamp")).drop("timestamp")
        once = rows.withWatermark("at", wait).dropDuplicates(["city", "at"])
        return once.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ["city", "at", *PLACE, *measures]])

    air, weather = side(air_landing, AIR_MEASURES, "a"), side(weather_landing, WEATHER_MEASURES, "w")
    both = air.join(weather, (F.col("a_city") == F.col("w_city")) & (F.col("a_at") == F.col("w_at")), "full_outer")
    which = F.when(F.col("w_at").isNull(), "air").when(F.col("a_at").isNull(), "weather").otherwise("both")
    rows = both.select(instant_to_ntz(F.coalesce("a_at", "w_at")).alias("timestamp"), F.coalesce("a_city", "w_city").alias("city"),
                       which.alias("side"), *[F.coalesce(f"a_{c}", f"w_{c}").alias(c) for c in PLACE],
                       *[F.col(f"a_{c}").alias(c) for c in AIR_MEASURES], *[F.col(f"w_{c}").alias(c) for c in WEATHER_MEASURES])
    raw, unmatched = files.raw_table(spark, raw_sink), unmatched_table(spark, unmatched_sink)

    def write(batch: DataFrame, _: int) -> None:
        kept, path = staged(batch, spark, "joined")
        raw.append(kept.where("side = 'both'").drop("side"))
        unmatched.append(kept.where("side <> 'both'"))
        fs.delete(spark, path)

    with starting(spark, {PARTITIONS: partitions}):
        return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---------------------------------------------------------------- J1b
class LastRows(StatefulProcessor):
    """State of a city: its last ``n`` rows, of a key the least by its other columns.

    Gives the rows that were kept (``_hist``), then those of the batch that aren't among them, as they come, with ``_late`` for rows
    that aren't after all that earlier batches had. A batch of any size holds one Arrow batch and ``n`` rows in memory."""

    def __init__(self, n: int, schema: str, columns: list[str]):
        self.n, self.schema, self.columns = n, schema, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.schema)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        kept = pd.DataFrame([tuple(r) for r in self.rows.get()], columns=self.columns)
        known, newest = set(kept["micros"]), kept["micros"].max() if len(kept) else None
        if len(kept):
            yield self.marked(kept, key, True, False)
        for part in rows:
            part = part.loc[~part["micros"].isin(known), self.columns]  # landed again: stored by an earlier batch
            yield self.marked(part, key, False, part["micros"] <= newest if newest is not None else False)
            both = pd.concat([kept, part], ignore_index=True) if len(kept) else part
            # of rows with one time the least by the other columns, as in a keyed append
            kept = both.sort_values(self.columns, na_position="last").drop_duplicates("micros").tail(self.n)
        self.rows.put([tuple(None if pd.isna(v) else v for v in r) for r in kept.astype(object).itertuples(index=False)])

    def marked(self, rows, key, hist: bool, late):
        return rows.assign(city=key[0], _hist=hist, _late=late)

    def close(self) -> None:
        pass


def feature_stream(spark: SparkSession, raw_rows: DataFrame, raw: FeatureTable, table: FeatureTable, checkpoint: str,
                   n: int = HISTORY_ROWS, partitions: int | None = None):
    """Start J1b over a stream of raw rows (availableNow trigger); returns the StreamingQuery.

    The last ``n`` valid rows of each city are the query's state, so lags and rolling statistics of new hours need no read of
    the stored table. Rows go to ``raw`` too, a key once. For a city with a row that isn't newer than its state, the
    rows that it changes are made again from ``raw`` (``jobs.changed_rows``) and replaced, so the feature table equals a full
    recomputation without fill in whatever order hours come. Rows without an index are left out. ``partitions``: as in ``joined_stream``.
    """
    measures = [*PLACE, *BASE_FEATURES]
    us = F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), F.col("timestamp"))
    columns = ["micros", *measures]
    valid = clean.drop_missing(clean.with_aqi(clean.drop_missing(raw_rows.where("timestamp IS NOT NULL AND city IS NOT NULL"), ["pm2_5", "pm10"])), ["AQI"])
    # NaN is null from here on: pandas doesn't tell them apart
    rows = valid.select("city", us.alias("micros"), *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in measures])
    schema = "micros bigint, " + ", ".join(f"{c} double" for c in measures)
    with_state = rows.groupBy("city").transformWithStateInPandas(
        LastRows(n, schema, columns), outputStructType=f"{schema}, city string, _hist boolean, _late boolean",
        outputMode="Append", timeMode="None")

    def write(batch: DataFrame, _: int) -> None:
        kept, path = staged(batch.withColumn("timestamp", instant_to_ntz(F.timestamp_micros("micros"))).drop("micros"), spark, "features")
        write_features(spark, kept, raw, table, n)
        fs.delete(spark, path)

    with starting(spark, {STATE_STORE: ROCKS_DB, PARTITIONS: partitions}):
        return with_state.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_features(spark: SparkSession, kept: DataFrame, raw: FeatureTable, table: FeatureTable, n: int) -> None:
    """One batch of ``feature_stream``: rows of cities without late ones from the state, the others from the raw table."""
    from haze.plans import jobs

    new = clean.dedup_first(kept.where("NOT _hist").drop("_hist"))
    late = new.where("_late").groupBy("city").agg(F.min("timestamp").alias("since"))
    raw.append(new.drop("_late"))
    jobs.note_cities(raw, new)
    quiet = clean.with_aqi(new.drop("_late").withColumn("_hist", F.lit(False)).unionByName(
        kept.where("_hist").drop("_late")).join(late, "city", "left_anti"))
    table.append(series.full_features(quiet, fill="none").where("NOT _hist").drop("_hist"))
    since = late.agg(F.min("since")).first()[0]
    if since is None:
        return
    # with rows that were stored before, so that a batch that is run again mends what its first run didn't
    again = new.drop("_late").join(late, "city", "left_semi")
    changed, path = staged(jobs.changed_rows(raw.read(since), jobs.stored_history(raw, since, again, n), again, n), spark, "changed")
    table.replace(changed.drop("_fresh"))
    fs.delete(spark, path)


__all__ = ["LastRows", "feature_stream", "joined_stream", "unmatched_table", "write_features"]
