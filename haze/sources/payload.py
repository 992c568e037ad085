"""Landed hourly JSON payloads (parallel arrays) to rows, and back.

A payload is one JSON object per city and fetch:
``{"city":..., "latitude":..., "longitude":..., "hourly": {"time": [...], "<measure>": [...], ...}}``.
Parsing is ``from_json`` with an explicit schema + ``inline(arrays_zip(...))``:
all JVM-side, one narrow stage, no shuffle. A payload without ``hourly``
or without ``time`` yields no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.schemas import payload_schema


TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss")


def parse_time(text: Column, source_tz: str = "UTC", formats: tuple[str, ...] = TIME_FORMATS) -> Column:
    """Time text in any of the forms, as UTC wall clock; NULL where none fits. ``source_tz`` is the zone of the texts."""
    local = F.coalesce(*[F.try_to_timestamp(F.concat(text, F.lit(" UTC")), F.lit(f"{f} VV")) for f in formats])
    ntz = _as_ntz(local)
    return ntz if source_tz == "UTC" else F.convert_timezone(F.lit(source_tz), F.lit("UTC"), ntz)


def _as_ntz(instant: Column) -> Column:
    """An instant as UTC wall clock, whatever the session's zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=F.unix_micros(instant) / F.lit(1_000_000))


def parse_payloads(texts: DataFrame, measures: list[str], text_col: str = "value", source_tz: str = "UTC",
                   keep_unparsed: bool = False) -> DataFrame:
    """JSON text column -> (timestamp, city, latitude, longitude, measures...).

    Rows whose time text fits no known form are left out; ``keep_unparsed`` keeps them, with a NULL timestamp and
    the text as ``time_text``, for ``unparsed_times``.
    """
    p = F.from_json(F.col(text_col), payload_schema(measures)).alias("p")
    keep = ["_src"] if "_src" in texts.columns else []
    parsed = texts.select(p, *keep).where(F.col("p.hourly.time").isNotNull())
    n = F.size(F.col("p.hourly.time"))
    # a measure absent from the payload is all-null (arrays_zip would return NULL for the whole row set)
    arrays = [F.col("p.hourly.time").alias("time")] + [
        F.coalesce(F.col(f"p.hourly.{m}"), F.array_repeat(F.lit(None).cast("double"), n)).alias(m) for m in measures]
    src = [F.col("_src")] if keep else []
    rows = parsed.select(F.col("p.city").alias("city"), F.col("p.latitude").alias("latitude"),
                         F.col("p.longitude").alias("longitude"), *src,
                         F.posexplode(F.arrays_zip(*arrays)).alias("_i", "z"))
    seq = [F.struct(F.col("_src"), F.col("_i")).alias("ingest_seq")] if src else []
    text = [F.col("z.time").alias("time_text")] if keep_unparsed else []
    out = rows.select(parse_time(F.col("z.time"), source_tz).alias("timestamp"), "city", "latitude", "longitude",
                      *[F.when(~F.isnan(F.col(f"z.{m}")), F.col(f"z.{m}")).alias(m) for m in measures], *seq, *text)
    return out if keep_unparsed else out.where(F.col("timestamp").isNotNull())


def unparsed_times(texts: DataFrame, measures: list[str], text_col: str = "value") -> DataFrame:
    """Audit: (city, rows, unparsed_rows) of landed payloads, by city."""
    rows = parse_payloads(texts, measures, text_col, keep_unparsed=True)
    return rows.groupBy("city").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("timestamp").isNull()).alias("unparsed_rows"))


def read_payloads(spark: SparkSession, path: str, measures: list[str], whole_file: bool = True,
                  keep_order: bool = False, source_tz: str = "UTC") -> DataFrame:
    """Read landed payload files (one JSON document per file by default).

    ``keep_order`` adds ``ingest_seq`` = (file modification time, file path,
    array position): the arrival order used by keep-first deduplication.
    """
    texts = spark.read.text(path, wholetext=whole_file)
    if keep_order:
        texts = texts.withColumn("_src", F.struct(F.col("_metadata.file_modification_time").alias("mtime"),
                                                  F.col("_metadata.file_path").alias("path")))
    return parse_payloads(texts, measures, source_tz=source_tz)


def build_payloads(hourly: DataFrame, measures: list[str], group_by=("city",), period: str = "day") -> DataFrame:
    """Rows -> one payload per (city, period) as JSON text in column ``value``.

    Each payload gathers one period of one city (at most 24 hourly rows for
    ``day``), so no group is unbounded.
    """
    per = F.date_trunc(period, F.col("timestamp").cast("timestamp")).alias("_per")
    entries = F.sort_array(F.collect_list(F.struct(F.col("timestamp").alias("t"),
                                                   *[F.col(m) for m in measures])))
    g = (hourly.groupBy(*group_by, per)
               .agg(F.first("latitude").alias("latitude"), F.first("longitude").alias("longitude"),
                    entries.alias("e")))
    def field(name):
        return lambda x: x[name]

    hourly_struct = F.struct(
        F.transform("e", lambda x: F.date_format(x["t"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
        *[F.transform("e", field(m)).alias(m) for m in measures])
    return g.select(F.to_json(F.struct(F.col("city"), "latitude", "longitude",
                                       hourly_struct.alias("hourly"))).alias("value"))
