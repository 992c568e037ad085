"""Registered queries: feature table, landed payloads, CSV, unions, streams.

These write Spark-derived tables into fresh folders under the session's
shared checkpoint folder and read them back through the library's sources.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from haze.plans import common
from haze.plans.catalog import R, query, rounded
from haze.plans.oracle_base import AIR, BASE, CAL, DERIVED, SCORED, WEATHER, with_ctes
from haze.plans.q_series import FULL_CTES, NOFILL_SQL
from haze.schemas import AIR_MEASURES, BASE_FEATURES, FEATURES_ALL, FEATURES_STORED, RAW_SCHEMA, WEATHER_MEASURES
from haze.session import scratch_path
from haze.sources import files, fs, payload
from haze.sources.store import FeatureTable

STORED_DOUBLES = [c for c in FEATURES_STORED if c not in ("timestamp", "city", "AQI_Category")]


def _stored_sql(src: str = "feat", where: str = "") -> str:
    cols = ["timestamp", "city"] + [R(c) for c in STORED_DOUBLES] + ["AQI_Category"]
    return f"SELECT {', '.join(cols)} FROM {src} {where}"


def _table(spark, sf, name="store"):
    t = FeatureTable(spark, scratch_path(spark, name))
    t.append(common.features(spark, sf))
    return t


def _out(df):
    return rounded(df.select(*FEATURES_STORED))


RANGE_LO, RANGE_HI = dt.datetime(2024, 1, 10, 0, 0), dt.datetime(2024, 1, 20, 12, 0)


@query("store_range_scan", FULL_CTES + _stored_sql(
    where=f"WHERE timestamp >= TIMESTAMP '{RANGE_LO}' AND timestamp <= TIMESTAMP '{RANGE_HI}'"))
def q_store_range_scan(spark, sf):
    return _out(_table(spark, sf).read(RANGE_LO, RANGE_HI))


@query("backfill_range", FULL_CTES + _stored_sql(
    where="WHERE CAST((timestamp AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Karachi' AS DATE) "
          "BETWEEN DATE '2024-01-05' AND DATE '2024-01-07'"))
def q_backfill_range(spark, sf):
    return _out(_table(spark, sf).read_local_dates(dt.date(2024, 1, 5), dt.date(2024, 1, 7)))


@query("training_set", FULL_CTES + _stored_sql())
def q_training_set(spark, sf):
    return _out(_table(spark, sf).training_set())


@query("store_append", FULL_CTES + _stored_sql())
def q_store_append(spark, sf):
    """Append the first half, then everything (overlapping): each key is stored once."""
    t = FeatureTable(spark, scratch_path(spark, "append"))
    f = common.features(spark, sf)
    t.append(f.where(F.col("timestamp") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")))
    t.append(f)
    t.append(f)
    return _out(t.read())


@query("store_compact", FULL_CTES + """
SELECT CAST(timestamp AS DATE) AS event_date, COUNT(*) AS rows, COUNT(DISTINCT city) AS cities, true AS was_many, 1 AS files
FROM feat GROUP BY 1""")
def q_store_compact(spark, sf):
    """Appends of every third hour leave several files a date; compacted, each date has its rows in one."""
    t = FeatureTable(spark, scratch_path(spark, "compact"))
    f = common.features(spark, sf)
    for third in range(3):
        t.append(f.where(F.hour("timestamp") % 3 == third))
    stored = lambda: spark.read.parquet(t.path).groupBy("event_date").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("city").alias("cities"), F.count_distinct("_metadata.file_path").cast("int").alias("files"))
    before = stored().select("event_date", (F.col("files") > 1).alias("was_many")).collect()  # a row a date
    t.compact()
    return stored().join(spark.createDataFrame(before, "event_date date, was_many boolean"), "event_date").select(
        "event_date", "rows", "cities", "was_many", "files")


_NEW_CUT, _BATCH_FROM = "2024-01-20 12:00:00", "2024-01-15 00:00:00"


@query("new_rows_only", FULL_CTES + _stored_sql(where=f"WHERE timestamp >= TIMESTAMP '{_NEW_CUT}'"))
def q_new_rows_only(spark, sf):
    """Anti join of a batch against the stored rows in the batch's time range."""
    t = FeatureTable(spark, scratch_path(spark, "anti"))
    f = common.features(spark, sf)
    t.append(f.where(F.col("timestamp") < F.lit(_NEW_CUT).cast("timestamp_ntz")))
    batch = t.conform(f.where(F.col("timestamp") >= F.lit(_BATCH_FROM).cast("timestamp_ntz")))
    from haze.operators.clean import restore_names

    return _out(restore_names(t.new_rows(batch), FEATURES_STORED))


@query("store_check", FULL_CTES + """
SELECT 'aqi_features' AS name, true AS "exists", true AS readable, COUNT(*) AS rows, 'readable' AS message FROM feat""")
def q_store_check(spark, sf):
    return _table(spark, sf).check()


def _catalog_sql() -> str:
    from haze.schemas import TIME_FEATURES

    parts = []
    for i, c in enumerate(FEATURES_ALL):
        fam = "base" if c in BASE_FEATURES else "time" if c in TIME_FEATURES else "derived"
        parts.append(f"SELECT {i + 1} AS ordinal, '{c}' AS feature, '{fam}' AS family, COUNT({c}) AS non_null FROM feat")
    return FULL_CTES + "\nUNION ALL\n".join(parts)


@query("feature_catalog", _catalog_sql())
def q_feature_catalog(spark, sf):
    return files.feature_catalog(common.features(spark, sf), FEATURES_ALL)


# ------------------------------------------------------------------ landed payloads, CSV, union
AIR_SQL = with_ctes(BASE[0], AIR) + "SELECT timestamp, city, " + ", ".join(
    R(c) for c in ["latitude", "longitude"] + AIR_MEASURES) + " FROM air"


@query("json_hourly_scan", AIR_SQL)
def q_json_hourly_scan(spark, sf):
    land = scratch_path(spark, "landing")
    payload.build_payloads(common.air(spark, sf), AIR_MEASURES).write.text(land)
    rows = payload.read_payloads(spark, land, AIR_MEASURES, whole_file=False)
    return rounded(rows.select("timestamp", "city", "latitude", "longitude", *AIR_MEASURES))


RAW_ORDER = [f.name for f in RAW_SCHEMA.fields]


@query("csv_scan", with_ctes(*BASE) + "SELECT timestamp, city, " + ", ".join(R(c) for c in RAW_ORDER[2:]) + " FROM raw")
def q_csv_scan(spark, sf):
    out = scratch_path(spark, "csv")
    (common.raw(spark, sf).select(*RAW_ORDER).write.option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(out))
    return rounded(files.read_raw_csv(spark, out).select(*RAW_ORDER))


_UNION_CUT_HIST, _UNION_CUT_RT = "2024-01-20 00:00:00", "2024-01-19 00:00:00"


@query("union_sources", with_ctes(*BASE) + "SELECT timestamp, city, " + ", ".join(R(c) for c in RAW_ORDER[2:])
       + f", 'historical' AS source FROM raw WHERE timestamp < TIMESTAMP '{_UNION_CUT_HIST}' UNION ALL "
       + "SELECT timestamp, city, " + ", ".join(R(c) if c != "precipitation" else "CAST(NULL AS DOUBLE) AS precipitation"
                                              for c in RAW_ORDER[2:])
       + f", 'realtime' AS source FROM raw WHERE timestamp >= TIMESTAMP '{_UNION_CUT_RT}'")
def q_union_sources(spark, sf):
    r = common.raw(spark, sf).select(*RAW_ORDER)
    ts = F.col("timestamp")
    hist = r.where(ts < F.lit(_UNION_CUT_HIST).cast("timestamp_ntz")).withColumn("source", F.lit("historical"))
    rt = (r.where(ts >= F.lit(_UNION_CUT_RT).cast("timestamp_ntz")).drop("precipitation")
           .withColumn("source", F.lit("realtime")))
    return rounded(files.union_sources(hist, rt).select(*RAW_ORDER, "source"))


# ------------------------------------------------------------------ streaming
@query("stream_ingest", AIR_SQL)
def q_stream_ingest(spark, sf):
    """Three landings, the last one older than the others and one with copies: every hour is stored once."""
    from haze.streaming.jobs import landed_table, landing_stream

    land, sink, ck = (scratch_path(spark, n) for n in ("stream-landing", "stream-sink", "stream-ckpt"))
    air, ts = common.air(spark, sf), F.col("timestamp")
    day = lambda x: F.lit(f"2024-01-{x} 00:00:00").cast("timestamp_ntz")
    for part in ((ts >= day(20)) & (ts < day(25)), ts >= day(24), ts < day(20)):
        payload.build_payloads(air.where(part), AIR_MEASURES).write.mode("append").text(land)
        landing_stream(spark, land, sink, ck, AIR_MEASURES, whole_file=False).awaitTermination()
    rows = landed_table(spark, sink, AIR_MEASURES).read()
    return rounded(rows.select("timestamp", "city", "latitude", "longitude", *AIR_MEASURES))


WEATHER_SQL = with_ctes(BASE[0], WEATHER) + "SELECT timestamp, city, " + ", ".join(R(c) for c in WEATHER_MEASURES) + " FROM weather"


def _weather_payloads(spark, sf):
    w = common.weather(spark, sf).withColumns({"latitude": F.lit(0.0), "longitude": F.lit(0.0)})
    return payload.build_payloads(w, WEATHER_MEASURES)


@query("json_weather_scan", WEATHER_SQL)
def q_json_weather_scan(spark, sf):
    land = scratch_path(spark, "landing")
    _weather_payloads(spark, sf).write.text(land)
    return rounded(payload.read_payloads(spark, land, WEATHER_MEASURES, whole_file=False).select("timestamp", "city", *WEATHER_MEASURES))


_RUNS = (dt.datetime(2024, 1, 15, 18, 30), dt.datetime(2024, 1, 16, 6, 30), dt.datetime(2024, 1, 16, 14, 30), dt.datetime(2024, 1, 16, 18, 10))
_RUN_FIRST = "2024-01-14 19:00:00"
_SECOND_DAY = "2024-01-15 19:00:00"


def _runs_sql() -> str:
    """One full recomputation without fill over all hours that the runs have seen: two local days from their start."""
    seen = (f"scored AS (SELECT * FROM all_scored WHERE timestamp >= TIMESTAMP '{_RUN_FIRST}' "
            f"AND timestamp <= TIMESTAMP '2024-01-16 18:00:00')")
    return with_ctes(*BASE, SCORED.replace("scored AS", "all_scored AS", 1), seen, CAL, DERIVED) + _stored_sql(src="derived")


@query("ingest_three_runs", _runs_sql())
def q_ingest_three_runs(spark, sf):
    """Both sides land as JSON; the hourly job runs at the end of one day and three times on the next; the feature
    table equals one full recomputation, and the raw sink holds each key once."""
    from haze.plans import jobs

    air, weather, raw = (scratch_path(spark, n) for n in ("ingest-air", "ingest-weather", "ingest-raw"))
    payload.build_payloads(common.air(spark, sf), AIR_MEASURES).write.text(air)
    _weather_payloads(spark, sf).write.text(weather)
    t = FeatureTable(spark, scratch_path(spark, "ingest-features"))
    for as_of in _RUNS:
        jobs.hourly_ingest(spark, air, weather, raw, t, as_of, whole_file=False)
    if not fs.has_rows(spark, t.path):  # so few events that no hour of these days has both sides
        return _out(common.features(spark, sf).limit(0))
    keys = files.raw_table(spark, raw).read().groupBy("timestamp", "city").agg(F.count(F.lit(1)).alias("copies"))
    return _out(t.read().join(keys.where(F.col("copies") == 1), ["timestamp", "city"]))


@query("ingest_late_hours", _runs_sql())
def q_ingest_late_hours(spark, sf):
    """A quarter of the hours, and half of those of one city, land after runs that have stored later ones: the feature
    table equals one full recomputation all the same."""
    from haze.plans import jobs

    air, weather, raw = (scratch_path(spark, n) for n in ("late-air", "late-weather", "late-raw"))
    rows, hour = common.air(spark, sf), F.hour(F.col("timestamp").cast("timestamp"))
    late = (hour % 4 == 2) | ((F.col("city") == "s1") & (hour % 4 == 3))
    second = F.col("timestamp") >= F.lit(_SECOND_DAY).cast("timestamp_ntz")
    _weather_payloads(spark, sf).write.text(weather)
    t = FeatureTable(spark, scratch_path(spark, "late-features"))
    for part, runs in ((~late, _RUNS[:1]), (late & ~second, _RUNS[:3]), (late & second, _RUNS[3:])):
        payload.build_payloads(rows.where(part), AIR_MEASURES).write.mode("append").text(air)
        for as_of in runs:
            jobs.hourly_ingest(spark, air, weather, raw, t, as_of, whole_file=False)
    if not fs.has_rows(spark, t.path):
        return _out(common.features(spark, sf).limit(0))
    return _out(t.read())


@query("store_append_dupes", FULL_CTES + _stored_sql())
def q_store_append_dupes(spark, sf):
    """A batch that holds every row twice, appended twice: each key is stored once."""
    t = FeatureTable(spark, scratch_path(spark, "dupes"))
    f = common.features(spark, sf)
    both = f.union(f)
    t.append(both)
    t.append(both)
    return _out(t.read())


_INC_CUT = "2024-01-20 00:00:00"


def _inc_sql() -> str:
    ctes = NOFILL_SQL[:NOFILL_SQL.rindex("SELECT city, timestamp")]
    return ctes + _stored_sql(src="derived")


@query("feature_increment", _inc_sql())
def q_feature_increment(spark, sf):
    """Store history features, then append the increment computed with 24 rows of history:
    the table equals a full recompute without fill."""
    from haze.operators.series import full_features
    from haze.streaming.jobs import feature_increment

    s = common.scored(spark, sf)
    cut = F.lit(_INC_CUT).cast("timestamp_ntz")
    hist, new = s.where(F.col("timestamp") < cut), s.where(F.col("timestamp") >= cut)
    t = FeatureTable(spark, scratch_path(spark, "increment"))
    t.append(full_features(hist, fill="none"))
    feature_increment(new, hist, t)
    return _out(t.read())


_ALERT_DAY = "CAST(CAST(timestamp - INTERVAL 19 HOUR AS DATE) AS TIMESTAMP) + INTERVAL 19 HOUR"


@query("stream_daily_alerts", with_ctes(*BASE, SCORED) + f"""
SELECT city, {_ALERT_DAY} AS day_start_utc, {R('avg(AQI)', 'mean_aqi')}, COUNT(*) AS n_hours,
       avg(AQI) > CAST('200.0' AS DOUBLE) AS alert
FROM scored
WHERE {_ALERT_DAY} + INTERVAL 1 DAY <= (SELECT max(timestamp) FROM scored) - INTERVAL 1 DAY
GROUP BY 1, 2""")
def q_stream_daily_alerts(spark, sf):
    """Local-day windows (UTC+5) closed by a 1-day watermark in one availableNow run:
    every window ending at or before max(event time) - 1 day is emitted."""
    from haze.streaming.jobs import daily_alerts_stream

    src, sink, ck = (scratch_path(spark, n) for n in ("alerts-src", "alerts-sink", "alerts-ckpt"))
    s = common.scored(spark, sf).select("city", "timestamp", "AQI")
    s.write.parquet(src)
    stream = spark.readStream.schema(s.schema).parquet(src)
    q = (daily_alerts_stream(stream).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return rounded(spark.read.schema("city string, day_start_utc timestamp_ntz, mean_aqi double, n_hours bigint, "
                                     "alert boolean").parquet(sink))



@query("daily_alerts", with_ctes(*BASE, SCORED) + f"""
SELECT city, {_ALERT_DAY} AS day_start_utc, {R('avg(AQI)', 'mean_aqi')}, COUNT(*) AS n_hours,
       avg(AQI) > CAST('200.0' AS DOUBLE) AS alert
FROM scored GROUP BY 1, 2""")
def q_daily_alerts(spark, sf):
    """The batch twin of the alert stream: every local day, the last ones included."""
    from haze.streaming.jobs import daily_alerts

    return rounded(daily_alerts(common.scored(spark, sf)))


_FEATURE_PARTS = ("timestamp < TIMESTAMP_NTZ '2024-01-10 06:00:00' AND NOT {held}",
                  "timestamp >= TIMESTAMP_NTZ '2024-01-10 06:00:00' AND timestamp < TIMESTAMP_NTZ '2024-01-21 00:00:00' AND NOT {held}",
                  "timestamp >= TIMESTAMP_NTZ '2024-01-20 00:00:00' OR {held}")
_HELD = "(city = 's1' AND hour(timestamp) = 5 AND day(timestamp) >= 9 AND day(timestamp) <= 12)"


@query("stream_features", _inc_sql())
def q_stream_features(spark, sf):
    """Three landings, each with a new start of the stream; the last one has a day again and hours of one city that are older
    than its state: the feature table equals a full recomputation without fill."""
    from haze.streaming.stateful import feature_stream

    src, ck, raw_sink = (scratch_path(spark, n) for n in ("features-src", "features-ckpt", "features-raw"))
    rows = common.raw(spark, sf).select(*RAW_ORDER)
    raw, table = files.raw_table(spark, raw_sink), FeatureTable(spark, scratch_path(spark, "features-table"))
    for part in _FEATURE_PARTS:
        rows.where(part.format(held=_HELD)).write.mode("append").parquet(src)
        feature_stream(spark, spark.readStream.schema(rows.schema).parquet(src), raw, table, ck, partitions=8).awaitTermination()
    return _out(table.read())


_SIDES_SQL = with_ctes(BASE[0], AIR, WEATHER) + f"""
, w AS (SELECT * FROM weather WHERE hour(timestamp) % 7 <> 3),
closed AS (SELECT least((SELECT max(timestamp) FROM air), (SELECT max(timestamp) FROM w)) - INTERVAL 2 DAY AS until)
SELECT coalesce(a.timestamp, w.timestamp) AS timestamp, coalesce(a.city, w.city) AS city,
       CASE WHEN w.city IS NULL THEN 'air' WHEN a.city IS NULL THEN 'weather' ELSE 'both' END AS side,
       {', '.join(R(c) for c in AIR_MEASURES + WEATHER_MEASURES)}
FROM air a FULL JOIN w ON a.city = w.city AND a.timestamp = w.timestamp, closed
WHERE (a.city IS NOT NULL AND w.city IS NOT NULL) OR coalesce(a.timestamp, w.timestamp) <= until"""


@query("stream_join", _SIDES_SQL)
def q_stream_join(spark, sf):
    """Air and weather land in turns, either first, and the stream starts anew each time; some weather hours never come. Matched
    hours are in the raw table, those that the watermark has passed without their other side in the other one."""
    from haze.streaming.stateful import joined_stream, unmatched_table

    air, weather, raw, alone, ck = (scratch_path(spark, n) for n in ("join-air", "join-weather", "join-raw", "join-alone", "join-ckpt"))
    a, w = common.air(spark, sf), common.weather(spark, sf).withColumns({"latitude": F.lit(0.0), "longitude": F.lit(0.0)})
    w, ts = w.where("hour(timestamp) % 7 <> 3"), F.col("timestamp")
    day = lambda x: F.lit(f"2024-01-{x} 00:00:00").cast("timestamp_ntz")
    for weather_part, air_part in ((ts < day(14), None), (None, ts < day(25)), (ts >= day(14), ts >= day(25))):
        for rows, part, measures, land in ((w, weather_part, WEATHER_MEASURES, weather), (a, air_part, AIR_MEASURES, air)):
            fs.make(spark, land)  # both folders are there before either side lands
            if part is not None:
                payload.build_payloads(rows.where(part), measures).write.mode("append").text(land)
        joined_stream(spark, air, weather, raw, alone, ck, whole_file=False, partitions=8).awaitTermination()
    measures = [*AIR_MEASURES, *WEATHER_MEASURES]
    both = files.raw_table(spark, raw).read().withColumn("side", F.lit("both"))
    out = both.select("timestamp", "city", "side", *measures)
    if fs.has_rows(spark, alone):
        out = out.union(unmatched_table(spark, alone).read().select(*out.columns))
    return rounded(out)
