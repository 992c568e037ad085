"""Adapters from the driver's tables to the hourly RAW model.

The driver's data has no air-quality table, so the hourly observations are
derived from ``events`` (and, for long series, ``lineitem``/``orders``):
each (city, hour) is one hash aggregate with partial aggregation on the map
side, so a city holding a third of all events still ships at most one
partial row per (city, hour) and map task into the shuffle.

Means are exact: values are summed as DECIMAL(18,2) and divided once as
doubles, so the result does not depend on row order or partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


N_CITIES = 3

# event_type -> role in the air / weather tables
AIR_EVENTS = ("click", "view", "error")
WEATHER_EVENTS = ("purchase", "signup")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _mean_sql(kind: str) -> str:
    """Exact mean of one event type: DECIMAL sum cast once to double, divided by its count."""
    return (f"CAST(sum(CASE WHEN event_type = '{kind}' THEN v END) AS DOUBLE) / "
            f"nullif(count(CASE WHEN event_type = '{kind}' THEN 1 END), 0)")


def _count_sql(kind: str) -> str:
    return f"count(CASE WHEN event_type = '{kind}' THEN 1 END)"


def _keyed_events(events: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    # plain SQL expression text: one planner call per projection instead of one per operator
    hour = ("make_timestamp_ntz(year(ts), month(ts), dayofmonth(ts), hour(ts), 0, "
            "CAST(0 AS DECIMAL(8,6)))")
    return (events
            .where(F.col("event_type").isin(*kinds))
            .selectExpr(f"concat('s', CAST(user_id % {N_CITIES} AS STRING)) AS city",
                        f"user_id % {N_CITIES} AS k",
                        f"{hour} AS timestamp",
                        "event_type",
                        "CAST(value AS DECIMAL(18,2)) AS v"))


def air_hourly(events: DataFrame) -> DataFrame:
    """Hourly pollutant side: city, timestamp, latitude, longitude, 6 measures."""
    agg = (_keyed_events(events, AIR_EVENTS)
           .groupBy("city", "k", "timestamp")
           .agg(F.expr(_mean_sql("click")).alias("m_click"),
                F.expr(_mean_sql("view")).alias("m_view"),
                F.expr(_mean_sql("error")).alias("m_error")))
    return agg.selectExpr(
        "timestamp", "city",
        "33.5D + CAST(k AS DOUBLE) * 0.25D AS latitude",
        "73.0D + CAST(k AS DOUBLE) * 0.25D AS longitude",
        "m_view AS pm10",
        "m_click AS pm2_5",
        "m_click / 20.0D AS carbon_monoxide",
        "m_view * 0.75D AS nitrogen_dioxide",
        "m_error * 0.5D AS sulphur_dioxide",
        "m_error / 4.0D AS ozone",
    )


def weather_hourly(events: DataFrame) -> DataFrame:
    """Hourly weather side: city, timestamp, 6 measures."""
    agg = (_keyed_events(events, WEATHER_EVENTS)
           .groupBy("city", "timestamp")
           .agg(F.expr(_mean_sql("purchase")).alias("m_purchase"),
                F.expr(_mean_sql("signup")).alias("m_signup"),
                F.expr(_count_sql("purchase")).alias("n_purchase"),
                F.expr(_count_sql("signup")).alias("n_signup")))
    return agg.selectExpr(
        "timestamp", "city",
        "m_purchase / 10.0D AS temperature_2m",
        "m_purchase / 5.0D AS relative_humidity_2m",
        "1000.0D + m_signup / 10.0D AS surface_pressure",
        "m_signup / 20.0D AS wind_speed_10m",
        "CAST(n_signup AS DOUBLE) * 45.0D AS wind_direction_10m",
        "CAST(n_purchase AS DOUBLE) / 4.0D AS precipitation",
    )


def raw_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW observations (16 columns) = air JOIN weather on (city, timestamp)."""
    from haze.operators.clean import join_air_weather

    events = table(spark, sf_dir, "events")
    return join_air_weather(air_hourly(events), weather_hourly(events))


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long daily series per customer nation from lineitem x orders x customer.

    ``city`` = 'n<nationkey>', ``timestamp`` = order date. Used for benchmarks
    where per-key series are much longer than the hourly event series.
    Joins are left to the optimizer: customer and orders grow with the
    scale factor, so neither is forced to broadcast.
    """
    # aggregate lineitem per order first: its hash(l_orderkey) output partitioning already
    # satisfies the join with orders, so lineitem is shuffled once, after map-side combine
    per_order = (table(spark, sf_dir, "lineitem")
                 .groupBy("l_orderkey")
                 .agg(F.expr("sum(CAST(l_quantity AS DECIMAL(18,2)))").alias("q"),
                      F.expr("sum(CAST(l_extendedprice AS DECIMAL(18,2)))").alias("p"),
                      F.expr("sum(CAST(l_discount AS DECIMAL(18,2)))").alias("d"),
                      F.expr("sum(CAST(l_tax AS DECIMAL(18,2)))").alias("t"),
                      F.expr("count(1)").alias("c")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = (per_order.join(orders, per_order.l_orderkey == orders.o_orderkey)
                  .join(cust, F.col("o_custkey") == cust.c_custkey))
    agg = (j.groupBy("c_nationkey", "o_orderdate")
            .agg(F.expr("CAST(sum(q) AS DOUBLE)").alias("sq"), F.expr("CAST(sum(p) AS DOUBLE)").alias("sp"),
                 F.expr("CAST(sum(d) AS DOUBLE)").alias("sd"), F.expr("CAST(sum(t) AS DOUBLE)").alias("st"),
                 F.expr("sum(c)").alias("n")))
    k = F.col("c_nationkey")
    return agg.select(
        F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp"),
        F.concat(F.lit("n"), k.cast("string")).alias("city"),
        (F.lit(30.0) + k.cast("double") * F.lit(0.25)).alias("latitude"),
        (F.lit(70.0) + k.cast("double") * F.lit(0.25)).alias("longitude"),
        (F.col("sp") / F.col("n") / F.lit(200.0)).alias("pm10"),
        (F.col("sq") / F.col("n")).alias("pm2_5"),
        (F.col("sd") / F.col("n") * F.lit(100.0)).alias("carbon_monoxide"),
        (F.col("st") / F.col("n") * F.lit(1000.0)).alias("nitrogen_dioxide"),
        (F.col("n").cast("double") / F.lit(10.0)).alias("sulphur_dioxide"),
        (F.col("sq") / F.col("n") * F.lit(2.0)).alias("ozone"),
        (F.col("sd") / F.col("n") * F.lit(300.0)).alias("temperature_2m"),
        (F.col("st") / F.col("n") * F.lit(900.0)).alias("relative_humidity_2m"),
        (F.lit(1000.0) + F.col("sq") / F.col("n")).alias("surface_pressure"),
        (F.col("sp") / F.col("n") / F.lit(5000.0)).alias("wind_speed_10m"),
        (F.col("n").cast("double") * F.lit(7.0)).alias("wind_direction_10m"),
        (F.col("sd") / F.col("n")).alias("precipitation"),
    )


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW observations with a city for every user: one row for each user and day with events.

    The number of series grows with the users, and each measure is an exact
    decimal aggregate of all the user's events of the day.
    """
    day = "make_timestamp_ntz(year(ts), month(ts), dayofmonth(ts), 0, 0, CAST(0 AS DECIMAL(8,6)))"
    agg = (table(spark, sf_dir, "events")
           .selectExpr("user_id", f"{day} AS timestamp", "CAST(value AS DECIMAL(18,2)) AS v")
           .groupBy("user_id", "timestamp")
           .agg(F.expr("CAST(sum(v) AS DOUBLE) / count(1)").alias("mean"), F.expr("CAST(max(v) AS DOUBLE)").alias("hi"),
                F.expr("CAST(min(v) AS DOUBLE)").alias("lo"), F.expr("CAST(count(1) AS DOUBLE)").alias("n")))
    return agg.selectExpr(
        "timestamp", "concat('u', CAST(user_id AS STRING)) AS city",
        "20.0D + CAST(user_id % 64 AS DOUBLE) * 0.25D AS latitude", "60.0D + CAST(user_id % 128 AS DOUBLE) * 0.25D AS longitude",
        "hi AS pm10", "mean AS pm2_5", "lo / 20.0D AS carbon_monoxide", "mean * 0.75D AS nitrogen_dioxide",
        "hi * 0.5D AS sulphur_dioxide", "hi / 4.0D AS ozone", "lo / 10.0D AS temperature_2m", "hi / 5.0D AS relative_humidity_2m",
        "1000.0D + mean / 10.0D AS surface_pressure", "mean / 20.0D AS wind_speed_10m", "n * 45.0D AS wind_direction_10m",
        "n / 4.0D AS precipitation")
