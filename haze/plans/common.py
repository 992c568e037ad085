"""Shared building blocks of the registered queries (Spark side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haze.operators.clean import drop_missing, with_aqi
from haze.operators.series import full_features
from haze.sources.driver_tables import air_hourly, raw_hourly, table, weather_hourly


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return raw_hourly(spark, sf)


def air(spark: SparkSession, sf: str) -> DataFrame:
    return air_hourly(table(spark, sf, "events"))


def weather(spark: SparkSession, sf: str) -> DataFrame:
    return weather_hourly(table(spark, sf, "events"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """RAW -> drop missing PM -> AQI + category -> drop rows without AQI."""
    return drop_missing(with_aqi(drop_missing(raw(spark, sf), ["pm2_5", "pm10"])), ["AQI"])


def features(spark: SparkSession, sf: str, fill: str = "all") -> DataFrame:
    return full_features(scored(spark, sf), fill=fill)
