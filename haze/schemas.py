"""Schemas, column groups and fixed lookup values.

Everything under "FIXED VALUES" must stay equal to the source pipeline's
constants for results to match; it is stated plainly and in natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ----------------------------------------------------------------------------
# FIXED VALUES (must equal the reference pipeline's constants)
# ----------------------------------------------------------------------------

# Breakpoints per pollutant: (C_low, C_high, I_low, I_high), pollutants in the
# order the overall index visits them.
AQI_BREAKPOINTS: dict[str, list[tuple[float, float, int, int]]] = {
    "pm2_5": [(0, 12, 0, 50), (12.1, 35.4, 51, 100), (35.5, 55.4, 101, 150),
              (55.5, 150.4, 151, 200), (150.5, 250.4, 201, 300)],
    "pm10": [(0, 54, 0, 50), (55, 154, 51, 100), (155, 254, 101, 150),
             (255, 354, 151, 200), (355, 424, 201, 300)],
    "ozone": [(0, 54, 0, 50), (55, 70, 51, 100), (71, 85, 101, 150),
              (86, 105, 151, 200)],
    "nitrogen_dioxide": [(0, 53, 0, 50), (54, 100, 51, 100),
                         (101, 360, 101, 150), (361, 649, 151, 200)],
    "sulphur_dioxide": [(0, 35, 0, 50), (36, 75, 51, 100),
                        (76, 185, 101, 150), (186, 304, 151, 200)],
    "carbon_monoxide": [(0, 4.4, 0, 50), (4.5, 9.4, 51, 100),
                        (9.5, 12.4, 101, 150), (12.5, 15.4, 151, 200)],
}

# Health categories with integer gaps; anything else is "Hazardous".
AQI_CATEGORIES: list[tuple[int, int, str]] = [
    (0, 50, "Good"),
    (51, 100, "Moderate"),
    (101, 150, "Unhealthy for Sensitive Groups"),
    (151, 200, "Unhealthy"),
    (201, 300, "Very Unhealthy"),
]
FALLBACK_CATEGORY = "Hazardous"

# Gap-free display bands (upper bound inclusive); above the last is Hazardous.
DISPLAY_BANDS: list[tuple[int, str]] = [
    (50, "Good"),
    (100, "Moderate"),
    (150, "Unhealthy for Sensitive Groups"),
    (200, "Unhealthy"),
    (300, "Very Unhealthy"),
]
HAZARD_ADVICE = "Stay indoors; wear an N95 mask if going out; use air purifiers"
HAZARD_THRESHOLD = 200.0
STALE_HOURS = 24.0

LOCAL_TZ = "Asia/Karachi"
FORECAST_HOURS = 72
FORECAST_DAYS = 3
HISTORY_ROWS = 24
ROLL_WINDOW = 24
RATIO_EPS = 1e-6
RANDOM_STATE = 42
TOP_K = 10

AIR_MEASURES = ["pm10", "pm2_5", "carbon_monoxide", "nitrogen_dioxide", "sulphur_dioxide", "ozone"]
WEATHER_MEASURES = ["temperature_2m", "relative_humidity_2m", "surface_pressure",
                    "wind_speed_10m", "wind_direction_10m", "precipitation"]
AQI_POLLUTANT_ORDER = ["pm2_5", "pm10", "ozone", "nitrogen_dioxide", "sulphur_dioxide", "carbon_monoxide"]

ROLLING_MEASURES = ["pm2_5", "pm10", "ozone"]
LAG_MEASURES = ["pm2_5", "pm10", "temperature_2m"]
LAGS = [1, 24]

BASE_FEATURES = AIR_MEASURES + WEATHER_MEASURES
TIME_FEATURES = ["hour", "day_of_week", "day_of_month", "month", "quarter", "is_weekend",
                 "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos",
                 "month_sin", "month_cos"]
DERIVED_FEATURES = [
    "pm2_5_rolling_mean_24h", "pm2_5_rolling_std_24h", "pm2_5_rolling_max_24h",
    "pm10_rolling_mean_24h", "pm10_rolling_std_24h", "pm10_rolling_max_24h",
    "ozone_rolling_mean_24h", "ozone_rolling_std_24h", "ozone_rolling_max_24h",
    "temperature_change", "wind_speed_change",
    "pm2_5_pm10_ratio", "temperature_humidity_interaction", "wind_pressure_interaction",
    "pm2_5_lag_1h", "pm2_5_lag_24h",
    "pm10_lag_1h", "pm10_lag_24h",
    "temperature_2m_lag_1h", "temperature_2m_lag_24h",
]
FEATURES_ALL = BASE_FEATURES + TIME_FEATURES + DERIVED_FEATURES  # 44 names

FEATURES_STORED = [
    "timestamp", "city", "latitude", "longitude",
    "pm2_5", "pm2_5_lag_1h", "pm2_5_lag_24h",
    "pm10", "pm10_lag_1h",
    "pm2_5_rolling_mean_24h", "nitrogen_dioxide",
    "pm2_5_rolling_max_24h", "carbon_monoxide",
    "pm10_lag_24h", "pm10_rolling_mean_24h",
    "relative_humidity_2m", "pm10_rolling_max_24h",
    "pm2_5_rolling_std_24h", "sulphur_dioxide",
    "temperature_2m", "hour_sin", "ozone",
    "AQI", "AQI_Category",
]
MODEL_FEATURES = [
    "pm2_5", "pm2_5_lag_1h", "pm2_5_lag_24h", "pm10", "pm10_lag_1h",
    "pm2_5_rolling_mean_24h", "nitrogen_dioxide", "pm2_5_rolling_max_24h",
    "carbon_monoxide", "pm10_lag_24h", "pm10_rolling_mean_24h",
    "relative_humidity_2m", "pm10_rolling_max_24h", "pm2_5_rolling_std_24h",
    "sulphur_dioxide", "temperature_2m", "hour_sin", "ozone",
]
TRAIN_EXCLUDE = ["AQI", "aqi", "AQI_Category", "aqi_category", "timestamp", "city", "latitude", "longitude"]
KEY = ["city", "timestamp"]

# ----------------------------------------------------------------------------
# Spark schemas
# ----------------------------------------------------------------------------

RAW_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.TimestampNTZType(), False),
     T.StructField("city", T.StringType(), False),
     T.StructField("latitude", T.DoubleType(), True),
     T.StructField("longitude", T.DoubleType(), True)]
    + [T.StructField(m, T.DoubleType(), True) for m in BASE_FEATURES]
)


def payload_schema(measures: list[str]) -> T.StructType:
    """Landed hourly payload: parallel arrays under ``hourly``."""
    hourly = T.StructType(
        [T.StructField("time", T.ArrayType(T.StringType()), True)]
        + [T.StructField(m, T.ArrayType(T.DoubleType()), True) for m in measures]
    )
    return T.StructType([
        T.StructField("city", T.StringType(), True),
        T.StructField("latitude", T.DoubleType(), True),
        T.StructField("longitude", T.DoubleType(), True),
        T.StructField("hourly", hourly, True),
    ])


def band_slope(clow: float, chigh: float, ilow: int, ihigh: int) -> float:
    """Slope in the same operation order as the source: (Ih-Il)/(Ch-Cl)."""
    return (ihigh - ilow) / (chigh - clow)
