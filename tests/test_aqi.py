import pytest
from pyspark.sql import functions as F

from haze.functions.aqi import aqi_category, aqi_subindex, display_band, legend, overall_aqi
from haze.schemas import AQI_POLLUTANT_ORDER

P = AQI_POLLUTANT_ORDER
SCHEMA = ", ".join(f"{p} double" for p in P)


def frame(spark, rows):
    full = [tuple(r.get(p) for p in P) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def overall(spark, rows, policy="first"):
    df = frame(spark, rows).select(overall_aqi(nan_policy=policy).alias("a"))
    return [r.a for r in df.collect()]


def test_band_edges(spark):
    got = overall(spark, [{"pm2_5": 12.0}, {"pm2_5": 12.1}, {"pm2_5": 0.0}, {"pm2_5": 250.4}])
    assert got[0] == pytest.approx(50.0)
    assert got[1] == pytest.approx(51.0)
    assert got[2] == pytest.approx(0.0)
    assert got[3] == pytest.approx(300.0)


def test_first_present_rule(spark):
    got = overall(spark, [
        {"pm2_5": 12.05, "pm10": 54.0},   # gap in the first present pollutant -> NULL
        {"pm2_5": 12.0, "pm10": 54.5},    # later out-of-band ignored
        {"pm2_5": 300.0, "pm10": 10.0},   # above ceiling
        {"pm2_5": -1.0, "pm10": 10.0},    # below every band
        {"pm10": 54.5, "ozone": 54.0},    # first present is pm10 (gap) -> NULL
        {},                               # nothing present
        {"pm2_5": 10.0, "pm10": 100.0},   # max of both
    ])
    assert got[0] is None
    assert got[1] == pytest.approx(50.0)
    assert got[2] is None and got[3] is None and got[4] is None and got[5] is None
    assert got[6] == pytest.approx(max(50 / 12 * 10, (100 - 51) / (154 - 55) * (100 - 55) + 51))


def test_skip_policy(spark):
    got = overall(spark, [{"pm2_5": 12.05, "pm10": 54.0}], policy="skip")
    assert got[0] == pytest.approx(50.0)


#: Worked out by hand: (pollutant, concentration, index). The index rises in a straight line inside each band.
BY_HAND = [
    ("pm2_5", 6.0, 25.0), ("pm2_5", 12.1, 51.0), ("pm2_5", 23.75, 75.5), ("pm2_5", 35.4, 100.0), ("pm2_5", 45.45, 125.5),
    ("pm2_5", 102.95, 175.5), ("pm2_5", 200.45, 250.5), ("pm2_5", 35.45, None), ("pm2_5", 250.5, None), ("pm2_5", -0.1, None),
    ("pm10", 27.0, 25.0), ("pm10", 104.5, 75.5), ("pm10", 204.5, 125.5), ("pm10", 304.5, 175.5), ("pm10", 389.5, 250.5),
    ("pm10", 54.5, None), ("pm10", 425.0, None),
    ("ozone", 27.0, 25.0), ("ozone", 62.5, 75.5), ("ozone", 78.0, 125.5), ("ozone", 95.5, 175.5), ("ozone", 105.1, None),
    ("nitrogen_dioxide", 26.5, 25.0), ("nitrogen_dioxide", 77.0, 75.5), ("nitrogen_dioxide", 230.5, 125.5),
    ("nitrogen_dioxide", 505.0, 175.5), ("nitrogen_dioxide", 53.5, None),
    ("sulphur_dioxide", 17.5, 25.0), ("sulphur_dioxide", 55.5, 75.5), ("sulphur_dioxide", 130.5, 125.5),
    ("sulphur_dioxide", 245.0, 175.5), ("sulphur_dioxide", 304.5, None),
    ("carbon_monoxide", 2.2, 25.0), ("carbon_monoxide", 6.95, 75.5), ("carbon_monoxide", 10.95, 125.5),
    ("carbon_monoxide", 13.95, 175.5), ("carbon_monoxide", 15.5, None),
]


def test_sub_indices_by_hand(spark):
    for p in P:
        rows = [(c, want) for q, c, want in BY_HAND if q == p]
        df = spark.createDataFrame([(c,) for c, _ in rows], "x double").select("x", aqi_subindex("x", p).alias("s"))
        got = {r.x: r.s for r in df.collect()}
        for c, want in rows:
            assert got[c] is None if want is None else got[c] == pytest.approx(want, abs=1e-9), (p, c)


def test_overall_index_by_hand(spark):
    rows = [{"pm2_5": 6.0, "pm10": 104.5, "ozone": 27.0}, {"pm10": 27.0, "carbon_monoxide": 13.95}, {"ozone": 62.5, "pm2_5": 45.45},
            {"nitrogen_dioxide": 505.0, "sulphur_dioxide": 130.5}, {"pm2_5": 6.0, "carbon_monoxide": 15.5}]
    assert overall(spark, rows) == [pytest.approx(v) for v in (75.5, 175.5, 125.5, 175.5, 25.0)]


def test_bands_scale_and_absence_are_arguments(spark):
    df = frame(spark, [{"pm2_5": 6.0, "pm10": 104.5, "carbon_monoxide": 2200.0}])
    got = df.select(overall_aqi(bands={"pm2_5": [(0, 10, 0, 100)]}).alias("own"),
                    overall_aqi(["carbon_monoxide"], unit_scale={"carbon_monoxide": 0.001}).alias("scaled"),
                    overall_aqi(without="pm10", pollutants=["pm2_5", "pm10"]).alias("less")).first()
    assert got.own == pytest.approx(60.0) and got.scaled == pytest.approx(25.0) and got.less == pytest.approx(25.0)


def test_legend(spark):
    rows = legend(spark).orderBy("ordinal").collect()
    assert [(r.above, r.up_to, r.band) for r in rows] == [
        (None, 50.0, "Good"), (50.0, 100.0, "Moderate"), (100.0, 150.0, "Unhealthy for Sensitive Groups"),
        (150.0, 200.0, "Unhealthy"), (200.0, 300.0, "Very Unhealthy"), (300.0, None, "Hazardous")]


def test_categories_and_bands(spark):
    df = spark.createDataFrame([(50.0,), (50.5,), (51.0,), (300.0,), (301.0,), (None,), (-1.0,)], "a double")
    got = df.select(aqi_category("a").alias("c"), display_band("a").alias("b")).collect()
    assert [r.c for r in got] == ["Good", "Hazardous", "Moderate", "Very Unhealthy", "Hazardous", "Hazardous",
                                  "Hazardous"]
    assert [r.b for r in got] == ["Good", "Moderate", "Moderate", "Very Unhealthy", "Hazardous", "Hazardous", "Good"]


def test_no_python_in_aqi_plan(spark):
    df = frame(spark, [{"pm2_5": 1.0}]).select(overall_aqi().alias("a"), aqi_category(F.lit(1.0)).alias("c"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
