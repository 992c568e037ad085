import datetime as dt
import tempfile

import pytest

from haze.operators import profile
from haze.plans import jobs
from haze.schemas import AIR_MEASURES, WEATHER_MEASURES
from haze.sources import files, payload
from haze.sources.store import FeatureTable

DAY = dt.datetime(2024, 1, 10)


def hours(spark, city, which, measures, base=10.0):
    rows = [(DAY + dt.timedelta(hours=h), city, 33.0, 73.0, *[base + abs(h) % 20 + i for i in range(len(measures))]) for h in which]
    kinds = "timestamp timestamp_ntz, city string, latitude double, longitude double, " + ", ".join(f"{m} double" for m in measures)
    return spark.createDataFrame(rows, kinds)


def land(spark, base, city, which):
    for folder, measures in (("air", AIR_MEASURES), ("weather", WEATHER_MEASURES)):
        payload.build_payloads(hours(spark, city, which, measures), measures).write.mode("append").text(f"{base}/{folder}")


def ingest(spark, base, table, hour):
    return jobs.hourly_ingest(spark, f"{base}/air", f"{base}/weather", f"{base}/raw", table, DAY + dt.timedelta(hours=hour, minutes=30), whole_file=False)


COLUMNS = ["timestamp", "city", "pm2_5", "pm2_5_lag_1h", "pm2_5_rolling_mean_24h", "AQI"]


def test_a_late_hour_changes_the_rows_after_it(spark):
    late, once = tempfile.mkdtemp(prefix="haze-late-"), tempfile.mkdtemp(prefix="haze-once-")
    a, b = FeatureTable(spark, late + "/features"), FeatureTable(spark, once + "/features")
    land(spark, late, "x", [1, 2, 3, 4, 5, 7])
    land(spark, late, "y", [1, 2])
    first = ingest(spark, late, a, 7)
    assert (first["written"], first["replaced"]) == (8, 0)
    land(spark, late, "x", [6, 8])
    second = ingest(spark, late, a, 8)
    assert (second["raw_written"], second["written"], second["replaced"]) == (2, 2, 1)  # hour 7 is made anew, y isn't touched
    third = ingest(spark, late, a, 8)
    assert (third["raw_written"], third["written"], third["replaced"]) == (0, 0, 0)
    land(spark, once, "x", range(1, 9))
    land(spark, once, "y", [1, 2])
    ingest(spark, once, b, 8)
    rows = sorted(map(tuple, a.read().select(COLUMNS).collect()))
    assert rows == sorted(map(tuple, b.read().select(COLUMNS).collect())) and len(rows) == 10
    seventh = next(r for r in rows if r[0].hour == 7)
    assert seventh[3] == pytest.approx(next(r for r in rows if r[0].hour == 6)[2])


def test_a_new_city_reads_no_more_dates(spark, monkeypatch):
    raw = files.raw_table(spark, tempfile.mkdtemp(prefix="haze-new-") + "/raw")
    old = hours(spark, "old", range(-24 * 40, 0), AIR_MEASURES)
    for m in WEATHER_MEASURES:
        old = old.withColumn(m, jobs.F.lit(1.0))
    raw.append(old)
    jobs.note_cities(raw, old)
    new = hours(spark, "new", [0], AIR_MEASURES).select("city", "timestamp")
    raw.append(hours(spark, "new", [0], AIR_MEASURES))
    jobs.note_cities(raw, new)
    starts = []
    read = FeatureTable.read
    monkeypatch.setattr(FeatureTable, "read", lambda self, start=None, *a, **k: starts.append(start) or read(self, start, *a, **k))
    both = new.union(old.select("city", "timestamp"))
    rows = jobs.stored_history(raw, DAY, both, 24)
    assert starts == [DAY - dt.timedelta(days=3)]
    assert rows.where("city = 'old'").count() >= 24 and rows.where("city = 'new'").count() == 0


def test_replace_reads_and_writes_the_dates_of_its_rows(spark):
    t = FeatureTable(spark, tempfile.mkdtemp(prefix="haze-replace-") + "/t", columns=["timestamp", "city", "pm2_5"])
    rows = lambda *r: spark.createDataFrame([(DAY + dt.timedelta(days=d), c, v) for d, c, v in r], "timestamp timestamp_ntz, city string, pm2_5 double")
    assert t.replace(rows((0, "a", 1.0), (0, "a", 1.0), (0, "b", 2.0))) == 2
    t.append(rows((1, "a", 3.0), (2, "a", 4.0)))
    before = {e.path for e in files.fs.listed(spark, t.path + "/event_date=2024-01-11")}
    assert t.replace(rows((0, "a", 9.0), (2, "c", 5.0))) == 2
    assert sorted((r.timestamp.day, r.city, r.pm2_5) for r in t.read().collect()) == [
        (10, "a", 9.0), (10, "b", 2.0), (11, "a", 3.0), (12, "a", 4.0), (12, "c", 5.0)]
    assert {e.path for e in files.fs.listed(spark, t.path + "/event_date=2024-01-11")} == before  # not written again
    assert t.replace(rows((5, "z", 1.0)).limit(0)) == 0 and t.exists()
    assert not [e for e in files.fs.listed(spark, t.path) if e.name.startswith("_staging")]


def test_nan_is_missing_in_every_profile(spark):
    nan = float("nan")
    odd = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (3.0, 5.0), (nan, 1.0), (nan, nan), (None, 9.0), (7.0, None)], "x double, y double")
    clean = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (3.0, 5.0), (7.0, None)], "x double, y double")
    for f in (profile.histogram, profile.kde):
        a, b = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in f(df, ["x"]).collect()) for df in (odd, clean))
        assert a == b
    corr = {(r.col_a, r.col_b): r["corr"] for r in profile.correlation_matrix(odd, ["x", "y"]).collect()}
    expected = clean.where("y IS NOT NULL").selectExpr("corr(x, y)").first()[0]
    assert corr["x", "y"] == pytest.approx(expected)
