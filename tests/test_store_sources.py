import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from haze.schemas import AIR_MEASURES
from haze.sources import files, payload
from haze.sources.store import FeatureTable


def _features(spark, n=48, city="x"):
    rows = []
    t0 = dt.datetime(2024, 1, 1, 0, 0)
    for i in range(n):
        rows.append((t0 + dt.timedelta(hours=i), city, 33.0, 73.0, float(i), float(i) * 2, 10.0 + i, "Good"))
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, city string, latitude double, longitude double, "
                                       "pm2_5 double, pm10 double, AQI double, AQI_Category string")


def _table(spark):
    return FeatureTable(spark, tempfile.mkdtemp(prefix="haze-store-") + "/t")


def test_append_idempotent_and_overlap(spark):
    t = _table(spark)
    f = _features(spark)
    t.append(f.where(F.col("pm2_5") < 30))
    assert t.read().count() == 30
    t.append(f)
    t.append(f)
    got = t.read()
    assert got.count() == 48
    assert got.groupBy("timestamp", "city").count().where("count > 1").count() == 0
    assert {"AQI", "AQI_Category"} <= set(got.columns)  # names restored from lower case


def test_range_scan_pushdown_and_open_ends(spark):
    t = _table(spark)
    t.append(_features(spark))
    lo, hi = dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 1, 10)
    assert t.read(lo, hi).count() == 6
    assert t.read(start=lo).count() == 43
    assert t.read(end=hi).count() == 11
    plan = t.read(lo, hi)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "event_date" in plan
    assert "PushedFilters" in plan and "timestamp" in plan


def test_missing_timestamp_error_and_city_default(spark):
    t = _table(spark)
    with pytest.raises(ValueError):
        t.append(_features(spark).drop("timestamp"))
    t.append(_features(spark).drop("city"), default_city="Rawalpindi")
    assert [r.city for r in t.read().select("city").distinct().collect()] == ["Rawalpindi"]


def test_check_inspect_recreate_view(spark):
    t = _table(spark)
    rep = t.check().first()
    assert rep.exists is False
    t.append(_features(spark))
    rep = t.check().first()
    assert rep.exists and rep.readable and rep.rows == 48
    issues = {r.feature: r.issue for r in t.inspect().collect()}
    assert issues["aqi"] is None
    with pytest.raises(PermissionError):
        t.recreate(_features(spark, 5))
    assert t.recreate(_features(spark, 5), force=True).count() == 5
    name = t.view()
    assert spark.table(name).count() == 5


def test_training_set_requires_target(spark):
    t = _table(spark)
    t.append(_features(spark).drop("AQI"))
    with pytest.raises(ValueError):
        t.training_set()


def test_payload_parse_cases(spark):
    docs = [
        {"city": "a", "latitude": 1.0, "longitude": 2.0,
         "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "pm10": [1.0, None], "pm2_5": [2.0, 3.0]}},
        {"city": "b", "latitude": 1.0, "longitude": 2.0},                       # no hourly
        {"city": "c", "latitude": 1.0, "longitude": 2.0, "hourly": {"pm10": [1.0]}},  # no time
    ]
    texts = spark.createDataFrame([(json.dumps(d),) for d in docs], "value string")
    got = payload.parse_payloads(texts, AIR_MEASURES).orderBy("timestamp").collect()
    assert len(got) == 2
    assert got[0].pm10 == 1.0 and got[1].pm10 is None and got[1].pm2_5 == 3.0
    assert got[0].timestamp == dt.datetime(2024, 1, 1, 0, 0) and got[0].ozone is None


def test_payload_files_whole_text(spark):
    d = tempfile.mkdtemp(prefix="haze-land-")
    for i in range(2):
        with open(os.path.join(d, f"p{i}.json"), "w") as fh:
            json.dump({"city": f"c{i}", "latitude": 0.0, "longitude": 0.0,
                       "hourly": {"time": ["2024-01-01T00:00"], "pm10": [float(i)]}}, fh, indent=2)
    got = payload.read_payloads(spark, d, ["pm10"]).orderBy("city").collect()
    assert [r.pm10 for r in got] == [0.0, 1.0]


def test_csv_union_latest(spark):
    d = tempfile.mkdtemp(prefix="haze-csv-")
    from haze.schemas import RAW_SCHEMA

    names = [f.name for f in RAW_SCHEMA.fields]
    row = [dt.datetime(2024, 1, 1), "x", 1.0, 2.0] + [float(i) for i in range(12)]
    df = spark.createDataFrame([tuple(row)], RAW_SCHEMA)
    df.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(d + "/old")
    df.withColumn("city", F.lit("y")).write.option("header", True) \
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(d + "/new")
    old = files.read_raw_csv(spark, d + "/old")
    assert old.select(names).collect() == df.collect()
    u = files.union_sources(old.drop("precipitation"), files.read_raw_csv(spark, d + "/new"))
    assert u.count() == 2 and u.where("precipitation IS NULL").count() == 1


def test_latest_file_is_found_by_listing(spark, tmp_path):
    from haze.schemas import RAW_SCHEMA

    head = ",".join(f.name for f in RAW_SCHEMA.fields)
    for name, city, mtime in [("realtime_1.csv", "old", 100), ("historical_2.csv", "newest", 300), ("realtime_3.csv", "middle", 200), ("other.txt", "no", 400)]:
        path = tmp_path / name
        path.write_text(f"{head}\n2024-01-01T00:00:00,{city}," + ",".join(["1.0"] * 14) + "\n")
        os.utime(path, (mtime, mtime))
    rows = files.latest_raw_csv(spark, str(tmp_path), ("realtime_*.csv", "historical_*.csv")).collect()
    assert [r.city for r in rows] == ["newest"]
    assert [r.city for r in files.latest_raw_csv(spark, str(tmp_path), ("realtime_*.csv",)).collect()] == ["middle"]
    with pytest.raises(FileNotFoundError):
        files.latest_raw_csv(spark, str(tmp_path), ("none_*.csv",))


def test_copies_inside_a_batch_are_stored_once(spark):
    t = _table(spark)
    f = _features(spark, 10)
    assert t.append(f.union(f)) == 10 and t.append(f.union(f)) == 0 and t.read().count() == 10


def test_a_table_that_cannot_be_read_is_an_error(spark):
    t = _table(spark)
    t.append(_features(spark, 10))
    for folder, _, names in os.walk(t.path):
        for name in names:
            if name.endswith(".parquet"):
                with open(os.path.join(folder, name), "w") as f:
                    f.write("not parquet")
    with pytest.raises(Exception):
        t.append(_features(spark, 12))


def test_recreate_keeps_the_metadata(spark):
    t = _table(spark).create("about")
    t.append(_features(spark, 5))
    t.recreate(_features(spark, 3), force=True)
    assert os.path.exists(t.path + "/_haze_table.json") and t.exists() and t.read().count() == 3


def test_writes_of_one_date_are_dealt_out_by_city(spark):
    from haze.sources.store import _write_partitioned

    df = _features(spark, 10, "a").union(_features(spark, 10, "b"))
    out = tempfile.mkdtemp(prefix="haze-deal-")
    _write_partitioned(df, out, "overwrite")
    seen = spark.read.parquet(out)
    assert seen.count() == 20 and "event_date" in seen.columns


def test_time_texts_of_several_forms_and_zones(spark):
    times = ["2024-01-01T00:00", "2024-01-01 01:00", "2024-01-01T02:00:00", "soon", None]
    text = json.dumps({"city": "a", "latitude": 1.0, "longitude": 2.0, "hourly": {"time": times, "pm10": [1.0, 2.0, 3.0, 4.0, 5.0]}})
    texts = spark.createDataFrame([(text,)], "value string")
    got = {r.pm10: r.timestamp for r in payload.parse_payloads(texts, ["pm10"]).collect()}
    assert got == {float(h + 1): dt.datetime(2024, 1, 1, h) for h in range(3)}
    there = {r.pm10: r.timestamp for r in payload.parse_payloads(texts, ["pm10"], source_tz="Asia/Karachi").collect()}
    assert there[1.0] == dt.datetime(2023, 12, 31, 19)
    audit = payload.unparsed_times(texts, ["pm10"]).first()
    assert (audit.city, audit.rows, audit.unparsed_rows) == ("a", 5, 2)


def test_feature_list_sink(spark, tmp_path):
    files.write_feature_list(_features(spark), ["pm2_5", "AQI"], str(tmp_path / "list"))
    got = spark.read.json(str(tmp_path / "list")).orderBy("ordinal").collect()
    assert [r.feature for r in got] == ["pm2_5", "AQI"]


def test_feature_catalog(spark):
    cat = files.feature_catalog(_features(spark), ["pm2_5", "pm10", "hour"]).collect()
    assert [(r.feature, r.family, r.non_null) for r in cat] == [("pm2_5", "base", 48), ("pm10", "base", 48)]
