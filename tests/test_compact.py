import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from haze.sources import fs
from haze.sources.store import COMPACTED, READY, FeatureTable


@pytest.fixture
def table(spark):
    """Four days of two cities, one with most rows, appended in five parts."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=20 * i), city, float(i), 2.0 * i) for i in range(288) for city in "xy" if city == "x" or i % 12 == 0]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, city string, pm2_5 double, AQI double")
    t = FeatureTable(spark, tempfile.mkdtemp(prefix="haze-compact-") + "/t")
    for k in range(5):
        t.append(df.where(F.minute("timestamp") / 20 + F.hour("timestamp") % 2 * 3 == k))
    t.append(df)
    return t


def files(t):
    return {e.name[11:]: len(fs.listed(t.spark, e.path, "*.parquet")) for e in fs.listed(t.spark, t.path, "event_date=*")}


def rows(t):
    return sorted(map(tuple, t.read().collect()))


def test_same_rows_in_few_files(table):
    before, old = rows(table), files(table)
    assert len(before) == 288 + 24 and min(old.values()) > 3
    assert table.compact(dt.date(2024, 1, 2), dt.date(2024, 1, 3)) == 2
    assert {d: n for d, n in files(table).items() if n == 1}.keys() == {"2024-01-02", "2024-01-03"}
    assert rows(table) == before
    assert table.compact() == 2 and set(files(table).values()) == {1} and rows(table) == before
    assert table.compact() == 0  # nothing is left to do
    for f in table.spark.read.parquet(table.path).select("_metadata.file_path").distinct().collect():
        own = [(r.city, r.timestamp) for r in table.spark.read.parquet(f[0]).collect()]
        assert own == sorted(own)
    assert fs.listed(table.spark, table.path, f"{COMPACTED}*") == []


def test_a_large_date_keeps_as_many_files_as_its_bytes_ask_for(table):
    before, old = rows(table), files(table)
    sizes = {e.name[11:]: sum(f.size for f in fs.listed(table.spark, e.path, "*.parquet")) for e in fs.listed(table.spark, table.path, "event_date=*")}
    limit = max(sizes.values()) // 2 + 1
    table.compact(file_bytes=limit)
    assert all(n <= -(-sizes[d] // limit) < old[d] for d, n in files(table).items()) and rows(table) == before


@pytest.mark.parametrize("then", ["append", "replace", "compact"])
def test_a_swap_that_breaks_off_loses_nothing(table, monkeypatch, then):
    before, whole = rows(table), FeatureTable._swap

    def broken(self, staged):
        fs.delete(self.spark, f"{self.path}/event_date=2024-01-02")  # the worst moment: old files gone, new ones not there
        raise OSError("lost")

    monkeypatch.setattr(FeatureTable, "_swap", broken)
    with pytest.raises(OSError):
        table.compact()
    monkeypatch.setattr(FeatureTable, "_swap", whole)
    again = table.spark.createDataFrame([before[3]], table.read().schema)
    if then == "compact":
        table.compact()
    else:
        getattr(table, then)(again)
    assert rows(table) == before
    assert fs.listed(table.spark, table.path, f"{COMPACTED}*") == []


def test_staged_rows_that_are_not_whole_are_thrown_away(table):
    before = rows(table)
    path = f"{table.path}/{COMPACTED}half"
    table.spark.read.parquet(table.path).limit(3).withColumn("_part", F.lit(0)).write.parquet(path)
    assert not fs.exists(table.spark, f"{path}/{READY}")
    table.append(table.read())
    assert rows(table) == before and not fs.exists(table.spark, path)


def test_columns_of_some_files_only_are_kept(table):
    extra = FeatureTable(table.spark, table.path, columns=[*table.columns, "note"])
    extra.append(table.spark.createDataFrame([(dt.datetime(2024, 1, 2, 0, 5), "z", "kept")], "timestamp timestamp_ntz, city string, note string"))
    table.compact()
    assert [r.note for r in table.spark.read.option("mergeSchema", "true").parquet(table.path).where("city = 'z'").collect()] == ["kept"]


def test_empty_table(spark):
    assert FeatureTable(spark, tempfile.mkdtemp(prefix="haze-compact-") + "/none").compact() == 0
