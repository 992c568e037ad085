"""Keyed feature table on Parquet: partitioned by event date, rows sorted by
(city, timestamp) inside each file.

Date partitions keep files large (a (city, date) layout would leave ~24 rows
per file and millions of files at many cities). A write is dealt out by
(date, city), in as many tasks as its size asks for (AQE merges small ones),
so one date with all cities is not one task; the sort makes Parquet
row-group statistics prune city filters.

Key (timestamp, city) is enforced on write: the batch is deduplicated, then
anti joined against the stored rows in its time range only, which reaches
the scan as partition filters on ``event_date`` plus row-group filters on
``timestamp``, so an append reads the touched dates, not the table. Whether
there is a table comes from the file system; a table that can't be read is an
error, never an empty one.

``replace`` takes the place of stored rows: the touched dates are read,
merged with the new rows, staged, and swapped by dynamic partition overwrite;
no other date is read or written. The staged rows are complete before a date is
swapped, so a run that fails can be repeated.

``compact`` writes the dates that hold many small files again, in as many
files as their bytes ask for. Rows are staged and marked before a date is swapped;
the next write repeats a swap that was broken off, before anything else, so no step
that fails loses a row.

A single writer per table is assumed (no transactional table format is available).
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from haze.operators.clean import dedup_first, lower_names, restore_names
from haze.schemas import FEATURES_STORED
from haze.sources import fs

META_FILE = "_haze_table.json"
COMPACTED, READY = "_compacted-", "_READY"  # folders of staged rows, and what marks them as whole


class FeatureTable:
    def __init__(self, spark: SparkSession, path: str, name: str = "aqi_features",
                 primary_key: tuple[str, ...] = ("timestamp", "city"), event_time: str = "timestamp",
                 columns: list[str] | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.name = name
        self.primary_key = [k.lower() for k in primary_key]
        self.event_time = event_time.lower()
        self.columns = columns or FEATURES_STORED

    # ------------------------------------------------------------ B4, B8, B9
    def _meta(self) -> str:
        return f"{self.path}/{META_FILE}"

    def exists(self) -> bool:
        """Metadata or data files are there, whether they can be read or not."""
        return fs.exists(self.spark, self._meta()) or fs.has_rows(self.spark, self.path)

    def create(self, description: str = "") -> FeatureTable:
        """Record key, event time and description once; idempotent."""
        if not fs.exists(self.spark, self._meta()):
            fs.write_text(self.spark, self._meta(), json.dumps({
                "name": self.name, "version": 1, "primary_key": self.primary_key,
                "event_time": self.event_time, "description": description}))
        return self

    def check(self) -> DataFrame:
        """One-row health report: exists, readable, rows, message."""
        exists = self.exists()
        readable, rows, msg = False, None, "missing"
        if exists:
            try:
                rows = self._scan().count()
                readable, msg = True, "readable"
            except Exception as exc:  # unreadable files
                msg = f"read failed: {exc.__class__.__name__}"
        return self.spark.createDataFrame([(self.name, exists, readable, rows, msg)],
                                          "name string, exists boolean, readable boolean, rows bigint, message string")

    def inspect(self) -> DataFrame:
        """Schema report with name problems (upper case, dots, spaces)."""
        fields = self._scan().schema.fields if self.exists() else []
        rows = []
        for f in fields:
            issue = None
            if f.name != f.name.lower():
                issue = "upper case"
            elif any(ch in f.name for ch in " .,;{}()"):
                issue = "invalid character"
            rows.append((f.name, f.dataType.simpleString(), f.nullable, issue))
        return self.spark.createDataFrame(rows, "feature string, type string, nullable boolean, issue string")

    # ------------------------------------------------------------ A4, A5, A7
    def _scan(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self, start=None, end=None, restore: bool = True) -> DataFrame:
        """Range scan, each end optional and inclusive; pruned by event_date partitions."""
        df = self._scan()
        ts = F.col(self.event_time)
        if start is not None:
            start = _naive(start)
            df = df.where((F.col("event_date") >= F.lit(start.date())) & (ts >= F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz")))
        if end is not None:
            end = _naive(end)
            df = df.where((F.col("event_date") <= F.lit(end.date())) & (ts <= F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz")))
        df = df.drop("event_date")
        return restore_names(df, self.columns, {"Timestamp": "timestamp", "City": "city"}) if restore else df

    def first_date(self) -> dt.date | None:
        """The earliest date that has a partition, from the folder's list."""
        dates = [e.name.partition("=")[2] for e in fs.listed(self.spark, self.path, "event_date=*") if e.is_dir]
        return min(map(dt.date.fromisoformat, dates), default=None)

    def read_local_dates(self, first: dt.date, last: dt.date, tz: str = "Asia/Karachi") -> DataFrame:
        """Backfill range in local dates, rewritten to instants so the filter reaches the scan."""
        from zoneinfo import ZoneInfo

        z = ZoneInfo(tz)
        start = dt.datetime.combine(first, dt.time(0), z).astimezone(dt.timezone.utc).replace(tzinfo=None)
        end_excl = dt.datetime.combine(last + dt.timedelta(days=1), dt.time(0), z).astimezone(dt.timezone.utc)
        end = (end_excl - dt.timedelta(microseconds=1)).replace(tzinfo=None)
        return self.read(start, end)

    def training_set(self, start=None, end=None, target: str = "AQI") -> DataFrame:
        df = self.read(start, end)
        if target not in df.columns:
            raise ValueError(f"the stored table has no column {target}")
        return df

    # ------------------------------------------------------------ B5, D2, B6, B7
    def conform(self, df: DataFrame, default_city: str = "Unknown") -> DataFrame:
        if "timestamp" not in df.columns:
            raise ValueError("rows to store need a timestamp column")
        if "city" not in df.columns:
            df = df.withColumn("city", F.lit(default_city))
        keep = [c for c in self.columns if c in df.columns]
        return lower_names(df.select(*keep))

    def new_rows(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` whose key is not stored yet (null timestamps removed)."""
        b = batch.where(F.col(self.event_time).isNotNull())
        if not fs.has_rows(self.spark, self.path):
            return b
        lo, hi = b.agg(F.min(self.event_time), F.max(self.event_time)).first()
        if lo is None:
            return b
        stored = self.read(lo, hi, restore=False).select(*self.primary_key)
        return b.join(stored, on=self.primary_key, how="left_anti")

    def append(self, df: DataFrame, default_city: str = "Unknown") -> int:
        """Idempotent keyed append; returns the number of rows written.

        The input is evaluated once, deduplicated (of rows with one key the
        least by its other columns stays) and staged to a fresh folder. The
        anti join then reads the staged rows and the table's files as they
        are listed now, so the new ones can be written beside them in one
        go; the write itself counts them.
        """
        self.create()
        self._recover()
        staging = f"{self.path}/_staging-{uuid.uuid4().hex[:12]}"
        batch = self.conform(df, default_city).where(F.col(self.event_time).isNotNull())
        try:
            dedup_first(batch, self.primary_key).write.parquet(staging)
            staged = self.spark.read.schema(batch.schema).parquet(staging)
            fresh = self.new_rows(staged)
            if not fresh.take(1):
                return 0
            count = Observation()
            _write_partitioned(fresh.observe(count, F.count(F.lit(1)).alias("n")), self.path, "append")
            return count.get["n"]
        finally:
            fs.delete(self.spark, staging)

    def replace(self, df: DataFrame, default_city: str = "Unknown") -> int:
        """Keyed upsert: rows take the place of those stored under their key, or are added; returns their number.

        Only the dates that ``df`` has are read and written again."""
        self.create()
        self._recover()
        staging, merged = (f"{self.path}/_staging-{uuid.uuid4().hex[:12]}" for _ in range(2))
        batch = self.conform(df, default_city).where(F.col(self.event_time).isNotNull())
        try:
            dedup_first(batch, self.primary_key).write.parquet(staging)
            staged = self.spark.read.schema(batch.schema).parquet(staging)
            dated = staged.withColumn("event_date", F.to_date("timestamp"))
            lo, hi, n = dated.agg(F.min("event_date"), F.max("event_date"), F.count(F.lit(1))).first()
            if not n:
                return 0
            rows = staged
            if fs.has_rows(self.spark, self.path):
                # a bound on the partitions, then just the dates of the batch
                stored = self._scan().where((F.col("event_date") >= F.lit(lo)) & (F.col("event_date") <= F.lit(hi)))
                stored = stored.join(dated.select("event_date").distinct(), "event_date", "left_semi")
                rows = stored.join(staged.select(*self.primary_key), self.primary_key, "left_anti").drop("event_date").unionByName(
                    staged, allowMissingColumns=True)
            rows.write.parquet(merged)
            _write_partitioned(self.spark.read.schema(rows.schema).parquet(merged), self.path, "overwrite", dynamic=True)
            return n
        finally:
            for folder in (staging, merged):
                fs.delete(self.spark, folder)

    def compact(self, first: dt.date | None = None, last: dt.date | None = None, file_bytes: int = 128 << 20) -> int:
        """Fewer files for the dates (of a range, each end optional and inclusive) that have more than one for each
        ``file_bytes``; returns the number of dates written again.

        Rows of a date are dealt to its files by a hash of their key, so a city with many rows fills all of them alike."""
        self._recover()
        todo = []
        for entry in fs.listed(self.spark, self.path, "event_date=*"):
            day = dt.date.fromisoformat(entry.name.partition("=")[2])
            if (first is None or day >= first) and (last is None or day <= last):
                sizes = [f.size for f in fs.listed(self.spark, entry.path, "*.parquet")]
                wanted = max(1, -(-sum(sizes) // file_bytes))
                if len(sizes) > wanted:
                    todo.append((day, wanted))
        if not todo:
            return 0
        rows = self.spark.read.option("mergeSchema", "true").parquet(self.path).where(F.col("event_date").isin([day for day, _ in todo]))
        wanted = self.spark.createDataFrame(todo, "event_date date, _files bigint")
        staged = f"{self.path}/{COMPACTED}{uuid.uuid4().hex[:12]}"
        part = F.pmod(F.xxhash64(*self.primary_key), F.col("_files")).alias("_part")
        rows.join(wanted, "event_date").select(*rows.columns, part).write.parquet(staged)
        fs.write_text(self.spark, f"{staged}/{READY}", "")
        self._swap(staged)
        return len(todo)

    def _swap(self, staged: str) -> None:
        _write_partitioned(self.spark.read.parquet(staged), self.path, "overwrite", dynamic=True, part="_part")
        fs.delete(self.spark, staged)

    def _recover(self) -> None:
        """Repeats the swap of a compaction that was broken off; staged rows that aren't whole are thrown away."""
        for entry in fs.listed(self.spark, self.path, f"{COMPACTED}*"):
            if fs.exists(self.spark, f"{entry.path}/{READY}"):
                self._swap(entry.path)
            else:
                fs.delete(self.spark, entry.path)

    def recreate(self, df: DataFrame, force: bool = False) -> DataFrame:
        """Drop and rewrite the table; requires explicit opt-in."""
        if not force:
            raise PermissionError("recreate needs force=True")
        batch = dedup_first(self.conform(df).where(F.col(self.event_time).isNotNull()), self.primary_key)
        _write_partitioned(batch, self.path, "overwrite")
        self.create()  # after the overwrite, which clears the folder
        return self.read()

    def view(self, view_name: str | None = None) -> str:
        name = view_name or f"{self.name}_view"
        self.read().createOrReplaceTempView(name)
        return name


def _naive(t) -> dt.datetime:
    if isinstance(t, str):
        t = dt.datetime.fromisoformat(t)
    if isinstance(t, dt.date) and not isinstance(t, dt.datetime):
        t = dt.datetime.combine(t, dt.time(0))
    if t.tzinfo is not None:
        t = t.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return t


def _write_partitioned(df: DataFrame, path: str, mode: str, dynamic: bool = False, part: str = "city") -> None:
    """Rows dealt out by (event date, ``part``), each file sorted by city then time; ``dynamic`` overwrites only the dates of ``df``."""
    dealt = df.withColumn("event_date", F.to_date("timestamp")).repartition("event_date", part).sortWithinPartitions("event_date", "city", "timestamp")
    (dealt.drop("_part").write.mode(mode).option("partitionOverwriteMode", "dynamic" if dynamic else "static")
     .partitionBy("event_date").parquet(path))
