"""CSV / Parquet raw files: scans, sinks, most recent file, union of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.schemas import RAW_SCHEMA
from haze.sources import fs


def read_raw_csv(spark: SparkSession, path: str, schema=RAW_SCHEMA, path_glob: str | None = None) -> DataFrame:
    """CSV with header and an explicit schema (no inference pass); NaN text -> NULL."""
    r = spark.read.schema(schema).option("header", True).option("nanValue", "NaN") \
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
    if path_glob:
        r = r.option("pathGlobFilter", path_glob)
    df = r.csv(path)
    dbl = [f.name for f in schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in dbl})


def write_raw(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append",
              partition_by=("event_date",)) -> None:
    """Raw / processed sink partitioned by event date, dealt out by (date, city), rows sorted by (city, timestamp)
    per file. ``append`` writes what it is given; ``raw_table`` keeps the key."""
    out = df.withColumn("event_date", F.to_date("timestamp")) if "event_date" in partition_by else df
    deal = [*partition_by, *(["city"] if "city" in out.columns else [])]
    out = out.repartition(*deal).sortWithinPartitions(*deal, "timestamp")
    w = out.write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def raw_table(spark: SparkSession, path: str):
    """The raw sink as a keyed table: each (city, timestamp) is stored once, however often it is landed."""
    from haze.sources.store import FeatureTable

    return FeatureTable(spark, path, name="raw_hourly", columns=[f.name for f in RAW_SCHEMA.fields])


def with_source_file(df: DataFrame) -> DataFrame:
    return df.withColumns({"source_file": F.col("_metadata.file_path"),
                           "source_mtime": F.col("_metadata.file_modification_time")})


def latest_file(spark: SparkSession, folder: str, patterns: tuple[str, ...] = ("*.csv",)) -> str | None:
    """Path of the most recently modified file whose name fits one of the patterns (ties: the last name).
    Lists the folder and reads nothing."""
    found = {e.path: e for p in patterns for e in fs.listed(spark, folder, p) if not e.is_dir}
    return max(found.values(), key=lambda e: (e.mtime, e.name)).path if found else None


def latest_raw_csv(spark: SparkSession, folder: str, patterns: tuple[str, ...] = ("*.csv",), schema=RAW_SCHEMA) -> DataFrame:
    """Rows of the most recent raw file only."""
    path = latest_file(spark, folder, patterns)
    if path is None:
        raise FileNotFoundError(f"no file fits {', '.join(patterns)} in {folder}")
    return read_raw_csv(spark, path, schema)


def union_sources(*frames: DataFrame) -> DataFrame:
    """Union by name; a column absent from one source is NULL there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def feature_catalog(df: DataFrame, wanted: list[str]) -> DataFrame:
    """(ordinal, feature, family, non_null) for the wanted features present in ``df``."""
    from haze.schemas import BASE_FEATURES, TIME_FEATURES

    present = [c for c in wanted if c in df.columns]
    fam = {c: "base" if c in BASE_FEATURES else "time" if c in TIME_FEATURES else "derived" for c in present}
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in present])
    structs = [F.struct(F.lit(i + 1).alias("ordinal"), F.lit(c).alias("feature"), F.lit(fam[c]).alias("family"),
                        F.col(c).alias("non_null")) for i, c in enumerate(present)]
    return counts.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def write_feature_list(df: DataFrame, wanted: list[str], path: str) -> None:
    """The feature catalog as JSON lines, one for each feature."""
    feature_catalog(df, wanted).write.mode("overwrite").json(path)
