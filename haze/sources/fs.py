"""Small file tasks through the Hadoop file system of the path, so that they work on any store that Spark reads."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    path: str
    name: str
    is_dir: bool
    mtime: int
    size: int


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def listed(spark: SparkSession, path: str, pattern: str = "*") -> list[Entry]:
    """Entries of a folder by name pattern; none if the folder isn't there."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    found = [Entry(s.getPath().toString(), s.getPath().getName(), bool(s.isDirectory()), int(s.getModificationTime()), int(s.getLen()))
             for s in fs.listStatus(p)]
    return sorted((e for e in found if fnmatch.fnmatch(e.name, pattern)), key=lambda e: e.name)


def has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet folder holds data: part files, or partition folders. Reads nothing, hides no read error."""
    return any((e.is_dir and "=" in e.name and e.name[0] not in "._") or e.name.endswith(".parquet") for e in listed(spark, path))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def make(spark: SparkSession, path: str) -> None:
    """The folder, if it isn't there."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)
