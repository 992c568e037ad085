"""Shared helpers of the text operators: column picking, Arrow maps, shared scratch tables, words and hashes."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.session import ensure_checkpoint_dir, scratch_path
from haze.sources import fs

#: Texts handed to one piece of Python work at once are cut at about this many bytes.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positions(df: DataFrame, names: Iterable[str]) -> list[int]:
    """Place of each named column: an exact match first, else one that differs in case; the first of several."""
    cols = df.columns
    low = [c.lower() for c in cols]
    out = []
    for n in names:
        if n in cols:
            out.append(cols.index(n))
        elif n.lower() in low:
            out.append(low.index(n.lower()))
        else:
            raise ValueError(f"no column {n} among {cols}")
    return out


def pick(df: DataFrame, **roles: str) -> DataFrame:
    """Only the columns of ``roles`` (new name = column), whatever else the table has, even names that clash."""
    at = positions(df, roles.values())
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{i}").alias(new) for new, i in zip(roles, at)])


def packed(df: DataFrame, **roles: str) -> DataFrame:
    """The whole row as the struct ``_row`` next to the columns of ``roles``; ``unpacked`` restores it."""
    at = positions(df, roles.values())
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(F.struct(*[F.col(c) for c in plain.columns]).alias("_row"),
                        *[F.col(f"_c{i}").alias(new) for new, i in zip(roles, at)])


def unpacked(df: DataFrame, names: list[str], replace: dict[int, str] | None = None) -> DataFrame:
    """Rows of ``packed`` under their names; ``replace`` puts a column of ``df`` in a place of the row."""
    replace = replace or {}
    return df.select(*[F.col(replace[i]) if i in replace else F.col(f"_row._c{i}") for i in range(len(names))]).toDF(*names)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: cuts the lineage, survives lost executors,
    and gives the planner the true size of what is joined next."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the folders of tables from ``written`` or ``step`` that nothing reads any more."""
    for df in frames:
        if (path := getattr(df, "_scratch", None)) is not None:
            fs.delete(df.sparkSession, path)


def step(df: DataFrame, name: str) -> DataFrame:
    """``written``, and lets Spark drop the shuffle files of this step and those before now: they go when the driver
    collects its garbage."""
    jvm = df.sparkSession.sparkContext._jvm
    jvm.System.gc()
    out = written(df, name)
    gc.collect()
    jvm.System.gc()
    return out


def shared_dir(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over every Arrow batch, handed to it in slices of about SLICE_BYTES of data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives large buffers back, so that idle workers stay small
        for batch in batches:
            n = batch.num_rows
            step = max(1, int(n * SLICE_BYTES / max(1, batch.nbytes)))
            for at in range(0, n, step):
                yield from fn(batch.slice(at, step))
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Gives freed memory back to the system where the C library can, as the worker may idle through later stages."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def utf8(column: pa.Array) -> list[bytes]:
    """The bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# ------------------------------------------------------------------ words
#: Bytes of the class [\x00-\x2F\x3A-\x60\x7B-\x7F] part words once A-Z are lower-cased; every byte of a
#: character past U+007F belongs to a word, so that bytes can stand for characters.
_WORDS = bytes(32 if (b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F)
               else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased."""
    return text.translate(_WORDS).split()


def blank_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased (bytes.split parts at just these bytes)."""
    return text.lower().split()


class WordHashes(dict):
    """64-bit hash of each word, kept for words seen before; emptied when full, as the hash is a function of the word."""

    def __init__(self, limit: int = 200_000, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising step of splitmix64, a one-to-one map of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every run of ``n`` consecutive words, from the hashes of the words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + m]
    return mix(out)


def glob_safe(name: str) -> str:
    return re.sub(r"\W+", "_", name)
