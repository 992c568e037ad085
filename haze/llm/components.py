"""Connected components of a graph of links, by alternating large-star and small-star steps.

Each round is a handful of grouped minima and joins; what a round makes is
written to the shared folder, so that the lineage stays short. Minima are
combined before the shuffle and the joins are plain ones, whose skewed keys
Spark splits, so a hub with most of the links is no hot spot.

Before that, tasks contract their links, up to FEW at once: of those that are
joined among themselves, each node keeps a link to the least one. If no more
than FEW are left in all, they are contracted once more instead of by steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.llm.common import release, written

#: Links that are contracted at once, in the memory of a task.
FEW = 100_000


def _contracted(e: DataFrame) -> DataFrame:
    """Edges (a, b) with a > b that join the same nodes: of up to FEW edges of a task at once, each node with the least one they reach."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        least: dict = {}

        def top(k):
            while (up := least.setdefault(k, k)) != k:
                least[k] = least[up]
                k = up
            return k

        for batch in held:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = top(a), top(b)
                if a != b:
                    least[max(a, b)] = min(a, b)
        found = [(k, r) for k in [*least] if (r := top(k)) != k]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], held[0].schema.field(i).type) for i in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= FEW:
                yield stars(held)
                held, n = [], 0
        if held:
            yield stars(held)

    return e.mapInArrow(run, e.schema)


def _stars(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a, b) with a > b."""
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    large = (both.where(F.col("b") > F.col("a")).join(low, F.col("a") == F.col("u"))
             .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
    least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    small = large.join(least, F.col("a") == F.col("u"))
    moved = small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (two columns of one type): root is the least node it reaches. A written table."""
    x, y = links.columns[:2]
    e = written(_contracted(links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a <> b")), "links")
    if e.count() <= FEW:
        stars = _contracted(e.coalesce(1))
    else:
        e, was = _followed(e, e.distinct()), None
        while True:
            now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if was == now:
                break
            was = now
            e = _followed(e, _stars(e))
        stars = e
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = written(roots.union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")
    release(e)
    return out


def _followed(e: DataFrame, following: DataFrame) -> DataFrame:
    """``following``, written, in place of ``e``, which it is made from."""
    out = written(following, "stars")
    release(e)
    return out
