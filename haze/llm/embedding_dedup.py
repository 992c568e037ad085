"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one vector kept of each group.

1. Equal vectors are one class with a weight, so copies never meet.
2. Spherical k-means (Spark ML, cosine distance) is fitted on a bounded sample:
   SAMPLE vectors for each cell, chosen by a hash; the number of cells grows
   with the root of the number of vectors. Every vector is assigned.
3. The nearest centre is a vector's own cell; it also visits the cells whose
   centres are less than MARGIN below it in cosine. In each cell the cell's
   own vectors are compared with all its visitors, in blocks of BLOCK by BLOCK,
   as one matrix product in double precision each. A pair is found if either
   vector visits the other's cell. For a pair at the threshold, the centres'
   cosines differ by about |x - y| |c - c'| / sqrt(dimensions) one way or the
   other, a third of MARGIN in 64 dimensions, so few are missed, and only
   such as lie near the threshold and between cells. ``margin=2`` compares everything.
4. A block pair gives counts of links by vector and a star for each of its
   connected parts, never the pairs, so that a group of m near copies gives
   O(m) rows. A cell with a third of all vectors is many block pairs, which
   Spark deals out to all tasks.

Rows: one per input row. Vectors that are null, zero, of another length than
most (the longer of two equally frequent), or that hold null or non-finite components
link with nothing, not even with copies; a null id takes part but can't be a component's least
id and isn't kept; rows that share an id are compared like others; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.llm.common import arrow_map, pick, written
from haze.llm.components import components

THRESHOLD = 0.9
#: How far below the nearest centre's cosine a visited cell's may be.
MARGIN = 0.2
#: Vectors of a block.
BLOCK = 2048
#: Vectors that the centres are fitted on, for each cell.
SAMPLE = 100
ITERATIONS = 4


def cells_for(n: int) -> int:
    return max(1, round(math.sqrt(n) / 4))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)
    # scaled first, so that very large and very small components neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centres(classes: DataFrame, n: int, k: int, seed: int = 42) -> np.ndarray:
    """Unit centres of spherical k-means, fitted on about SAMPLE * k of the n classes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if k == 1:
        return np.ones((1, 1))
    share = min(1.0, SAMPLE * k / n)
    sample = classes.where(F.pmod(F.xxhash64("d", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    top = F.array_max(F.transform("e", lambda v: F.abs(v)))
    sample = sample.select(array_to_vector(F.transform("e", lambda v: (v / top).cast("double"))).alias("v"))
    model = KMeans(k=k, distanceMeasure="cosine", initMode="random", maxIter=ITERATIONS, seed=seed, featuresCol="v").fit(sample)
    c = np.array(model.clusterCenters())
    norm = np.sqrt((c * c).sum(axis=1))
    c = c[norm > 0] / norm[norm > 0, None]
    return c if len(c) else np.ones((1, 1))


def _assigned(classes: DataFrame, c: np.ndarray, margin: float) -> DataFrame:
    """(d, w, e, cell, visits): own cell and all visited ones, its own among them."""
    shared = classes.sparkSession.sparkContext.broadcast(c)  # cells times dimensions; cells grow with the root of n

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            x, c = _matrix(part.column(2)), shared.value
            cos = x @ c.T if len(c) > 1 else np.ones((len(x), 1))
            own = cos.argmax(axis=1)
            near = cos >= cos.max(axis=1, keepdims=True) - margin
            at_, cells = np.nonzero(near)
            offsets = np.searchsorted(at_, np.arange(len(x) + 1)).astype(np.int32)
            visits = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.astype(np.int32)), visits],
                                             names=["d", "w", "e", "cell", "visits"])

    return arrow_map(classes, run, f"d bigint, w bigint, e {dict(classes.dtypes)['e']}, cell int, visits array<int>")


def compared(rows: pa.Table, threshold: float) -> pa.Table:
    """One block pair: (d, n, root): links that a vector has here, and the least vector that it is connected with."""
    cell = rows.column("cell")[0].as_py()
    rows = rows.combine_chunks()
    role = rows.column("visitor").to_numpy()
    a, b = rows.filter(pa.array(~role)), rows.filter(pa.array(role))
    empty = pa.table({"d": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    if not a.num_rows or not b.num_rows:
        return empty
    da, db = (t.column("d").to_numpy() for t in (a, b))
    wa, wb = (t.column("w").to_numpy() for t in (a, b))
    x, y = (_matrix(t.column("e").combine_chunks()) for t in (a, b))
    i, j = np.nonzero((x @ y.T >= threshold) & (da[:, None] != db[None, :]))
    if not len(i):
        return empty
    # A pair of two cells may be met in both; then it counts in the lower one. Within one cell each vector
    # is once its own and once a visitor, so only its own row counts.
    home = b.column("cell_own").to_numpy()
    lists = a.column("visits").combine_chunks()
    ends = lists.offsets.to_numpy()
    flat = lists.values.to_numpy()
    visits = np.zeros((len(da), int(max(flat.max(), home.max())) + 1), bool)
    visits[np.repeat(np.arange(len(da)), np.diff(ends)), flat[ends[0]:ends[-1]]] = True
    same = home[j] == cell
    counts = same | ~visits[i, home[j]] | (cell < home[j])
    na = np.bincount(i[counts], wb[j[counts]], len(da)).astype(np.int64)
    only = counts & ~same
    nb = np.bincount(j[only], wa[i[only]], len(db)).astype(np.int64)
    # least connected vector: minima pass along the links until none changes
    ra, rb = da.copy(), db.copy()
    while True:
        was = ra.sum(), rb.sum()
        np.minimum.at(ra, i, rb[j])
        np.minimum.at(rb, j, ra[i])
        if was == (ra.sum(), rb.sum()):
            break
    ia, jb = np.unique(i), np.unique(j)
    return pa.table({"d": np.concatenate([da[ia], db[jb]]), "n": np.concatenate([na[ia], nb[jb]]),
                     "root": np.concatenate([ra[ia], rb[jb]])})


def _links(assigned: DataFrame, threshold: float, block: int) -> DataFrame:
    """(d, n, root) of all block pairs of all cells."""
    own = assigned.groupBy("cell").agg(F.count("*").alias("own"))
    seen = assigned.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("seen"))
    blocks = written(own.join(seen, "cell").select("cell", F.ceil(F.col("own") / block).cast("int").alias("np"),
                                                   F.ceil(F.col("seen") / block).cast("int").alias("nq")), "blocks")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n, salt: F.pmod(F.xxhash64("d", F.lit(salt)), F.col(n)).cast("int")
    cols = ["d", "w", "e", "cell", "cell_own", "visits"]
    rows = assigned.withColumn("cell_own", F.col("cell"))
    a = rows.join(blocks, "cell").select(*cols, F.lit(False).alias("visitor"), part("np", 1).alias("p"), span("nq").alias("q"))
    no = F.lit(None).cast("array<int>").alias("visits")
    b = rows.select("d", "w", "e", F.explode("visits").alias("cell"), "cell_own").join(blocks, "cell").select(
        "d", "w", "e", "cell", "cell_own", no, F.lit(True).alias("visitor"), part("nq", 2).alias("q"), span("np").alias("p"))
    return a.unionByName(b).groupBy("cell", "p", "q").applyInArrow(
        lambda t: compared(t, threshold), "d bigint, n bigint, root bigint")


def near_dedup(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD,
               margin: float = MARGIN, block: int = BLOCK, cells: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    v = pick(vectors, vec_id=vec_id, e=embedding).withColumn("vec_id", F.col("vec_id").cast("bigint"))
    if dict(v.dtypes)["e"] != "array<float>":  # floats are moved as they are; cosines are in double precision either way
        v = v.withColumn("e", F.col("e").cast("array<double>"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("e", lambda x: x != 0)
    v = v.withColumn("e", F.when(fine, F.col("e")))
    most = v.where("e IS NOT NULL").groupBy(F.size("e").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = most["size"] if most else 0
    v = v.withColumn("e", F.when(F.size("e") == size, F.col("e")))
    v = v.withColumn("d", F.when(F.col("e").isNotNull(), F.xxhash64("e")))
    classes = written(v.where("e IS NOT NULL").groupBy("d").agg(
        F.count("*").alias("w"), F.first("e").alias("e"), F.min("vec_id").alias("least")), "vectors")
    n = classes.count()
    plain = classes.select("d", "w", "e")
    c = centres(plain, n, min(n, cells_for(n) if cells is None else cells)) if n > 1 else np.ones((1, 1))
    found = written(_links(written(_assigned(plain, c, margin), "assigned"), threshold, block), "found")
    roots = components(found.select("d", "root"))
    count = found.groupBy("d").agg(F.sum("n").alias("n"))
    own = classes.select("d", "w", "least").join(count, "d", "left").join(roots.withColumnRenamed("node", "d"), "d", "left")
    own = written(own.select("d", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n"),
                             F.coalesce("root", "d").alias("root"), "least"), "classes")
    reach = own.groupBy("root").agg(F.min("least").alias("component"))
    table = written(own.join(reach, "root").select(F.col("d").alias("_d"), "n", "component"), "components")
    component = F.when(F.col("d").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return v.select("vec_id", "d").join(table, F.col("d") == F.col("_d"), "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
