"""Exact Shapley values of tree models, for every row.

The value of a set of features at a row is the tree's mean prediction with those features known: at a split on
one of them the row's side is taken, at others both sides, by their shares of the training rows. A leaf with path features P
adds value * prod(o in S) * prod(z in P - S) to the set S, where o tells whether the row meets the
path's conditions on a feature and z is the product of the shares of that feature's splits. The sum over all sets, with
Shapley's weights, is the integral over t in [0, 1] of a polynomial (the weights are Beta integrals):

    contribution of i = value * (o_i - z_i) * integral of prod over j in P - {i} of (z_j (1 - t) + o_j t) dt

which Gauss-Legendre quadrature of half its degree gives exactly. Contributions add up to the prediction less
``expected_value``. The table of leaves is broadcast: it is bounded by the model, and its size is checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.operators.boost import BoostedTrees
from haze.session import scratch_path
from haze.sources import fs

#: Bytes of leaf tables that are broadcast at most.
MAX_LEAF_BYTES = 1 << 30
#: Numbers of one block of (rows x leaves x features) in a task.
BLOCK = 1 << 21


@dataclass(frozen=True)
class Leaves:
    """Leaves of all trees: weighted value, and for every feature the interval (low, high] and the share of its splits."""

    value: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray

    @property
    def expected(self) -> float:
        return float((self.value * self.share.prod(axis=1)).sum())


def tree_nodes(spark: SparkSession, model) -> pd.DataFrame:
    """A row for each node of a tree, forest or boosted model: (tree, id, prediction, cover, left, right, feature, threshold, categories)."""
    if isinstance(model, BoostedTrees):
        return model.nodes()
    path = scratch_path(spark, "model")
    model.write().save(path)
    try:
        saved = spark.read.parquet(f"{path}/data")
        node = "nodeData" if "nodeData" in saved.columns else None
        col = (lambda c: F.col(f"{node}.{c}")) if node else F.col
        rows = saved.select(F.col("treeID").alias("tree") if node else F.lit(0).alias("tree"), col("id").alias("id"), col("prediction").alias("prediction"),
                            col("impurityStats")[0].alias("cover"), col("leftChild").alias("left"), col("rightChild").alias("right"),
                            col("split.featureIndex").alias("feature"), F.get(col("split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"),
                            col("split.numCategories").alias("categories"))
        return rows.toPandas()  # as large as the model, which the driver holds
    finally:
        fs.delete(spark, path)


def _weights(model) -> list[float]:
    """The weight of each tree: boosted models add their trees up, forests take the mean."""
    weights = list(getattr(model, "treeWeights", [1.0]))
    return weights if type(model).__name__.startswith(("GBT", "Boosted")) else [1.0 / len(weights)] * len(weights)


def model_leaves(spark: SparkSession, model, n_features: int) -> Leaves:
    """The leaves of ``model``; raises where their tables are larger than ``MAX_LEAF_BYTES`` or a split is by categories."""
    size = getattr(model, "totalNumNodes", None) or model.numNodes
    if size * n_features * 12 > MAX_LEAF_BYTES:  # half of the nodes are leaves, with three numbers a feature
        raise ValueError(f"{size} nodes of {n_features} features are more than {MAX_LEAF_BYTES} bytes of leaves")
    weights, found = _weights(model), []
    for tree, nodes in tree_nodes(spark, model).groupby("tree"):
        by_id = {n.id: n for n in nodes.itertuples(index=False)}
        todo = [(0, np.full(n_features, -np.inf), np.full(n_features, np.inf), np.ones(n_features))]
        while todo:
            at, low, high, share = todo.pop()
            node = by_id[at]
            if node.left < 0:
                found.append((weights[tree] * node.prediction, low, high, share))
                continue
            if node.categories >= 0:
                raise ValueError("splits by categories have no interval")
            for child, bound, cut in ((node.left, high, min), (node.right, low, max)):
                edge, part = bound.copy(), share.copy()
                edge[node.feature] = cut(edge[node.feature], node.threshold)
                part[node.feature] *= by_id[child].cover / node.cover
                todo.append((child, low, edge, part) if bound is high else (child, edge, high, part))
    value, low, high, share = zip(*found)
    return Leaves(np.array(value), np.array(low), np.array(high), np.array(share))


def contributions(x: np.ndarray, leaves: Leaves) -> np.ndarray:
    """Rows x features -> contributions of the same shape, in blocks of ``BLOCK`` numbers."""
    n, m = x.shape
    used = np.isfinite(leaves.low) | np.isfinite(leaves.high)
    points, widths = np.polynomial.legendre.leggauss(max(1, (int(used.sum(axis=1).max()) + 1) // 2))
    points, widths = (points + 1) / 2, widths / 2
    out = np.zeros((n, m))
    leaves_at_once = max(1, min(len(leaves.value), BLOCK // m))
    rows_at_once = max(1, BLOCK // (m * leaves_at_once))
    for a in range(0, n, rows_at_once):
        part = x[a:a + rows_at_once, None, :]
        for b in range(0, len(leaves.value), leaves_at_once):
            cut = slice(b, b + leaves_at_once)
            low, high, z = leaves.low[None, cut], leaves.high[None, cut], leaves.share[None, cut]
            # a value that isn't at most the threshold goes right, NaN too
            o = ((low == -np.inf) | ~(part <= low)) & ((high == np.inf) | (part <= high))
            for t, width in zip(points, widths):
                factor = np.where(o, z + (1 - z) * t, z * (1 - t))
                whole = factor.prod(axis=2) * (leaves.value[cut] * width)
                out[a:a + rows_at_once] += np.einsum("rl,rlf->rf", whole, (o - z) / factor)
    return out


def tree_shapley(df: DataFrame, model, features: list[str], keep: list[str], leaves: Leaves | None = None) -> DataFrame:
    """Columns ``keep``, feature, contribution: a row for each row of ``df`` and feature; absent values count as 0, as in ``learn.score``.

    No shuffle: rows are explained where they are, in Arrow batches."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(leaves or model_leaves(spark, model, len(features)))
    inputs = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(features)]
    rows = df.select(F.struct(*keep).alias("_keep"), F.array(*inputs).alias("_x"))

    @F.pandas_udf("array<double>")
    def explained(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, len(features)))
            yield pd.Series(list(contributions(x, shared.value)))

    names = F.array(*[F.lit(c) for c in features])
    both = rows.select("_keep", F.explode(F.arrays_zip(names.alias("feature"), explained("_x").alias("contribution"))).alias("_c"))
    return both.select(*[F.col("_keep")[c].alias(c) for c in keep], F.col("_c.feature").alias("feature"), F.col("_c.contribution").alias("contribution"))


__all__ = ["Leaves", "contributions", "model_leaves", "tree_nodes", "tree_shapley"]
