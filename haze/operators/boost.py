"""Gradient boosting of regression trees for squared errors, grown best leaf first on quantile bins.

Rows are binned once and written. A round sums the residuals of its rows by (node, feature, bin), combined in each task
before the shuffle by arrays of these cells; what reaches the driver is bounded by leaves x features x bins, and checked. Residuals are summed as whole numbers of a
power of two, so the order of rows, partitions and retries can't change a tree, and the larger child of a split
is its parent less the smaller one, exactly.

Best-first order needs one split after another, but the gain of a leaf depends on its own rows only. So a pass splits all leaves
that could still be chosen (as many as leaves are missing, by gain) and the choice is made afterwards among known gains: the tree is the
same, and the passes are about as many as its levels.

Boosting stops after ``rounds`` trees, or when the loss of the validation rows has not improved for ``patience`` rounds; the
trees up to the best round are kept. Null features count as 0 (``learn._assembled``), NaN goes right, rows without a label are left out.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.session import scratch_path
from haze.sources import fs

#: Sums (nodes x features x bins) that one pass may bring to the driver.
MAX_SUMS = 1 << 24
#: Rounds between two tables of rows with their predictions; in between the last trees are column expressions.
ROUNDS_A_TABLE = 2
#: Rows of a batch that Python hands back.
BATCH = 100_000
NODE_SCHEMA = "tree int, id int, prediction double, cover double, left int, right int, feature int, threshold double"


@dataclass(eq=False)
class _Node:
    depth: int
    sums: np.ndarray | None  # features x bins x (residuals, rows)
    total: float = 0.0
    rows: int = 0
    gain: float = 0.0
    feature: int = -1
    bin: int = -1
    children: tuple[int, int] | None = None
    small: int = 0  # the child with fewer rows: 0 left, 1 right


class BoostedTrees:
    """A fitted model: the first tree is the labels' mean, the others add their steps."""

    def __init__(self, nodes: pd.DataFrame, losses: list[float], features_col: str = "features", prediction_col: str = "prediction"):
        self._nodes, self.losses = nodes.astype(dict.fromkeys(["tree", "id", "left", "right", "feature"], "int64")), losses
        self._features, self._prediction = features_col, prediction_col
        self.treeWeights = [1.0] * int(nodes["tree"].nunique())
        self.totalNumNodes = len(nodes)

    def getFeaturesCol(self) -> str:
        return self._features

    def getPredictionCol(self) -> str:
        return self._prediction

    def nodes(self) -> pd.DataFrame:
        return self._nodes.assign(categories=-1)

    def transform(self, df: DataFrame) -> DataFrame:
        """Appends the prediction; rows stay where they are."""
        shared = df.sparkSession.sparkContext.broadcast(_arrays(self._nodes))

        @F.pandas_udf("double")
        def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(predict(np.stack(batch.to_numpy()), *shared.value) if len(batch) else [], dtype="float64")

        return df.withColumn(self._prediction, predicted(vector_to_array(self._features)))

    def write(self) -> BoostedTrees:
        return self

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        meta = {"class": f"{type(self).__module__}.{type(self).__name__}", "losses": self.losses,
                "featuresCol": self._features, "predictionCol": self._prediction}
        rows = [tuple(r) for r in self._nodes.astype(object).itertuples(index=False)]
        spark.createDataFrame(rows, NODE_SCHEMA).coalesce(1).write.parquet(f"{path}/data")
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/metadata")

    @classmethod
    def load(cls, path: str) -> BoostedTrees:
        spark = SparkSession.active()
        meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/data").orderBy("tree", "id").toPandas()
        return cls(nodes, meta["losses"], meta["featuresCol"], meta["predictionCol"])


def _arrays(nodes: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """(root of each tree, left, right, feature, threshold, value), children as places in the arrays; a leaf is its own child."""
    ordered = nodes.sort_values(["tree", "id"])
    tree, place = ordered["tree"].to_numpy(), np.arange(len(ordered))
    roots = place[np.r_[True, tree[1:] != tree[:-1]]]
    first = roots[np.cumsum(np.r_[True, tree[1:] != tree[:-1]]) - 1]
    left, right = ordered["left"].to_numpy(), ordered["right"].to_numpy()
    inner = left >= 0
    return (roots, np.where(inner, first + left, place), np.where(inner, first + right, place), np.maximum(ordered["feature"].to_numpy(), 0),
            ordered["threshold"].to_numpy(), ordered["prediction"].to_numpy())


def predict(x: np.ndarray, roots, left, right, feature, threshold, value, block: int = 1 << 20) -> np.ndarray:
    """The sum of all trees for each row, in blocks of about ``block`` (row, tree) pairs."""
    out = np.empty(len(x))
    step = max(1, block // len(roots))
    for a in range(0, len(x), step):
        part = x[a:a + step]
        at = np.repeat(roots[None, :], len(part), axis=0)
        while True:
            goes_left = np.take_along_axis(part, feature[at], axis=1) <= threshold[at]
            after = np.where(goes_left, left[at], right[at])
            if (after == at).all():
                break
            at = after
        out[a:a + step] = value[at].sum(axis=1)
    return out


@dataclass(frozen=True)
class Booster:
    """Estimator with ``fit(df)``: ``features`` (vector), ``label`` and, if there, ``is_val`` (the validation rows)."""

    rounds: int = 100
    step: float = 0.1
    max_leaves: int = 31
    max_depth: int | None = None
    min_rows: int = 20
    ridge: float = 0.0
    bins: int = 255
    patience: int = 10
    validates: bool = field(default=True)

    def fit(self, df: DataFrame) -> BoostedTrees:
        spark = df.sparkSession
        val = F.col("is_val") if self.validates and "is_val" in df.columns else F.lit(False)
        rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), F.coalesce(val, F.lit(False)).alias("val"))
        rows = rows.where(F.col("y").isNotNull() & ~F.isnan("y"))
        first = rows.select(F.size("x")).first()
        if first is None:
            raise ValueError("no rows with a label")
        cuts = quantile_cuts(rows.where(~F.col("val")), first[0], self.bins)
        # a whole-number sum in 2**-20, the same for any order
        total, n = rows.where(~F.col("val")).agg(F.sum(F.floor(F.col("y") * F.lit(2.0 ** 20) + F.lit(0.5)).cast("decimal(28,0)")), F.count(F.lit(1))).first()
        if n == 0:
            raise ValueError("no training rows")
        base = int(total) / n / 2.0 ** 20
        paths = [scratch_path(spark, "boost")]
        try:
            rows.select(_binned(cuts)("x").alias("b"), "y", "val", F.lit(base).alias("pred")).write.parquet(paths[0])
            return self._boost(spark, paths, cuts, base, n)
        finally:
            for path in paths:
                fs.delete(spark, path)

    def _boost(self, spark: SparkSession, paths: list[str], cuts: list[np.ndarray], base: float, n: int) -> BoostedTrees:
        table = spark.read.parquet(paths[-1])
        trees, recent, losses = [], [], []
        loss, spread = _loss(table, "pred")
        best, best_round = math.inf if loss is None else loss, 0
        for r in range(1, self.rounds + 1):
            margin = " + ".join(["pred", *recent])
            tree = self._tree(table.where("NOT val"), margin, len(cuts), max(map(len, cuts)) + 1, n, spread)
            if len(tree) == 1:  # no split is left that gains
                break
            trees.append(tree)
            recent.append(_case(tree, lambda i: f"{self._value(tree[i])!r}D"))
            if len(recent) == ROUNDS_A_TABLE:
                paths.append(scratch_path(spark, "boost"))
                table.withColumn("pred", F.expr(" + ".join(["pred", *recent]))).write.parquet(paths[-1])
                table, recent = spark.read.parquet(paths[-1]), []
                fs.delete(spark, paths.pop(-2))
            loss, spread = _loss(table, " + ".join(["pred", *recent]))
            if loss is None:
                continue
            losses.append(loss)
            if loss < best:
                best, best_round = loss, r
            elif r - best_round >= self.patience:
                break
        kept = trees[:best_round] if losses else trees
        return BoostedTrees(self._frame(kept, cuts, base, n), losses)

    def _value(self, node: _Node) -> float:
        return self.step * node.total / (node.rows + self.ridge)

    def _frame(self, trees: list[list[_Node]], cuts: list[np.ndarray], base: float, n: int) -> pd.DataFrame:
        out = [(0, 0, float(base), float(n), -1, -1, -1, math.nan)]
        for t, tree in enumerate(trees, 1):
            for i, node in enumerate(tree):
                left, right = node.children or (-1, -1)
                inner = node.children is not None
                out.append((t, i, self._value(node), float(node.rows), left, right, node.feature if inner else -1,
                            float(cuts[node.feature][node.bin]) if inner else math.nan))
        return pd.DataFrame(out, columns=["tree", "id", "prediction", "cover", "left", "right", "feature", "threshold"])

    # ------------------------------------------------------------ one tree
    def _tree(self, rows: DataFrame, margin: str, m: int, width: int, n: int, spread: float) -> list[_Node]:
        """The tree's nodes, root first, children as places in the list."""
        # n residuals of at most ``spread`` stay below 2**62
        scale = 2.0 ** min(40, 61 - math.ceil(math.log2(n + 1)) - math.ceil(math.log2(max(spread, 2.0 ** -20))))
        known = [_Node(0, None)]
        known[0].sums = self._sums(rows, margin, "0", [0], m, width, scale)[0]
        self._best_split(known[0], scale)
        while True:
            leaves, chosen = self._choose(known)
            todo = self._open(known, leaves)
            if not todo:
                return self._compact(known, chosen)
            for i in todo:
                known[i].children = (len(known), len(known) + 1)
                known += [_Node(known[i].depth + 1, None), _Node(known[i].depth + 1, None)]
            small = [known[i].children[known[i].small] for i in todo]
            found = self._sums(rows, margin, _case(known, str), small, m, width, scale)
            for i, s in zip(todo, small):
                other = sum(known[i].children) - s
                known[s].sums, known[other].sums = found[s], known[i].sums - found[s]
                known[i].sums = None
                for child in known[i].children:
                    self._best_split(known[child], scale)

    def _choose(self, known: list[_Node]) -> tuple[list[int], set[int]]:
        """Best-first replay on what is known: (leaves, split nodes), up to the first leaf whose children aren't known."""
        leaves, chosen = [0], set()
        while len(leaves) < self.max_leaves:
            at = min(leaves, key=lambda i: (-known[i].gain, i))
            if known[at].gain <= 0 or known[at].children is None:
                break
            chosen.add(at)
            leaves.remove(at)
            leaves += known[at].children
        return leaves, chosen

    def _open(self, known: list[_Node], leaves: list[int]) -> list[int]:
        """The nodes to split in the next pass: none if the choice is complete, else as many as leaves are missing, the one
        that the choice waits for first. A node below leaves that aren't chosen yet counts by the least gain on its way."""
        waits = [i for i in leaves if known[i].gain > 0]
        if len(leaves) >= self.max_leaves or not waits:
            return []
        found, todo = [], [(i, known[i].gain) for i in waits]
        while todo:
            i, least = todo.pop()
            if known[i].children is None:
                found.append((-least, i))
            else:
                todo += [(c, min(least, known[c].gain)) for c in known[i].children if known[c].gain > 0]
        first = min(waits, key=lambda i: (-known[i].gain, i))
        rest = [i for _, i in sorted(found) if i != first]
        return [first, *rest][:self.max_leaves - len(leaves)]

    def _compact(self, known: list[_Node], chosen: set[int]) -> list[_Node]:
        out, todo = [], [(0, None, 0)]
        while todo:
            i, parent, side = todo.pop()
            node, place = known[i], len(out)
            out.append(node)
            if parent is not None:
                out[parent].children = (place, out[parent].children[1]) if side == 0 else (out[parent].children[0], place)
            if i in chosen:
                left, right = node.children
                todo += [(right, place, 1), (left, place, 0)]
            else:
                node.children = None
            node.sums = None
        return out

    def _best_split(self, node: _Node, scale: float) -> None:
        """Sets the node's totals and its best split: the largest gain, ties to the first feature and bin."""
        whole = node.sums[0].sum(axis=0)
        node.total, node.rows, node.gain = float(whole[0]) / scale, int(whole[1]), 0.0
        if self.max_depth is not None and node.depth >= self.max_depth:
            return
        left = node.sums.cumsum(axis=1)[:, :-1]
        n_left, n_right = left[..., 1], node.rows - left[..., 1]
        fits = (n_left >= max(1, self.min_rows)) & (n_right >= max(1, self.min_rows))
        if not fits.any():
            return
        g_left, g_right = left[..., 0] / scale, (whole[0] - left[..., 0]) / scale
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = g_left ** 2 / (n_left + self.ridge) + g_right ** 2 / (n_right + self.ridge) - node.total ** 2 / (node.rows + self.ridge)
        gain = np.where(fits, gain, -np.inf)
        node.feature, node.bin = (int(v) for v in np.unravel_index(gain.argmax(), gain.shape))
        # less than the noise of doubles is no gain
        found = float(gain[node.feature, node.bin])
        node.gain = found if found > 1e-9 * (1.0 + node.total ** 2 / (node.rows + self.ridge)) else 0.0
        node.small = 0 if n_left[node.feature, node.bin] <= n_right[node.feature, node.bin] else 1

    def _sums(self, rows: DataFrame, margin: str, place: str, wanted: list[int], m: int, width: int, scale: float) -> dict[int, np.ndarray]:
        """Sums of (residual, 1) by feature and bin for each wanted node."""
        if len(wanted) * m * width > MAX_SUMS:
            raise ValueError(f"{len(wanted)} nodes x {m} features x {width} bins are more than {MAX_SUMS} sums")
        at = rows.selectExpr("b", f"CAST(floor((y - ({margin})) * {scale!r}D + 0.5D) AS BIGINT) AS g", f"{place} AS node")
        if wanted != [0]:
            at = at.where(F.col("node").isin(wanted))
        cells = at.select("b", "g", F.col("node").cast("int").alias("node")).mapInArrow(_cells(wanted, m, width), "cell bigint, g bigint, n bigint")
        found = cells.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toArrow()
        cell = found["cell"].to_numpy()
        flat = np.zeros((len(wanted) * m * width, 2), dtype=np.int64)
        flat[cell, 0], flat[cell, 1] = found["g"].to_numpy(), found["n"].to_numpy()
        return {v: own for v, own in zip(wanted, flat.reshape(len(wanted), m, width, 2))}


def _cells(wanted: list[int], m: int, width: int):
    """A map over (b, g, node) to (cell, g, n): the sums of a partition by place of the node in ``wanted``, feature and bin. Its memory
    is that of the cells, MAX_SUMS at most; whole numbers, so the sums are exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(len(wanted) * m * width, np.int64), np.zeros(len(wanted) * m * width, np.int64)
        slot = np.zeros(max(wanted) + 1, np.int64)
        slot[wanted] = np.arange(len(wanted)) * (m * width)
        for batch in batches:
            bins = batch.column(0).flatten().to_numpy().reshape(-1, m)
            cell = slot[batch.column(2).to_numpy()][:, None] + np.arange(m) * width + bins
            np.add.at(sums, cell.ravel(), np.repeat(batch.column(1).to_numpy(), m))
            np.add.at(counts, cell.ravel(), 1)
        some = np.nonzero(counts)[0]
        for i in range(0, len(some), BATCH):
            at = some[i:i + BATCH]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at]), pa.array(counts[at])], names=["cell", "g", "n"])

    return run


def _case(tree: list[_Node], leaf) -> str:
    """SQL of the tree over the bins ``b``: ``leaf(i)`` of the leaf that a row reaches."""
    def part(i: int) -> str:
        node = tree[i]
        if node.children is None:
            return leaf(i)
        left, right = node.children
        return f"CASE WHEN b[{node.feature}] <= {node.bin} THEN {part(left)} ELSE {part(right)} END"

    return part(0)


def _loss(table: DataFrame, margin: str) -> tuple[float | None, float]:
    """(mean squared error of the validation rows or None, largest residual of the training rows)."""
    e = f"(y - ({margin}))"
    row = table.selectExpr(f"avg(CASE WHEN val THEN {e} * {e} END)", f"max(CASE WHEN NOT val THEN abs({e}) END)").first()
    return row[0], row[1]


def quantile_cuts(rows: DataFrame, m: int, bins: int) -> list[np.ndarray]:
    """Up to ``bins - 1`` ascending cut values for each of the ``m`` features, finite and distinct (ranks within 1 / 10000 of the rows)."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    found = rows.agg(*[F.percentile_approx(F.col("x")[i], shares, 10000) for i in range(m)]).first()
    return [np.unique(np.array([v for v in (values or []) if math.isfinite(v)])) for values in found]


def _binned(cuts: list[np.ndarray]):
    """Bins of a row's features: how many cuts lie below the value; NaN is above all."""
    @F.pandas_udf("array<smallint>")
    def binned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, len(cuts)))
            places = [np.searchsorted(c, x[:, i], side="left").astype(np.int16) for i, c in enumerate(cuts)]
            yield pd.Series(list(np.stack(places, axis=1)))

    return binned


def leafwise(**changes) -> Booster:
    """31 leaves, step 0.1, 20 rows a leaf, 255 bins, 100 rounds, stop after 10 flat ones: defaults of the best-first library."""
    return Booster(**{**dict(rounds=100, step=0.1, max_leaves=31, min_rows=20, ridge=0.0, bins=255, patience=10), **changes})


def depthwise(**changes) -> Booster:
    """Depth 6, step 0.3, ridge 1, 256 bins, 100 rounds, stop after 10 flat ones: defaults of the level-wise library."""
    return Booster(**{**dict(rounds=100, step=0.3, max_leaves=64, max_depth=6, min_rows=1, ridge=1.0, bins=256, patience=10), **changes})


__all__ = ["BoostedTrees", "Booster", "depthwise", "leafwise", "predict", "quantile_cuts"]
