"""Leaf-wise gradient boosting on weighted histograms.

The data is folded by one aggregation into cells: a row for each combination of feature values, with its
weight and the mean of its target (``model.fold``). That table is the joint histogram of the data;
its size is the product of the features' domains, whatever the number of rows, and it is checked
against MAX_CELLS before it is read. Trees grow on it best first: of all leaves, the one whose best
split gains most is split next, until there are LEAVES of them or no split gains.

All trees together are constant between their thresholds, so the model is a table over a small grid:
scoring looks each row's grid place up in an array literal, inside generated code, without
walking trees and without Python.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.operators.scoring import FEATURES

# Boosting settings.
TREES = 100
LEARNING_RATE = 0.1
LEAVES = 31
# A leaf holds the weight of at least this many training rows.
LEAST_ROWS = 20
# Bounds of what the driver holds: training cells, and places of the scoring grid.
MAX_CELLS = 200_000
MAX_GRID = 65_536

SPLITS = ("tree int, node int, low int, high int, feature string, threshold double, gain double, "
          "weight double, value double")


@dataclass
class Node:
    """A region of the feature space: its cells, and the split that parts it best."""

    cells: np.ndarray
    weight: float
    value: float
    number: int = 0
    gain: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None


def best_split(
    values: np.ndarray, residuals: np.ndarray, weights: np.ndarray, least: float
) -> tuple[float, int, float]:
    """Gain, feature and threshold of the split that lowers the weighted squared error most.

    Each feature's cells are summed by value into a histogram, whose running sums give the gain of every
    cut between neighbouring values. Of equal gains the first feature and lowest cut win. Feature -1
    means that no cut gains with ``least`` weight on both sides.
    """
    found = (0.0, -1, 0.0)
    total, mass = float((residuals * weights).sum()), float(weights.sum())
    for i in range(values.shape[1]):
        steps, place = np.unique(values[:, i], return_inverse=True)
        if len(steps) < 2:
            continue
        sums = np.bincount(place, residuals * weights)[:-1].cumsum()
        masses = np.bincount(place, weights)[:-1].cumsum()
        open_ = (masses >= least) & (mass - masses >= least)
        gains = np.where(open_, sums**2 / np.where(open_, masses, 1.0) + (total - sums) ** 2
                         / np.where(open_, mass - masses, 1.0) - total**2 / mass, 0.0)
        at = int(gains.argmax())
        if gains[at] > found[0] * (1 + 1e-12) + 1e-9:
            found = (float(gains[at]), i, float((steps[at] + steps[at + 1]) / 2))
    return found


def grow_tree(
    values: np.ndarray, residuals: np.ndarray, weights: np.ndarray, leaves: int = LEAVES,
    least: float = LEAST_ROWS,
) -> Node:
    """A tree grown best first; nodes are numbered in the order they came to be."""
    def node(cells: np.ndarray) -> Node:
        mass = float(weights[cells].sum())
        made = Node(cells, mass, float((residuals[cells] * weights[cells]).sum()) / mass)
        made.gain, made.feature, made.threshold = best_split(
            values[cells], residuals[cells], weights[cells], least)
        return made

    root = node(np.arange(len(values)))
    waiting, count, made = [(-root.gain, 0, root)], 1, 1
    while waiting and count < leaves:
        _, _, one = heapq.heappop(waiting)
        if one.feature < 0:
            break
        below = values[one.cells, one.feature] <= one.threshold
        one.low, one.high = node(one.cells[below]), node(one.cells[~below])
        for child in (one.low, one.high):
            child.number = made
            heapq.heappush(waiting, (-child.gain, made, child))
            made += 1
        count += 1
    return root


def nodes_of(root: Node) -> list[Node]:
    below = [n for child in (root.low, root.high) if child for n in nodes_of(child)]
    return sorted([root, *below], key=lambda n: n.number)


@dataclass
class LeafwiseModel:
    """Thresholds of each feature and the prediction of every place of the grid between them."""

    features: list[str]
    thresholds: list[list[float]]
    grid: np.ndarray
    splits: list[tuple] = field(default_factory=list)

    def _place(self) -> Column:
        """The row's place in the flattened grid; null if a feature is."""
        place = F.lit(0)
        for name, cuts in zip(self.features, self.thresholds):
            above = sum([(F.col(name) > F.lit(c)).cast("int") for c in cuts], F.lit(0))
            place = place * (len(cuts) + 1) + F.when(F.col(name).isNotNull(), above)
        return place

    def transform(self, rows: DataFrame) -> DataFrame:
        table = F.array(*[F.lit(float(v)) for v in self.grid.ravel()])
        return rows.withColumn("raw_score", F.get(table, self._place()))

    def save(self, spark: SparkSession, path: str) -> None:
        """The splits of all trees and the grid, as two tables."""
        spark.createDataFrame(self.splits, SPLITS).coalesce(1).write.mode("overwrite").parquet(
            f"{path}/splits")
        shape = "features array<string>, thresholds array<array<double>>, grid array<double>"
        row = (self.features, self.thresholds, self.grid.ravel().tolist())
        spark.createDataFrame([row], shape).coalesce(1).write.mode("overwrite").parquet(f"{path}/grid")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LeafwiseModel:
        row = spark.read.parquet(f"{path}/grid").first()
        grid = np.array(row.grid).reshape([len(c) + 1 for c in row.thresholds])
        splits = [tuple(r) for r in spark.read.parquet(f"{path}/splits").orderBy("tree", "node").collect()]
        return cls(list(row.features), [list(c) for c in row.thresholds], grid, splits)


def _predicted(root: Node, values: np.ndarray) -> np.ndarray:
    out = np.empty(len(values))
    waiting = [(root, np.arange(len(values)))]
    while waiting:
        one, rows = waiting.pop()
        if one.low is None:
            out[rows] = one.value
        else:
            below = values[rows, one.feature] <= one.threshold
            waiting += [(one.low, rows[below]), (one.high, rows[~below])]
    return out


def training_cells(folded: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """One row per combination of feature values: mean target and weight of the training rows."""
    return folded.filter("not held_out").groupBy(*features).agg(
        (F.sum(F.col("severity") * F.col("n")) / F.sum("n")).alias("severity"),
        F.sum("n").cast("double").alias("weight"),
    )


def fit_leafwise(
    folded: DataFrame, trees: int = TREES, learning_rate: float = LEARNING_RATE,
    leaves: int = LEAVES, least: float = LEAST_ROWS, features: Sequence[str] = FEATURES,
) -> LeafwiseModel:
    """Boost on the folded table of ``model.fold``: squared error, residuals of the mean first.

    The error of a cell's rows differs from that of their mean by a constant, so every split gains what
    it gains on the rows.
    """
    features = list(features)
    cells = training_cells(folded, features).limit(MAX_CELLS + 1).toPandas()
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} combinations of feature values; bin the features first")
    if cells.empty:
        raise ValueError("no training rows")
    cells = cells.sort_values(features)
    values = cells[features].to_numpy(float)
    target, weights = cells["severity"].to_numpy(float), cells["weight"].to_numpy(float)
    base = float((target * weights).sum() / weights.sum())
    scores, grown = np.full(len(target), base), []
    for _ in range(trees):
        root = grow_tree(values, target - scores, weights, leaves, least)
        grown.append(root)
        scores = scores + learning_rate * _predicted(root, values)
    cuts = [sorted({n.threshold for root in grown for n in nodes_of(root) if n.low and n.feature == i})
            for i in range(len(features))]
    shape = [len(c) + 1 for c in cuts]
    if np.prod(shape) > MAX_GRID:
        raise ValueError(f"more than {MAX_GRID} grid places; bin the features first")
    # A point between each two neighbouring thresholds, below the first and above the last.
    points = [np.array([*(c - 1e-9 for c in own), (own[-1] if own else 0.0) + 1.0]) for own in cuts]
    places = np.stack([m.ravel() for m in np.meshgrid(*points, indexing="ij")], axis=1)
    grid = base + learning_rate * sum(_predicted(root, places) for root in grown)
    splits = [
        (t, n.number, *((n.low.number, n.high.number, features[n.feature], n.threshold, n.gain)
                        if n.low else [None] * 5), n.weight, n.value)
        for t, root in enumerate(grown) for n in nodes_of(root)
    ]
    return LeafwiseModel(features, cuts, np.asarray(grid).reshape(shape), splits)
