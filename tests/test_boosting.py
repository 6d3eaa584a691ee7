import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.operators import boosting, model
from emberwatch.operators.scoring import FEATURES
from emberwatch.sources.synthetic import synthetic_events


@pytest.fixture(scope="module")
def folded(spark):
    return model.fold(model.training_features(synthetic_events(spark, 1000)))


def error(target, weights):
    return float((weights * (target - np.average(target, weights=weights)) ** 2).sum())


def brute_split(values, target, weights, least):
    """The best gain as the fall of the squared error, over every feature and cut."""
    best = 0.0
    for i in range(values.shape[1]):
        for cut in np.unique(values[:, i])[:-1]:
            low = values[:, i] <= cut
            if weights[low].sum() >= least and weights[~low].sum() >= least:
                fall = error(target, weights) - error(target[low], weights[low])
                best = max(best, fall - error(target[~low], weights[~low]))
    return best


def test_every_split_gains_what_brute_force_finds(spark, folded):
    """Over the cells of the events: gains, their order, and the number of leaves."""
    cells = boosting.training_cells(folded).toPandas()
    values, weights = cells[FEATURES].to_numpy(float), cells["weight"].to_numpy(float)
    target = cells["severity"].to_numpy(float)
    root = boosting.grow_tree(values, target, weights)
    nodes = boosting.nodes_of(root)
    leaves = [n for n in nodes if n.low is None]
    assert len(leaves) <= boosting.LEAVES and len(nodes) == 2 * len(leaves) - 1
    for n in nodes:
        want = brute_split(values[n.cells], target[n.cells], weights[n.cells], boosting.LEAST_ROWS)
        assert n.gain == pytest.approx(want, rel=1e-6, abs=1e-6)
        assert n.value == pytest.approx(np.average(target[n.cells], weights=weights[n.cells]))
        assert n.weight >= boosting.LEAST_ROWS
    # Best first: of the nodes that were there, the one that gained most was split.
    for made in (n for n in nodes if n.low):
        there = [n for n in nodes if n.number < made.low.number
                 and (n.low is None or n.low.number >= made.low.number)]
        assert made.gain == max(n.gain for n in there)


def test_growth_stops_at_the_leaves_and_without_gain():
    draw = np.random.default_rng(4)
    values = draw.integers(0, 50, (400, 3)).astype(float)
    target, weights = draw.normal(0, 1, 400), np.ones(400)
    root = boosting.grow_tree(values, target, weights, leaves=7, least=1)
    assert sum(n.low is None for n in boosting.nodes_of(root)) == 7
    flat = boosting.grow_tree(values, np.zeros(400), weights)
    assert flat.low is None and flat.value == 0


def test_error_is_not_above_that_of_the_level_wise_model(spark, folded):
    # The level-wise trees start from a whole first tree and are done after few.
    level = model.mean_absolute_error(model.fit(folded, 25), folded).first()
    leaf = model.mean_absolute_error(boosting.fit_leafwise(folded), folded).first()
    assert leaf.test_rows == level.test_rows and leaf.mae <= level.mae


def test_the_grid_scores_as_the_trees_do(spark, folded, folder):
    """Scores of cells, of values between and beyond them, and of a loaded copy; null stays null."""
    fitted = boosting.fit_leafwise(folded, 5)
    rows = [(level, s, d, p) for level in (-1, 0, 7, 15, 99) for s in (0, 3, 13) for d in (0, 3, 5, 8)
            for p in (0, 5)] + [(None, 0, 0, 0)]
    asked = spark.createDataFrame(rows, ", ".join(f"{f} int" for f in FEATURES))
    path = folder("leafwise")
    fitted.save(spark, path)
    loaded = boosting.LeafwiseModel.load(spark, path)
    assert loaded.splits == fitted.splits
    got = {tuple(r)[:4]: r.raw_score for r in fitted.transform(asked).collect()}
    again = {tuple(r)[:4]: r.raw_score for r in loaded.transform(asked).collect()}
    assert got == again and got.pop((None, 0, 0, 0)) is None
    trees = {}
    for tree, node, *rest in fitted.splits:
        trees.setdefault(tree, {})[node] = rest
    base = folded.filter("not held_out").agg(
        F.sum(F.col("severity") * F.col("n")) / F.sum("n")).first()[0]
    for row, score in got.items():
        want = base
        for nodes in trees.values():
            low, high, feature, threshold, _, _, value = nodes[0]
            while feature:
                at = low if row[FEATURES.index(feature)] <= threshold else high
                low, high, feature, threshold, _, _, value = nodes[at]
            want += boosting.LEARNING_RATE * value
        assert score == pytest.approx(want)
