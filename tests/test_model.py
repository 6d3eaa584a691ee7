import pytest
from pyspark.sql import functions as F

from emberwatch.operators import model
from emberwatch.operators.scoring import FEATURES, with_rule_severity
from emberwatch.sources.synthetic import synthesize, synthetic_events

TREES = 12


@pytest.fixture(scope="module")
def trained(spark):
    folded = model.fold(model.training_features(synthetic_events(spark, 1000)))
    return model.fit(folded, TREES), folded


def test_synthetic_rows(spark):
    events = synthetic_events(spark, 1000)
    row = events.agg(
        F.count("*").alias("n"), F.min("level").alias("l0"), F.max("level").alias("l1"),
        F.min("port").alias("p0"), F.max("port").alias("p1"), F.min("severity").alias("s0"),
        F.max("severity").alias("s1"), F.countDistinct("source_ip").alias("ips"),
    ).first()
    assert (row.n, row.l0, row.l1) == (1000, 0, 15)
    assert row.p0 >= 1 and row.p1 <= 65535 and row.s0 >= 0 and row.s1 <= 100 and row.ips > 990
    octets = events.select(F.split("source_ip", r"\.").alias("o")).select(
        *[F.col("o")[i].cast("int").alias(f"o{i}") for i in range(4)])
    assert octets.filter("o0 not between 1 and 254 or o3 not between 1 and 254 "
                         "or o1 > 254 or o2 > 254").count() == 0
    # The same ids give the same rows however they are partitioned; another seed does not.
    again = synthesize(spark.range(1000).repartition(7), "id")
    assert again.exceptAll(events).count() == 0
    assert synthetic_events(spark, 1000, 7).intersect(events).count() < 10


def test_fold_counts_every_row(trained):
    _, folded = trained
    assert folded.agg(F.sum("n")).first()[0] == 1000
    held = folded.filter("held_out").agg(F.sum("n")).first()[0]
    assert 150 < held < 250


def test_error_bound_and_order(spark, trained):
    fitted, folded = trained
    result = model.mean_absolute_error(fitted, folded).first()
    assert result.test_rows == folded.filter("held_out").agg(F.sum("n")).first()[0]
    assert result.mae < 6
    levels = spark.createDataFrame([(i, 3, 3, 0) for i in range(16)],
                                   ", ".join(f"{name} int" for name in FEATURES))
    scored = model.score(fitted, levels).orderBy("level").collect()
    severities = [r.severity for r in scored]
    # Few noisy rows per level: neighbours may swap, the trend may not.
    assert all(b >= a - 5 for a, b in zip(severities, severities[1:]))
    assert severities[-1] - severities[0] > 40
    rule = with_rule_severity(levels).orderBy("level").collect()
    assert sum(a.label == b.label for a, b in zip(scored, rule)) >= 12
    assert {r.status for r in scored} == {"scored"}


def test_folding_fits_as_rows_do(spark, trained):
    """Weighting folded cells gives the model that the single rows give."""
    fitted, folded = trained
    rows = folded.filter("not held_out").select(
        "held_out", *FEATURES, "severity", F.explode(F.expr("sequence(1L, n)")).alias("_")
    ).select("held_out", *FEATURES, "severity", F.lit(1).alias("n"))
    by_rows = model.fit(rows, 2)
    by_cells = model.fit(folded, 2)
    cells = folded.select(*FEATURES).distinct()
    both = by_rows.transform(cells).select(*FEATURES, F.col("raw_score").alias("a")).join(
        by_cells.transform(cells).select(*FEATURES, F.col("raw_score").alias("b")), FEATURES)
    assert both.filter("abs(a - b) > 1e-6").count() == 0


def test_saved_model_scores_alike(spark, trained, folder):
    fitted, folded = trained
    path = folder("model")
    model.save(fitted, path)
    cells = folded.select(*FEATURES).distinct()
    one, two = model.score(fitted, cells), model.score(model.load(path), cells)
    assert one.exceptAll(two).count() == 0
