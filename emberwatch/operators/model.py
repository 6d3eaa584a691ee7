"""The learned scorer: boosted trees over the four features."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions.scoring import to_severity
from emberwatch.operators.membership import Lookup, flag_listed
from emberwatch.operators.scoring import FEATURES, with_features, with_label
from emberwatch.session import checkpointed
from emberwatch.sources.synthetic import synthetic_events

# Boosting settings and the share held out.
TREES = 100
LEARNING_RATE = 0.1
DEPTH = 5
TEST_SHARE = 0.2
SEED = 42


def training_features(events: DataFrame, blocklist: Lookup | None = None) -> DataFrame:
    """Features and the target ``severity``, with the row id for the split."""
    flagged = (
        flag_listed(events, blocklist) if blocklist else events.withColumn("listed", F.lit(False))
    )
    return with_features(flagged).select("id", *FEATURES, "severity")


def fold(features: DataFrame, seed: int = SEED) -> DataFrame:
    """Split train from test rows, then count equal rows, in one pass over the data.

    The split is a digest of the id, the same on every run and partitioning. The features and the
    target take few values, so what is left is a small table however many rows went in. It is
    checkpointed: boosting reads it many times.
    """
    digest = F.sha2(F.concat_ws(":", F.lit("split"), F.lit(str(seed)), F.col("id")), 256)
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 1000
    held_out = (bucket < int(TEST_SHARE * 1000)).alias("held_out")
    return checkpointed(
        features.groupBy(held_out, *FEATURES, "severity").agg(F.count("*").alias("n"))
    )


def fit(
    folded: DataFrame, trees: int = TREES, learning_rate: float = LEARNING_RATE,
    depth: int = DEPTH, seed: int = SEED,
) -> PipelineModel:
    """Fit on feature cells instead of rows.

    Training rows that share all features become one, with their mean target and their count as
    weight. The squared error differs from that of the rows by a constant, so every split gains
    the same, and boosting cost does not grow with the data.
    """
    cells = folded.filter(~F.col("held_out")).groupBy(*FEATURES).agg(
        (F.sum(F.col("severity") * F.col("n")) / F.sum("n")).alias("severity"),
        F.sum("n").cast("double").alias("weight"),
    )
    regressor = GBTRegressor(
        featuresCol="features", labelCol="severity", weightCol="weight", predictionCol="raw_score",
        maxIter=trees, stepSize=learning_rate, maxDepth=depth, seed=seed,
    )
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    return Pipeline(stages=[assembler, regressor]).fit(cells)


def mean_absolute_error(model: PipelineModel, folded: DataFrame) -> DataFrame:
    """One row: held-out rows and the mean absolute error over them.

    Equal rows have equal errors, so each distinct one is predicted once and counted.
    """
    miss = F.abs(F.col("severity") - F.col("raw_score"))
    return model.transform(folded.filter("held_out")).agg(
        F.sum("n").alias("test_rows"), (F.sum(miss * F.col("n")) / F.sum("n")).alias("mae")
    )


def score(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Predict, clip and label all rows in one pass over the partitions."""
    predicted = model.transform(features)
    severity = to_severity(F.col("raw_score"))
    return with_label(predicted, severity).drop("features", "raw_score")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def train_model(
    spark: SparkSession, blocklist: Lookup | None = None, n: int = 1000, trees: int = TREES
) -> tuple[PipelineModel, DataFrame]:
    """Generate, featurise, split, fit and evaluate."""
    folded = fold(training_features(synthetic_events(spark, n), blocklist))
    model = fit(folded, trees)
    return model, mean_absolute_error(model, folded)
