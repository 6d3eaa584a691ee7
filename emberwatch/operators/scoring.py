"""Features, severity and label for whole frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.scoring import (
    COMMON_PORTS, destination_security, label_of, port_security, rule_score, source_security,
    to_severity,
)

FEATURES = ["level", "source_ip_security", "destination_ip_security", "port_security"]


def with_features(events: DataFrame, ports: Sequence[int] = COMMON_PORTS) -> DataFrame:
    """Add the three security features; ``listed`` must be there already."""
    return events.select(
        "*",
        source_security(F.col("source_ip"), F.col("listed")).alias("source_ip_security"),
        destination_security(F.col("destination_ip")).alias("destination_ip_security"),
        port_security(F.col("port"), ports).alias("port_security"),
    )


def with_rule_severity(features: DataFrame) -> DataFrame:
    """Score by the noise-free rule."""
    score = rule_score(*[F.col(name) for name in FEATURES])
    return with_label(features, to_severity(score, F.col("level").isNotNull()))


def with_label(features: DataFrame, severity: Column) -> DataFrame:
    return (
        features.withColumn("severity", severity)
        .withColumn("label", label_of(F.col("severity")))
        .withColumn("status", F.lit("scored"))
    )
