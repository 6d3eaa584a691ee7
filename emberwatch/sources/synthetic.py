"""Synthetic events for training, drawn from a hash of each row's id.

A hash draw does not depend on partitioning, task retries or row order, so a lost executor
recomputes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions.scoring import (
    destination_security, port_security, rule_score, source_security, to_severity,
)

NOISE = 5.0


class _Draws:
    """Independent draws cut from the 64 hex digits of one digest."""

    def __init__(self, digest: Column):
        self.digest = digest
        self.used = 0

    def integer(self, digits: int) -> Column:
        text = F.substring(self.digest, self.used + 1, digits)
        self.used += digits
        return F.conv(text, 16, 10).cast("bigint")

    def between(self, low: int, high: int, digits: int = 4) -> Column:
        return (self.integer(digits) % (high - low + 1) + low).cast("int")

    def address(self) -> Column:
        bounds = [(1, 254), (0, 254), (0, 254), (1, 254)]
        return F.concat_ws(".", *[self.between(*b).cast("string") for b in bounds])

    def centred(self, reach: float) -> Column:
        return self.integer(8).cast("double") / F.lit(float(2**32)) * (2 * reach) - reach


def synthesize(ids: DataFrame, key: str = "id", seed: int = 42) -> DataFrame:
    """One random event per id: uniform level, addresses and port, and the noisy rule as target."""
    draws = _Draws(F.col("digest"))
    rows = (
        ids.select(F.col(key).alias("id"))
        .withColumn("digest", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id")), 256))
        .select(
            "id",
            draws.address().alias("source_ip"),
            draws.address().alias("destination_ip"),
            draws.between(1, 65535, 8).alias("port"),
            draws.between(0, 15).alias("level"),
            draws.centred(NOISE).alias("noise"),
        )
    )
    # The target is drawn as if no address were listed.
    score = rule_score(
        F.col("level"),
        source_security(F.col("source_ip"), F.lit(False)),
        destination_security(F.col("destination_ip")),
        port_security(F.col("port")),
        F.col("noise"),
    )
    return rows.select(
        "id", "source_ip", "destination_ip", "port", "level",
        to_severity(score).alias("severity"), F.lit("pending").alias("status"),
    )


def synthetic_events(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    return synthesize(spark.range(n), "id", seed)
