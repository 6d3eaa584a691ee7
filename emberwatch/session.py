"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


# Generated methods above this size are never compiled to machine code by the JVM. The text
# expressions here exceed it, and run twice as fast as separate projections of small methods.
METHOD_LIMIT = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def apply_settings(spark: SparkSession) -> None:
    """The run-time settings of the package, for a session built elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for key, value in METHOD_LIMIT.items():
        spark.conf.set(key, value)


def build_session(app: str = "emberwatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the package is tested with.

    Shuffle width, memory and the checkpoint folder belong to the cluster and are left to it.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in {**METHOD_LIMIT, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Root for written tables, stream state and checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local master may use a
    folder in the session's warehouse; on a cluster the setting is needed.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/emberwatch-scratch"
        spark.conf.set(CHECKPOINT_CONF, root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, so that a lost executor does not rescan for them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; one per run, never reused."""
    return f"{shared_dir(spark)}/emberwatch/{name}-{uuid.uuid4().hex}"
