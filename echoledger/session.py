"""Session construction and the shared folder for lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "echoledger", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Whole documents ride in Arrow batches: keep a batch to tens of MB.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


#: Rows of an Arrow batch at most where whole documents ride in it, and its bytes where whole blocks of them do.
BATCH_ROWS, BATCH_BYTES = 256, 24 * 1024 * 1024


def bound_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_ROWS and BATCH_BYTES, so that a Python worker's memory does not grow with its partition."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        given = spark.conf.get(name).rstrip("b")
        if not (given.isdigit() and 0 < int(given) <= most):
            spark.conf.set(name, most)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by the cluster; in local mode alone, a local one where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="echoledger-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: survives executor loss, ends the plan here.

    A Parquet table rather than an RDD checkpoint, so that later passes read only the
    columns they name.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder next to the checkpoints, one per run."""
    return os.path.join(checkpoint_root(spark), f"{label}-{uuid.uuid4().hex}")
