"""Where jobs put intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    The session names it in ``spark.checkpoint.dir``; only where that is unset on a local
    master (tests on one machine) is a temporary folder used. On a cluster each executor
    would write to its own disk, so the setting is required there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="run-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once as Parquet and read it back: cuts the lineage, survives the
    loss of executors, and keeps column pruning for the jobs that follow."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows in a Spark checkpoint, partition by partition: for jobs that run so often
    that the plan sent with each task counts."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch_dir(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """A one-row result computed once and held as a local row."""
    rows = df.limit(2).toArrow()
    if rows.num_rows != 1:
        raise ValueError(f"expected one row, got {rows.num_rows}")
    return df.sparkSession.createDataFrame(rows, df.schema)
