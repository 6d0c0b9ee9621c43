"""Fitted pipelines kept under a shared folder, and scoring with them.

    base/models/<version>/     a saved pipeline
    base/stages/               which version a stage points to, appended

A stage points to the version that was promoted last. A version is never written again.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.config import DEFAULTS, Settings
from lapsewise.functions.scoring import stamp
from lapsewise.operators.topk import run_summary
from lapsewise.operators.train import predict
from lapsewise.sources.readers import load, table_exists
from lapsewise.sources.scratch import stored
from lapsewise.sources.writers import write_table

STAGES = "stage string, version string, number long"


def save_model(model: PipelineModel, base: str) -> str:
    """Save a fitted pipeline as a new version and return its name."""
    version = uuid.uuid4().hex
    model.write().save(f"{base}/models/{version}")
    return version


def _pointers(spark: SparkSession, base: str) -> DataFrame | None:
    try:
        return spark.read.schema(STAGES).parquet(f"{base}/stages")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def promote(spark: SparkSession, base: str, version: str, stage: str = "production") -> None:
    """Point a stage to a saved version; the pointer is one row that appears at once."""
    PipelineModel.load(f"{base}/models/{version}")  # a version that is not whole cannot be promoted
    before = _pointers(spark, base)
    last = None if before is None else before.agg(F.max("number")).first()[0]
    row = [(stage, version, 0 if last is None else last + 1)]
    spark.createDataFrame(row, STAGES).coalesce(1).write.mode("append").parquet(f"{base}/stages")


def staged_version(spark: SparkSession, base: str, stage: str = "production") -> str:
    pointers = _pointers(spark, base)
    found = None if pointers is None else pointers.where(F.col("stage") == stage).agg(F.max_by("version", "number")).first()[0]
    if found is None:
        raise ValueError(f"no model is in stage {stage!r}")
    return found


def load_model(base: str, version: str) -> PipelineModel:
    return PipelineModel.load(f"{base}/models/{version}")


def score_to_table(
    spark: SparkSession,
    source: str,
    base: str,
    table: str,
    if_exists: str = "replace",
    stage: str = "production",
    kind: str | None = None,
    params: Mapping | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Score a source with the model of a stage into a catalog table (``replace``,
    ``append`` or ``fail``); returns the summary row of this run.

    The scores are written once to the scratch folder and copied from there, so a table is
    only touched once all rows are scored. An empty source is an error.
    """
    if if_exists == "fail" and table_exists(spark, table):
        raise ValueError(f"there is a table {table}")
    version = staged_version(spark, base, stage)
    customers = load(spark, source, kind, params=params)
    if customers.isEmpty():
        raise ValueError("there are no customers to score")
    scored = stored(stamp(predict(load_model(base, version), customers, settings=settings), stage, version), "scored")
    write_table(scored, table, if_exists)
    return run_summary(scored, pct=settings.top_k_percent, threshold=settings.high_risk_threshold).withColumns(
        {"model_stage": F.lit(stage), "model_version": F.lit(version)}
    )
