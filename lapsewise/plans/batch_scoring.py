"""Batch scoring: score everyone, stamp, list the top K, write, summarise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.config import DEFAULTS, KEY, SCORE, Settings
from lapsewise.functions.scoring import add_predictions, risk_score, stamp
from lapsewise.operators.topk import run_summary, top_k
from lapsewise.sources.writers import write_csv, write_parquet


def rule_scorer(df: DataFrame) -> DataFrame:
    """Score by the fixed risk formula; needs no trained model."""
    return add_predictions(df, risk_score())


def score_customers(
    customers: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    out_dir: str,
    model_stage: str = "production",
    model_version: str | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Write ``scored`` (Parquet) and ``top_k`` (CSV) under ``out_dir``; returns the summary row.

    The scored table is written first and then read back, so ranking and summary
    do not score again and read two columns only.
    """
    spark = customers.sparkSession
    write_parquet(stamp(scorer(customers), model_stage, model_version), f"{out_dir}/scored")
    scored = spark.read.parquet(f"{out_dir}/scored")
    write_csv(top_k(scored, SCORE, KEY, pct=settings.top_k_percent), f"{out_dir}/top_k")
    summary = run_summary(scored, SCORE, settings.top_k_percent, settings.high_risk_threshold)
    return summary.withColumn("model_stage", F.lit(model_stage))
