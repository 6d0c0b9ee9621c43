"""Training: split, baseline, search, tuned model, summary; and retraining on a decision."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from lapsewise.config import DEFAULTS, Settings
from lapsewise.operators.quality import TRAINING_RULES, class_balance, missing_share, validate
from lapsewise.operators.split import stratified_split
from lapsewise.operators.search import best_trial, trials_table
from lapsewise.operators.train import (
    SEARCH_SPACE,
    boosted_trees,
    evaluate_splits,
    feature_importance,
    fit,
    optimize,
    training_summary,
)
from lapsewise.plans.monitoring import Monitoring
from lapsewise.sources.scratch import stored


@dataclass(frozen=True)
class Trained:
    model: PipelineModel
    params: dict
    metrics: DataFrame
    importance: DataFrame
    summary: DataFrame
    trials: DataFrame


def check_training_data(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Schema, class balance and missing shares; raises on the first that fails."""
    rows = validate(df, TRAINING_RULES, strict=True)
    balance = class_balance(rows, minimum=settings.min_minority_share).first()
    if not balance["passed"]:
        raise ValueError(
            f"minority class share {balance['minority_share']} is below {settings.min_minority_share}"
        )
    gaps = missing_share(rows, settings.max_missing_share).where("not passed").collect()
    if gaps:
        raise ValueError(f"too many missing values in {sorted(r['column'] for r in gaps)}")
    return rows


def train_churn_model(
    df: DataFrame,
    n_trials: int = 50,
    baseline_params: dict | None = None,
    space: dict | None = None,
    parallelism: int = 1,
    settings: Settings = DEFAULTS,
) -> Trained:
    """Validated rows in, tuned model and its metrics out."""
    spark = df.sparkSession
    rows = check_training_data(df, settings)
    split = stored(
        stratified_split(rows, test=settings.test_size, val=settings.val_size, seed=settings.seed), "split"
    )
    baseline = fit(split, boosted_trees(baseline_params, settings.seed))
    trials = optimize(split, n_trials, space or SEARCH_SPACE, settings.seed, parallelism=parallelism)
    best = best_trial(trials).params
    model = fit(split, boosted_trees(best, settings.seed))
    before, after = (stored(evaluate_splits(m, split), "metrics") for m in (baseline, model))
    importance = feature_importance(model, spark)
    return Trained(model, best, after, importance, training_summary(before, after, importance), trials_table(spark, trials))


def retrain_if_needed(result: Monitoring, train: Callable[[], Trained]) -> Trained | None:
    """Train only on an approved recommendation."""
    return train() if result.decision.first()["approved"] else None
