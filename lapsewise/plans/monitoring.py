"""Monitoring: drift of data, predictions and performance, alerts, retraining decision."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from lapsewise.config import DEFAULTS, KEY, LABEL, SCORE, Settings
from lapsewise.operators.alerts import (
    DEFAULT_LEVELS,
    Levels,
    alerts,
    approval,
    monitoring_report,
    retrain_decision,
)
from lapsewise.operators.drift import column_drift, data_drift, performance_drift, prediction_drift
from lapsewise.sources.scratch import settled, stored


@dataclass(frozen=True)
class Monitoring:
    columns: DataFrame
    data: DataFrame
    prediction: DataFrame
    performance: DataFrame | None
    alerts: DataFrame
    decision: DataFrame

    def report(self) -> DataFrame:
        return monitoring_report(self.data, self.prediction, self.performance, self.alerts, self.columns)


def monitor(
    ref: DataFrame,
    cur: DataFrame,
    columns: list[str] | None = None,
    p: str = SCORE,
    y: str = LABEL,
    key: str = KEY,
    default_reference: float | None = None,
    levels: Levels = DEFAULT_LEVELS,
    settings: Settings = DEFAULTS,
) -> Monitoring:
    """Compare two scored tables. Each summary is one row and is computed once;
    performance is skipped where labels or scores are missing."""
    per_column = stored(column_drift(ref, cur, columns, settings.column_drift_threshold), "column_drift")
    data = settled(data_drift(per_column, settings.drift_share_threshold))
    prediction = settled(prediction_drift(ref, cur, p, settings.prediction_drift_threshold, default_reference))
    labelled = all(c in df.columns for df in (ref, cur) for c in (y, p))
    performance = (
        settled(performance_drift(ref, cur, y, p, key, settings.performance_drop_threshold)) if labelled else None
    )
    rows = alerts(data, prediction, performance, levels)
    decision = approval(
        retrain_decision(data, performance, rows, settings.drift_share_threshold, settings.performance_drop_threshold),
        auto=settings.auto_retrain,
    )
    return Monitoring(per_column, data, prediction, performance, rows, decision)
