"""Alert rows from drift results, and the retraining decision."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.config import DEFAULTS


@dataclass(frozen=True)
class Levels:
    """Warning and critical levels per alert type."""

    drift_share: tuple[float, float] = (0.5, 0.7)
    mean_shift: tuple[float, float] = (0.10, 0.15)
    pr_auc_drop: tuple[float, float] = (0.05, 0.10)


DEFAULT_LEVELS = Levels()


def severity(value: Column, levels: tuple[float, float]) -> Column:
    warning, critical = levels
    return F.when(value >= critical, "critical").when(value >= warning, "warning").otherwise("info")


def _alert(
    df: DataFrame, when: str, kind: str, order: int, value: Column, levels, text: str, fmt: str, scale: int = 1, by: Sequence[str] = ()
) -> DataFrame:
    details = F.to_json(F.struct(*df.columns))
    return df.where(F.col(when)).select(
        *by,
        F.lit(order).alias("position"),
        F.lit(kind).alias("alert_type"),
        severity(value, levels).alias("severity"),
        F.format_string(text, F.format_string(fmt, value * scale)).alias("message"),
        details.alias("details"),
    )


# The texts of alerts, reasons and report rows below.


def data_drift_alert(data: DataFrame, levels: Levels = DEFAULT_LEVELS, by: Sequence[str] = ()) -> DataFrame:
    share = F.col("drift_share").cast("double")
    return _alert(
        data, "drift_detected", "data_drift", 1, share, levels.drift_share,
        "Data drift detected: %s of features drifted", "%.1f%%", 100, by,
    )


def prediction_drift_alert(prediction: DataFrame, levels: Levels = DEFAULT_LEVELS, by: Sequence[str] = ()) -> DataFrame:
    shift = F.abs(F.col("mean_shift").cast("double"))
    return _alert(
        prediction, "prediction_drift_detected", "prediction_drift", 2, shift, levels.mean_shift,
        "Prediction mean shift detected: %s", "%.3f", by=by,
    )


def performance_alert(performance: DataFrame, levels: Levels = DEFAULT_LEVELS, by: Sequence[str] = ()) -> DataFrame:
    drop = F.col("pr_auc_drop").cast("double")
    return _alert(
        performance, "performance_degraded", "performance_degradation", 3, drop, levels.pr_auc_drop,
        "Model PR_AUC dropped by %s", "%.3f", by=by,
    )


def alerts(
    data: DataFrame | None = None,
    prediction: DataFrame | None = None,
    performance: DataFrame | None = None,
    levels: Levels = DEFAULT_LEVELS,
    by: Sequence[str] = (),
) -> DataFrame:
    """All alerts, in the order data, prediction, performance. Inputs are one-row results,
    or one row for each group of ``by``."""
    parts = [
        make(df, levels, by)
        for make, df in (
            (data_drift_alert, data),
            (prediction_drift_alert, prediction),
            (performance_alert, performance),
        )
        if df is not None
    ]
    if not parts:
        raise ValueError("give at least one result to grade")
    return reduce(DataFrame.unionByName, parts)


def critical(alert_rows: DataFrame) -> DataFrame:
    """The alerts that are delivered."""
    return alert_rows.where(F.col("severity") == "critical")


def retrain_decision(
    data: DataFrame,
    performance: DataFrame | None,
    alert_rows: DataFrame,
    drift_threshold: float = DEFAULTS.drift_share_threshold,
    drop_threshold: float = DEFAULTS.performance_drop_threshold,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row (or one for each group of ``by``): whether to retrain, the reasons and the
    numbers behind them."""
    if by:
        counts = critical(alert_rows).groupBy(*by).agg(F.count("*").alias("critical_alerts"))
        row = data.select(*by, "drift_detected", "drift_share").join(counts, list(by), "left").fillna(0, ["critical_alerts"])
    else:
        n_critical = critical(alert_rows).agg(F.count("*").alias("n")).scalar()
        row = data.select("drift_detected", "drift_share").withColumn("critical_alerts", n_critical)
    if performance is not None and by:
        measured = performance.select(*by, F.col("performance_degraded").alias("degraded"), F.col("pr_auc_drop").alias("drop"))
        row = row.join(measured, list(by), "left")
    elif performance is None:
        row = row.withColumns({"degraded": F.lit(False), "drop": F.lit(0.0)})
    else:
        row = row.withColumns(
            {
                "degraded": performance.select("performance_degraded").scalar(),
                "drop": performance.select("pr_auc_drop").scalar(),
            }
        )
    drifted = F.col("drift_detected") & (F.col("drift_share") >= drift_threshold)
    dropped = F.col("degraded") & (F.col("drop") >= drop_threshold)
    alerted = F.col("critical_alerts") > 0
    reasons = F.array_compact(
        F.array(
            F.when(
                drifted,
                F.format_string("Significant data drift detected: %.1f%% of features", F.col("drift_share") * 100),
            ),
            F.when(dropped, F.format_string("Performance degradation: PR-AUC dropped by %.3f", F.col("drop"))),
            F.when(alerted, F.format_string("%d critical alerts triggered", F.col("critical_alerts"))),
        )
    )
    return row.select(
        *by,
        F.coalesce(drifted | dropped | alerted, F.lit(False)).alias("should_retrain"),
        reasons.alias("reasons"),
        "drift_share",
        F.coalesce("drop", F.lit(0.0)).alias("performance_drop"),
        "critical_alerts",
    )


def approval(decision: DataFrame, require_approval: bool = True, auto: bool = DEFAULTS.auto_retrain) -> DataFrame:
    """Add ``approved``: always when no approval is asked for, never without a
    recommendation, else as configured."""
    gate = F.when(F.lit(not require_approval), True).when(~F.col("should_retrain"), False).otherwise(F.lit(auto))
    return decision.withColumn("approved", gate)


def _report_rows(df: DataFrame, section: str, items: dict[str, Column]) -> DataFrame:
    """``(section, item, value)`` rows of text from a one-row frame."""
    cells = [
        F.struct(F.lit(section).alias("section"), F.lit(n).alias("item"), c.cast("string").alias("value"))
        for n, c in items.items()
    ]
    return df.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def retraining_report(decision: DataFrame, test_metrics: DataFrame | None = None) -> DataFrame:
    """Report rows ``(section, item, value)`` of a retraining run: the decision with its
    approval, its reasons and numbers, and the new model's test metrics or why there are none."""
    def four(c: str) -> Column:
        return F.format_string("%.4f", F.col(c))

    out = _report_rows(
        decision,
        "decision",
        {
            "recommendation": F.when(F.col("should_retrain"), "RETRAIN").otherwise("NO RETRAIN"),
            "approval": F.when(F.col("approved"), "APPROVED").otherwise("PENDING OR DENIED"),
        },
    )
    none = F.array(F.lit("All metrics within acceptable ranges"))
    reasons = decision.select(F.posexplode(F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(none)).alias("i", "value"))
    out = out.unionByName(
        reasons.select(F.lit("reasons").alias("section"), (F.col("i") + 1).cast("string").alias("item"), "value")
    )
    out = out.unionByName(
        _report_rows(
            decision,
            "metrics",
            {
                "drift_share": F.format_string("%.1f%%", F.col("drift_share") * 100),
                "pr_auc_drop": four("performance_drop"),
                "critical_alerts": F.col("critical_alerts"),
            },
        )
    )
    if test_metrics is None:
        status = F.when(F.col("should_retrain"), "Awaiting Approval").otherwise("Skipped")
        return out.unionByName(_report_rows(decision, "results", {"status": status}))
    results = {"status": F.lit("COMPLETED"), "pr_auc": four("pr_auc")}
    results |= {n: four(f"top_{n}") for n in ("precision_at_k", "recall_at_k", "lift_at_k")}
    return out.unionByName(_report_rows(test_metrics, "results", results))


def monitoring_report(
    data: DataFrame, prediction: DataFrame, performance: DataFrame | None, alert_rows: DataFrame, column_rows: DataFrame
) -> DataFrame:
    """Report rows ``(section, item, value)`` of a monitoring run."""

    def four(c: str) -> Column:
        return F.format_string("%.4f", F.col(c))

    parts = [
        _report_rows(
            data,
            "data_drift",
            {
                "drift_detected": F.col("drift_detected"),
                "drift_share": four("drift_share"),
                "n_drifted_columns": F.col("n_drifted_columns"),
            },
        ),
        column_rows.where("drifted").select(
            F.lit("drifted_features").alias("section"), F.col("column").alias("item"), four("value").alias("value")
        ),
        _report_rows(
            prediction,
            "prediction_drift",
            {"prediction_drift_detected": F.col("prediction_drift_detected"), "mean_shift": four("mean_shift")},
        ),
    ]
    if performance is not None:
        parts.append(
            _report_rows(
                performance,
                "performance_drift",
                {"performance_degraded": F.col("performance_degraded"), "pr_auc_drop": four("pr_auc_drop")},
            )
        )
    told = F.concat_ws(": ", "severity", "message").alias("value")
    parts.append(alert_rows.select(F.lit("alerts").alias("section"), F.col("alert_type").alias("item"), told))
    return reduce(DataFrame.unionByName, parts)
