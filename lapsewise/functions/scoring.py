"""Scores and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.config import DEFAULTS, SCORE, Settings

# Weights of the rule-of-thumb risk score.
RISK_WEIGHTS = {
    "Age": 0.03,
    "Balance": 0.000002,
    "IsActiveMember": -1.2,
    "IsSingleProduct": 0.2,
}


def clip(column: Column, low, high) -> Column:
    """Bounded value; null and NaN give null, never a bound."""
    known = column.isNotNull() & ~F.isnan(column.cast("double"))
    return F.when(known, F.greatest(F.lit(low), F.least(F.lit(high), column)))


def risk_logit() -> Column:
    w = {name: f"{value!r}D" for name, value in RISK_WEIGHTS.items()}
    return F.expr(
        f"{w['Age']} * Age + {w['Balance']} * Balance + {w['IsActiveMember']} * IsActiveMember"
        f" + {w['IsSingleProduct']} * CAST(NumOfProducts = 1 AS INT)"
    )


def risk_score(digits: int = 6) -> Column:
    """Logistic risk score; rounding keeps it equal across engines."""
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-risk_logit())), digits)


def risk_level(p: Column | str = SCORE, settings: Settings = DEFAULTS) -> Column:
    c = F.col(p) if isinstance(p, str) else p
    return (
        F.when(c.isNull() | F.isnan(c.cast("double")), F.lit(None).cast("string"))
        .when(c >= settings.high_risk_threshold, "high")
        .when(c >= settings.medium_risk_threshold, "medium")
        .otherwise("low")
    )


def add_predictions(df: DataFrame, p: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Probability clipped to [0, 1], the 0/1 prediction and the risk level."""
    df = df.withColumn(SCORE, clip(p, 0.0, 1.0))
    return df.withColumns(
        {
            "prediction": (F.col(SCORE) >= settings.prediction_threshold).cast("int"),
            "risk_level": risk_level(SCORE, settings),
        }
    )


def stamp(df: DataFrame, model_stage: str, model_version: str | None = None, at: Column | None = None) -> DataFrame:
    """Mark scored rows with the time, stage and version of the scoring run."""
    return df.withColumns(
        {
            "scored_at": F.current_timestamp() if at is None else at,
            "model_stage": F.lit(model_stage),
            "model_version": F.lit(model_version).cast("string"),
        }
    )
