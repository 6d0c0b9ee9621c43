"""Derived customer features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.config import LABEL
from lapsewise.operators.lookup import attach


def ratio(num: Column, den: Column, otherwise: Column | None = None) -> Column:
    """``num / den`` where the denominator is positive, else ``otherwise``."""
    guarded = F.when(den > 0, num / den)
    return guarded if otherwise is None else guarded.otherwise(otherwise)


def flag(condition: Column) -> Column:
    """0/1 integer; a null condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def banded(value: Column, edges: list[tuple[float, str]], low: float, right_closed: bool) -> Column:
    """Label of the band a value falls in; outside every band it is null."""
    above = value > low if right_closed else value >= low
    chain = F.when(~above, F.lit(None).cast("string"))
    for edge, label in edges:
        chain = chain.when(value <= edge if right_closed else value < edge, F.lit(label))
    return chain


# Band edges and labels.
AGE_GROUPS = [(35, "young"), (55, "middle"), (100, "senior")]
AGE_DECADES = [
    (30, "<30"),
    (40, "30-40"),
    (50, "40-50"),
    (60, "50-60"),
    (70, "60-70"),
    (80, "70-80"),
    (100, "80+"),
]
CREDIT_BANDS = [
    (580, "Poor"),
    (670, "Fair"),
    (740, "Good"),
    (800, "VeryGood"),
    (1000, "Excellent"),
]
HIGH_VALUE = 100_000


def add_features(df: DataFrame) -> DataFrame:
    """The five features the production model is trained on."""
    balance, salary = F.col("Balance"), F.col("EstimatedSalary")
    return df.withColumns(
        {
            "balance_per_product": ratio(balance, F.col("NumOfProducts"), F.lit(0.0)),
            "tenure_age_ratio": ratio(F.col("Tenure"), F.col("Age"), F.lit(0.0)),
            "is_zero_balance": flag(balance == 0),
            "high_value_customer": flag((balance > HIGH_VALUE) & (salary > HIGH_VALUE)),
            "age_group": banded(F.col("Age"), AGE_GROUPS, 0, right_closed=True),
        }
    )


def add_exploration_features(df: DataFrame) -> DataFrame:
    """The wider set used in exploratory analysis (booleans stay booleans)."""
    balance, salary = F.col("Balance"), F.col("EstimatedSalary")
    products = F.col("NumOfProducts")
    return df.withColumns(
        {
            "AgeGroup": banded(F.col("Age"), AGE_DECADES, 0, right_closed=False),
            "HighValueCustomer": (balance > HIGH_VALUE) & (salary > HIGH_VALUE),
            "BalancePerProduct": ratio(balance, products, F.lit(0.0)),
            "BalanceToSalaryRatio": ratio(balance, salary),
            "IsSingleProduct": products == 1,
            "IsMultiProduct": products >= 2,
            "InactiveLongTenure": (F.col("IsActiveMember") == 0) & (F.col("Tenure") >= 5),
            "CreditScoreBand": banded(F.col("CreditScore"), CREDIT_BANDS, 0, right_closed=True),
            "ZeroBalance": balance == 0,
            "SeniorSingleProduct": (F.col("Age") >= 60) & (products == 1),
        }
    )


def target_rates(train: DataFrame, column: str, label: str = LABEL) -> DataFrame:
    """One row per category: its mean label."""
    return train.groupBy(column).agg(F.avg(label).alias("rate"))


def target_encode(
    train: DataFrame, apply_to: DataFrame, column: str, label: str = LABEL, out: str | None = None
) -> DataFrame:
    """Add a category's mean label, fitted on ``train`` only.

    An aggregate joined back, not a window over the category: a window would
    put every row of a category into one task.
    """
    rates = target_rates(train, column, label).withColumnRenamed("rate", out or f"{column}_rate")
    return attach(apply_to, rates, column, "left")
