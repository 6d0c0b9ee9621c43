"""Weighted logistic regression by Newton steps: one aggregate a step.

The likelihood without penalty has one optimum (unless the classes can be parted), so its
result can be held against any other engine. Only sums, as many as pairs of features, reach
the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.config import LABEL

# A step that moves no coefficient by more (of standardised features) is the last.
SMALL, STEPS = 1e-10, 50


@dataclass(frozen=True)
class Logistic:
    """Coefficients for features as they are; nulls count as 0."""

    features: tuple[str, ...]
    intercept: float
    coefficients: tuple[float, ...]
    steps: int

    def probability(self) -> Column:
        terms = [F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) * c for f, c in zip(self.features, self.coefficients)]
        return 1 / (1 + F.exp(-sum(terms, F.lit(self.intercept))))


def fit_logistic(df: DataFrame, features: Sequence[str], label: str = LABEL, weight: str | None = None) -> Logistic:
    """The coefficients of greatest likelihood. Rows without label or weight are left out; a
    constant feature gets 0. If the classes can be parted by the features there is no
    optimum, which is an error."""
    x = [F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)]
    y, w = F.col(f"`{label}`").cast("double"), F.lit(1.0) if weight is None else F.col(f"`{weight}`").cast("double")
    rows = df.select(*x, y.alias("y"), w.alias("w")).where("y is not null and w is not null")
    names = [f"x{i}" for i in range(len(features))]
    stats = rows.agg(
        F.sum("w").alias("w"), *[F.avg(c).alias(f"m{c}") for c in names], *[F.stddev_pop(c).alias(f"s{c}") for c in names],
        F.min("y").alias("least"), F.max("y").alias("most"),
    ).first()
    if stats["least"] is None or stats["least"] == stats["most"]:
        raise ValueError(f"{label!r} needs rows of both classes")
    used = [c for c in names if stats[f"s{c}"]]
    scaled = [F.lit(1.0)] + [(F.col(c) - stats[f"m{c}"]) / stats[f"s{c}"] for c in used]
    k = len(scaled)
    at = np.zeros(k)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + F.exp(-sum((c * float(b) for c, b in zip(scaled, at)), F.lit(0.0))))
        slope, bend = F.col("w") * (F.col("y") - p), F.col("w") * p * (1 - p)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        sums = rows.agg(
            *[F.sum(slope * c).alias(f"g{i}") for i, c in enumerate(scaled)],
            *[F.sum(bend * scaled[i] * scaled[j]).alias(f"h{i}_{j}") for i, j in pairs],
        ).first()
        hessian = np.zeros((k, k))
        for i, j in pairs:
            hessian[i, j] = hessian[j, i] = sums[f"h{i}_{j}"]
        move = np.linalg.lstsq(hessian, np.array([sums[f"g{i}"] for i in range(k)]), rcond=None)[0]
        at = at + move
        if np.abs(at).max() > 500 or not np.isfinite(at).all():
            break
        if np.abs(move).max() < SMALL:
            by_name = {c: b / stats[f"s{c}"] for c, b in zip(used, at[1:])}
            intercept = at[0] - sum(b * stats[f"m{c}"] for c, b in by_name.items())
            return Logistic(tuple(features), float(intercept), tuple(float(by_name.get(c, 0.0)) for c in names), step)
    raise ValueError("the likelihood has no optimum: the features part the classes")
