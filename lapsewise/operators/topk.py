"""Top-K customers and summaries of a scored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.config import DEFAULTS, KEY, SCORE
from lapsewise.operators.ordered import positions, score_bin


def check_k(k: int | None, pct: float | None) -> None:
    if k is not None and k < 1:
        raise ValueError("k must be at least 1")
    if pct is not None and not 0 <= pct <= 1:
        raise ValueError("pct must lie in [0, 1]")


def resolve_k(n: Column, k: int | None = None, pct: float | None = None) -> Column:
    """``k`` held within [1, n], else the share ``pct`` of ``n`` rounded down, at least 1."""
    check_k(k, pct)
    if k is not None:
        return F.greatest(F.lit(1), F.least(F.lit(k), n)).cast("long")
    share = DEFAULTS.top_k_percent if pct is None else pct
    return F.greatest(F.lit(1), F.floor(n.cast("double") * F.lit(float(share)))).cast("long")


def scored_rows(df: DataFrame, score: str, digits: int | None = None) -> tuple[DataFrame, Column]:
    """Rows that have a score, and the score to order by."""
    value = F.col(score).cast("double")
    value = value if digits is None else F.round(value, digits)
    return df.where(value.isNotNull() & ~F.isnan(value)), value


def cut_bin(df: DataFrame, value: Column, k: int | None, pct: float | None) -> DataFrame:
    """One row: ``(bin, k, n)``, the bin of the k-th score from the top. One pass that
    counts scores by bin; tables of counts are added up as they are."""
    bins = df.groupBy(score_bin(value).alias("bin")).agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = bins.select("bin", F.sum("n").over(above).alias("up_to"), F.sum("n").over(every).alias("n"))
    want = resolve_k(F.col("n"), k, pct)
    return run.agg(F.max(F.when(F.col("up_to") >= want, F.col("bin"))).alias("bin"), F.max(want).alias("k"), F.max("n").alias("n"))


def top_k(
    df: DataFrame,
    score: str = SCORE,
    key: str = KEY,
    k: int | None = None,
    pct: float | None = None,
    digits: int | None = None,
    rank: str = "risk_rank",
) -> DataFrame:
    """The K highest scores with their rank 1..k, ties by key ascending; missing scores are left out.

    A count by bins of the score finds the bin of the K-th; rows below it never reach the
    ranking shuffle, and no task or driver holds K rows.
    """
    check_k(k, pct)
    rows, value = scored_rows(df, score, digits)
    cut = cut_bin(rows, value, k, pct).first()
    above = rows.where(score_bin(value) >= F.lit(cut["bin"]))
    return positions(above, score, key, out=rank, digits=digits).where(F.col(rank) <= F.lit(cut["k"]))


def score_summary(df: DataFrame, p: str = SCORE, level: str = "risk_level") -> DataFrame:
    """One row: rows, rows and share per risk level, mean probability."""
    counts = {name: F.count_if(F.col(level) == name) for name in ("high", "medium", "low")}
    rows = F.nullif(F.count("*"), F.lit(0))
    return df.agg(
        F.count("*").alias("total_customers"),
        *[n.alias(f"{name}_risk") for name, n in counts.items()],
        *[(n / rows).alias(f"{name}_share") for name, n in counts.items()],
        F.avg(p).alias("mean_probability"),
    )


def run_summary(
    df: DataFrame, p: str = SCORE, pct: float | None = None, threshold: float = DEFAULTS.high_risk_threshold
) -> DataFrame:
    """One row: rows with a score, size of the top-K list and its real share of them, mean
    probability, high-risk count. A list of no rows has size and share 0."""
    df, _ = scored_rows(df, p)
    n = F.count("*")
    k = F.least(resolve_k(n, None, pct), n)
    return df.agg(
        n.alias("total_scored"),
        k.alias("top_k"),
        F.coalesce(k / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("top_share"),
        F.avg(p).alias("mean_probability"),
        F.count_if(F.col(p) >= threshold).alias("high_risk_count"),
    )
