"""Evaluation of scores against 0/1 labels, overall or per segment.

Scores collapse to one row per distinct value with its counts; every curve
metric is a sum over that list. A tie cut by the K-th position is settled on the
tied rows alone, by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.config import DEFAULTS, KEY, LABEL, SCORE
from lapsewise.operators.lookup import held_if_small
from lapsewise.operators.ordered import positions, running, value_blocks
from lapsewise.operators.topk import resolve_k
from lapsewise.sources.scratch import stored


def safe_ratio(num: Column, den: Column, on_zero: str = "zero") -> Column:
    empty = F.lit(0.0) if on_zero == "zero" else F.lit(float("nan"))
    return F.when(den != 0, num.cast("double") / den).otherwise(empty)


def harmonic(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(F.lit(0.0))


def score_curve(
    df: DataFrame,
    y: str = LABEL,
    p: str = SCORE,
    by: Sequence[str] = (),
    threshold: float = DEFAULTS.prediction_threshold,
    digits: int | None = None,
) -> DataFrame:
    """One row per distinct score, from the top, with running and total counts.

    ``n`` rows, ``pos`` labels of 1; ``hit``/``hit_pos`` the same at or above the threshold.
    The counts by score are written once, so that the rows are read in one pass.
    """
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    for c in by:
        rows = rows.where(F.col(c).isNotNull())
    value = F.col(p).cast("double")
    rows = rows.withColumn("_s", value if digits is None else F.round(value, digits))
    label, over = F.col(y).cast("long"), (F.col(p) >= threshold).cast("long")
    points = rows.groupBy(*by, "_s").agg(
        F.count("*").alias("n"),
        F.sum(label).alias("pos"),
        F.sum(over).alias("hit"),
        F.sum(over * label).alias("hit_pos"),
    )
    points, blocks = value_blocks(stored(points, "points"), ["_s"])
    points = points.select(*by, "_s", "n", "pos", "hit", "hit_pos", blocks["_s"].alias("_b"))
    return running(points, by, "_s", ["n", "pos"], descending=True, block="_b")


def _curve_sums(curve: DataFrame, by: Sequence[str], k: int | None = None, pct: float | None = None) -> DataFrame:
    """All sums over the curve, one row per group."""
    n, pos = F.col("n"), F.col("pos")
    neg = n - pos
    cum_n, cum_pos = F.col("cum_n"), F.col("cum_pos")
    all_pos, all_neg = F.col("total_pos"), F.col("total_n") - F.col("total_pos")
    # A positive beats the negatives scored lower and half of those tied with it.
    beaten = (all_neg - (cum_n - cum_pos)) + neg / 2
    step = F.when(all_pos > 0, pos / all_pos)
    precision = cum_pos / cum_n
    # Before the first point the curve stands at recall 0, precision 1.
    previous = F.when(cum_n > n, (cum_pos - pos) / F.when(cum_n > n, cum_n - n)).otherwise(F.lit(1.0))
    want = resolve_k(F.col("total_n"), k, pct)
    at_cut = (cum_n >= want) & (cum_n - n < want)
    return curve.groupBy(*by).agg(
        F.max("total_n").alias("n_samples"),
        F.max("total_pos").alias("n_positives"),
        F.sum("hit").alias("_hit"),
        F.sum("hit_pos").alias("true_positives"),
        F.sum(pos * beaten).alias("_wins"),
        F.sum(step * (precision + previous) / 2).alias("pr_auc"),
        F.sum(step * precision).alias("average_precision"),
        F.max(want).alias("k"),
        F.max(F.when(at_cut, F.col("_s"))).alias("_cut"),
        F.max(F.when(at_cut, want - (cum_n - n))).alias("_need"),
        F.max(F.when(at_cut, n)).alias("_tied"),
        F.max(F.when(at_cut, cum_pos - pos)).alias("_pos_above"),
        F.max(F.when(at_cut, pos)).alias("_pos_tied"),
    )


def _roc(n: Column, pos: Column, wins: Column) -> Column:
    """0.0 when only one class occurs."""
    pairs = pos.cast("double") * (n - pos)
    return F.when(pairs > 0, wins / pairs).otherwise(F.lit(0.0))


def _with_tp(
    sums: DataFrame, df: DataFrame, y: str, p: str, key: str, by: Sequence[str], digits: int | None
) -> DataFrame:
    """Add ``tp_at_k``: positives above the cut score plus those among the first tied keys.

    The sums are one row per group. Up to a checked number of groups they are
    computed once and held; most often no cut falls inside a tie, and then that is
    all. Only ties a cut really splits are looked at row by row.
    """
    cut_inside = F.col("_need") < F.col("_tied")
    small = held_if_small(sums)
    sums = sums if small is None else small
    if small is not None and not small.where(cut_inside).take(1):
        return small.withColumn("tp_at_k", F.col("_pos_above") + F.col("_pos_tied"))
    split = sums.where(cut_inside).select(*by, F.col("_cut").alias("_s"), "_need")
    value = F.col(p) if digits is None else F.round(F.col(p), digits)
    rows = df.where(F.col(y).isNotNull()).withColumn("_s", value.cast("double")).select(*by, "_s", key, y)
    tied = rows.join(split if small is None else F.broadcast(split), [*by, "_s"])
    first = positions(tied, "_s", key, by, out="_at", digits=digits)
    taken = first.where(F.col("_at") <= F.col("_need")).groupBy(*by, "_s").agg(
        F.sum(F.col(y).cast("long")).alias("_pos_taken")
    )
    out = sums.withColumn("_s", F.col("_cut")).join(taken, [*by, "_s"], "left")
    inside = F.when(cut_inside, F.coalesce("_pos_taken", F.lit(0))).otherwise(F.col("_pos_tied"))
    return out.withColumn("tp_at_k", F.col("_pos_above") + inside)


def _at_k(on_zero: str = "zero") -> dict[str, Column]:
    tp, k = F.col("tp_at_k"), F.col("k")
    precision = safe_ratio(tp, k)
    recall = safe_ratio(tp, F.col("n_positives"))
    base = safe_ratio(F.col("n_positives"), F.col("n_samples"))
    return {
        "precision_at_k": precision,
        "recall_at_k": recall,
        "lift_at_k": safe_ratio(precision, base, on_zero),
        "f1_at_k": harmonic(precision, recall),
        "tp_at_k": tp,
        "fp_at_k": k - tp,
        "k": k,
        "k_percent": k / F.col("n_samples"),
    }


def topk_metrics(
    df: DataFrame,
    y: str = LABEL,
    p: str = SCORE,
    key: str = KEY,
    by: Sequence[str] = (),
    k: int | None = None,
    pct: float | None = None,
    on_zero: str = "zero",
    digits: int | None = None,
) -> DataFrame:
    """Precision, recall, lift and F1 of the K best-scored rows of each group.

    ``on_zero="nan"`` makes the lift NaN instead of 0 when a group has no positives.
    """
    sums = _curve_sums(score_curve(df, y, p, by, digits=digits), by, k, pct)
    full = _with_tp(sums, df, y, p, key, by, digits)
    return full.select(*by, *[c.alias(name) for name, c in _at_k(on_zero).items()])


def confusion(
    df: DataFrame, y: str = LABEL, p: str = SCORE, threshold: float = DEFAULTS.prediction_threshold, by: Sequence[str] = ()
) -> DataFrame:
    """Four counts and precision, recall, F1 at a threshold (0 on a zero denominator)."""
    hit, pos = F.col(p) >= threshold, F.col(y) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(~hit & ~pos).alias("true_negatives"),
        F.count_if(hit & ~pos).alias("false_positives"),
        F.count_if(~hit & pos).alias("false_negatives"),
        F.count_if(hit & pos).alias("true_positives"),
    )
    tp = F.col("true_positives")
    precision = safe_ratio(tp, tp + F.col("false_positives"))
    recall = safe_ratio(tp, tp + F.col("false_negatives"))
    return counts.withColumns({"precision": precision, "recall": recall, "f1": harmonic(precision, recall)})


def curve_metrics(
    df: DataFrame, y: str = LABEL, p: str = SCORE, by: Sequence[str] = (), digits: int | None = None
) -> DataFrame:
    """``roc_auc``, ``pr_auc`` (trapezoid) and ``average_precision`` (steps) per group.

    Without positives the two precision-recall areas are null and ROC-AUC is 0.
    """
    sums = _curve_sums(score_curve(df, y, p, by, digits=digits), by)
    return sums.select(
        *by,
        _roc(F.col("n_samples"), F.col("n_positives"), F.col("_wins")).alias("roc_auc"),
        "pr_auc",
        "average_precision",
    )


def roc_auc(df, y=LABEL, p=SCORE, by=(), digits=None) -> DataFrame:
    return curve_metrics(df, y, p, by, digits).select(*by, "roc_auc")


def pr_auc(df, y=LABEL, p=SCORE, by=(), digits=None) -> DataFrame:
    return curve_metrics(df, y, p, by, digits).select(*by, "pr_auc")


def average_precision(df, y=LABEL, p=SCORE, by=(), digits=None) -> DataFrame:
    return curve_metrics(df, y, p, by, digits).select(*by, "average_precision")


def all_metrics(
    df: DataFrame,
    y: str = LABEL,
    p: str = SCORE,
    key: str = KEY,
    by: Sequence[str] = (),
    threshold: float = DEFAULTS.prediction_threshold,
    k: int | None = None,
    pct: float | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Every metric of each group in one row; top-K columns carry the prefix ``top_``."""
    sums = _curve_sums(score_curve(df, y, p, by, threshold, digits), by, k, pct)
    full = _with_tp(sums, df, y, p, key, by, digits)
    n, n_pos, tp, hit = (F.col(c) for c in ("n_samples", "n_positives", "true_positives", "_hit"))
    precision, recall = safe_ratio(tp, hit), safe_ratio(tp, n_pos)
    return full.select(
        *by,
        precision.alias("precision"),
        recall.alias("recall"),
        harmonic(precision, recall).alias("f1"),
        "pr_auc",
        "average_precision",
        _roc(n, n_pos, F.col("_wins")).alias("roc_auc"),
        (n - n_pos - (hit - tp)).alias("true_negatives"),
        (hit - tp).alias("false_positives"),
        (n_pos - tp).alias("false_negatives"),
        "true_positives",
        F.lit(threshold).alias("threshold"),
        "n_samples",
        "n_positives",
        (n_pos / n).alias("churn_rate"),
        *[c.alias(f"top_{name}") for name, c in _at_k().items()],
    )


def metrics_by_segment(
    df: DataFrame, segment: str, y: str = LABEL, p: str = SCORE, key: str = KEY, pct: float | None = None
) -> DataFrame:
    """Per non-null segment: size, churn rate, PR-AUC and top-K metrics, K from the segment's size."""
    m = all_metrics(df, y, p, key, by=[segment], pct=pct)
    return m.select(
        F.col(segment).alias("segment"),
        "n_samples",
        "churn_rate",
        "pr_auc",
        F.col("top_precision_at_k").alias("precision_at_k"),
        F.col("top_recall_at_k").alias("recall_at_k"),
        F.col("top_lift_at_k").alias("lift_at_k"),
    )


def joint_objective(metrics: DataFrame, w_pr: float = 0.5, w_recall: float = 0.5) -> DataFrame:
    """Add ``objective``: weighted PR-AUC plus weighted recall at K."""
    return metrics.withColumn("objective", w_pr * F.col("pr_auc") + w_recall * F.col("top_recall_at_k"))


def model_comparison(
    scores: DataFrame, model: str = "model", y: str = "y", p: str = "score", key: str = KEY, pct: float = 0.1
) -> DataFrame:
    """Metrics of several models from scores in long form, best PR-AUC first."""
    m = all_metrics(scores, y, p, key, by=[model], pct=pct)
    return m.select(
        model,
        "pr_auc",
        "average_precision",
        "roc_auc",
        F.col("top_precision_at_k").alias("precision_at_k"),
        F.col("top_recall_at_k").alias("recall_at_k"),
        F.col("top_lift_at_k").alias("lift_at_k"),
        F.col("top_k").alias("k"),
        "n_samples",
        "n_positives",
    ).orderBy(F.col("pr_auc").desc(), model)
