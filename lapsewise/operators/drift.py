"""Comparing a reference table with a current one, column by column.

Both sides are stacked and collapsed to one list of distinct values with two
counts. PSI, Kolmogorov-Smirnov and Wasserstein distances are sums over that
list; Jensen-Shannon distances are sums over category counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.config import DEFAULTS, KEY, LABEL, SCORE
from lapsewise.operators.evaluate import all_metrics
from lapsewise.operators.ordered import quantiles, running, value_points
from lapsewise.operators.profile import _text_counts, corr_matrix
from lapsewise.operators.quality import columns_of_type

# Constants of the distance definitions.
PSI_EPSILON = 1e-8
MIN_SPREAD = 0.001


def _stacked(ref: DataFrame, cur: DataFrame, columns: Sequence[str]) -> DataFrame:
    names = [F.col(f"`{c}`") for c in columns]
    return ref.select(*names, F.lit(1).alias("_ref")).unionByName(cur.select(*names, F.lit(0).alias("_ref")))


def _names(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    one = df.sparkSession.range(1)
    return one.select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))


def paired_points(ref: DataFrame, cur: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, block, value, n_ref, n_cur)`` over the distinct values of both sides."""
    both = _stacked(ref, cur, columns)
    return value_points(both, columns, {"n_ref": F.col("_ref"), "n_cur": 1 - F.col("_ref")})


def _cdf_gap() -> Column:
    """Difference of the two running shares; null when a side is empty."""
    share_ref = F.when(F.col("total_n_ref") > 0, F.col("cum_n_ref") / F.col("total_n_ref"))
    share_cur = F.when(F.col("total_n_cur") > 0, F.col("cum_n_cur") / F.col("total_n_cur"))
    return F.abs(share_ref - share_cur)


def _ks(points: DataFrame) -> DataFrame:
    run = running(points, ["column"], "value", ["n_ref", "n_cur"])
    return run.groupBy("column").agg(F.max(_cdf_gap()).alias("ks"))


def ks(ref: DataFrame, cur: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, ks)``: largest gap between the two distribution functions.

    A column that is not numeric or is missing on a side gets null.
    """
    known = [c for c in columns if c in columns_of_type(ref, "numeric") and c in columns_of_type(cur, "numeric")]
    names = _names(ref, columns)
    if not known:
        return names.withColumn("ks", F.lit(None).cast("double"))
    # One row per compared column.
    return names.join(F.broadcast(_ks(paired_points(ref, cur, known))), "column", "left")


def _slot(column: str, edges: Sequence[float]) -> Column:
    """Number of the bin a value falls in, the last one closed; null outside the edges."""
    x = f"CAST(`{column}` AS DOUBLE)"
    inner = " ".join(f"WHEN {x} < {edge!r}D THEN {i}" for i, edge in enumerate(edges[1:-1], 1))
    last = f"{len(edges) - 1}"
    case = f"CASE {inner} ELSE {last} END" if inner else last
    return F.expr(f"CASE WHEN {x} >= {edges[0]!r}D AND {x} <= {edges[-1]!r}D THEN {case} END")


def psi(ref: DataFrame, cur: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """``(column, psi)``: population stability index over quantile bins of the reference.

    Values outside the reference's range count in the totals only. The edges (at
    most ``bins + 1`` numbers per column) are found first; binning is then a narrow
    expression, and only counts per bin are shuffled.
    """
    found: dict[str, set[float]] = {c: set() for c in columns}
    for r in quantiles(ref, columns, [i / bins for i in range(bins + 1)]).collect():
        found[r["column"]].add(r["quantile"] + 0.0)
    edges = {c: sorted(e) for c, e in found.items()}
    usable = [c for c in columns if len(edges[c]) >= 2]
    names = _names(ref, columns)
    if not usable:
        return names.withColumn("psi", F.lit(0.0))
    cells = [
        F.struct(F.lit(c).alias("column"), _slot(c, edges[c]).alias("slot"), F.col(f"`{c}`").isNotNull().alias("known"))
        for c in usable
    ]
    counts = (
        _stacked(ref, cur, columns)
        .select("_ref", F.explode(F.array(*cells)).alias("cell"))
        .where("cell.known")
        .groupBy("cell.column", "cell.slot")
        .agg(F.sum("_ref").alias("e"), F.sum(1 - F.col("_ref")).alias("a"))
    )
    of_column = Window.partitionBy("column")
    totals = counts.withColumns({"e_all": F.sum("e").over(of_column), "a_all": F.sum("a").over(of_column)})
    e_share = F.col("e") / (F.col("e_all") + PSI_EPSILON)
    a_share = F.col("a") / (F.col("a_all") + PSI_EPSILON)
    term = (e_share - a_share) * F.ln((e_share + PSI_EPSILON) / (a_share + PSI_EPSILON))
    both_sides = (F.max("e_all") > 0) & (F.max("a_all") > 0)
    per_column = totals.groupBy("column").agg(
        F.when(both_sides, F.sum(F.when(F.col("slot").isNotNull(), term))).alias("psi")
    )
    # Both sides of this join have one row per compared column.
    return names.join(F.broadcast(per_column), "column", "left").select(
        "column", F.coalesce("psi", F.lit(0.0)).alias("psi")
    )


def corr_diff(ref: DataFrame, cur: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean absolute difference over all cells of the two correlation matrices."""
    if len(columns) < 2:
        return ref.sparkSession.range(1).select(F.lit(0.0).alias("corr_matrix_mean_abs_diff"))

    cells = corr_matrix(_stacked(ref, cur, columns), columns, by=["_ref"])
    known = F.coalesce(F.nanvl("correlation", F.lit(0.0)), F.lit(0.0))

    def side(flag: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("_ref") == flag, known)), F.lit(0.0))

    both = cells.groupBy("row", "column").agg(F.abs(side(1) - side(0)).alias("gap"))
    return both.agg(F.avg("gap").alias("corr_matrix_mean_abs_diff"))


def compare(ref: DataFrame, cur: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """``(column, statistic, value)``: KS and PSI per column, then the correlation difference."""
    per_column = ks(ref, cur, columns).select("column", F.lit("ks").alias("statistic"), F.col("ks").alias("value"))
    per_column = per_column.unionByName(
        psi(ref, cur, columns, bins).select("column", F.lit("psi").alias("statistic"), F.col("psi").alias("value"))
    )
    overall = corr_diff(ref, cur, columns).select(
        F.lit("*").alias("column"),
        F.lit("corr_matrix_mean_abs_diff").alias("statistic"),
        F.col("corr_matrix_mean_abs_diff").alias("value"),
    )
    return per_column.unionByName(overall)


def feature_columns(columns: Sequence[str], label: str = LABEL, p: str = SCORE) -> list[str]:
    """Columns a drift check looks at: no label, no predictions, no identifiers."""
    skip = {label, p, "prediction", "risk_level", KEY, *DEFAULTS.id_columns}
    return [c for c in columns if c not in skip]


def _wasserstein(ref: DataFrame, cur: DataFrame, columns: Sequence[str]) -> DataFrame:
    points = paired_points(ref, cur, columns)
    run = running(points, ["column"], "value", ["n_ref", "n_cur"], following="next")
    area = run.groupBy("column").agg(
        F.sum(_cdf_gap() * F.coalesce(F.col("next") - F.col("value"), F.lit(0.0))).alias("area")
    )
    row = ref.agg(*[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(columns)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("spread")) for i, c in enumerate(columns)]
    spread = row.select(F.explode(F.array(*cells)).alias("r")).select("r.*")
    return area.join(F.broadcast(spread), "column").select(
        "column",
        F.lit("wasserstein_normed").alias("method"),
        (F.col("area") / F.greatest(F.col("spread"), F.lit(MIN_SPREAD))).alias("value"),
    )


def _jensen_shannon(ref: DataFrame, cur: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = _text_counts(_stacked(ref, cur, columns), columns, ["_ref"])
    sides = counts.groupBy("column", "value").agg(
        F.sum(F.when(F.col("_ref") == 1, F.col("n")).otherwise(0)).alias("n_ref"),
        F.sum(F.when(F.col("_ref") == 0, F.col("n")).otherwise(0)).alias("n_cur"),
    )
    totals = sides.groupBy("column").agg(F.sum("n_ref").alias("all_ref"), F.sum("n_cur").alias("all_cur"))
    p, q = F.col("n_ref") / F.col("all_ref"), F.col("n_cur") / F.col("all_cur")
    m = (p + q) / 2
    term = F.when(p > 0, p * F.ln(p / m)).otherwise(0.0) + F.when(q > 0, q * F.ln(q / m)).otherwise(0.0)
    # One row per compared column.
    joined = sides.join(F.broadcast(totals.where((F.col("all_ref") > 0) & (F.col("all_cur") > 0))), "column")
    return joined.groupBy("column").agg(
        F.lit("jensen_shannon").alias("method"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum(term) / 2)).alias("value"),
    )


def column_drift(
    ref: DataFrame,
    cur: DataFrame,
    columns: Sequence[str] | None = None,
    threshold: float = DEFAULTS.column_drift_threshold,
) -> DataFrame:
    """``(column, method, value, drifted)`` per feature column.

    Numeric columns: Wasserstein distance in units of the reference's standard
    deviation. Text columns: Jensen-Shannon distance of the category shares.
    A column drifts when its distance exceeds the threshold.
    """
    columns = list(columns or feature_columns(ref.columns))
    numeric = [c for c in columns_of_type(ref, "numeric") if c in columns]
    text = [c for c in columns_of_type(ref, "string") if c in columns]
    parts = [f(ref, cur, cs) for f, cs in ((_wasserstein, numeric), (_jensen_shannon, text)) if cs]
    if not parts:
        raise ValueError("no numeric or text column to compare")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("drifted", F.coalesce(F.col("value") > threshold, F.lit(False)))


def data_drift(column_rows: DataFrame, share_threshold: float = DEFAULTS.drift_share_threshold) -> DataFrame:
    """One row from ``column_drift`` rows: counts, share and the drifted columns with their distance."""
    drifted = F.count_if("drifted")
    share = drifted / F.count("*")
    hits = F.sort_array(F.collect_list(F.when(F.col("drifted"), F.struct("column", "value"))))
    return column_rows.agg(
        (drifted > 0).alias("drift_detected"),
        share.alias("drift_share"),
        (share >= share_threshold).alias("share_exceeded"),
        drifted.alias("n_drifted_columns"),
        F.count("*").alias("n_total_columns"),
        F.map_from_entries(hits).alias("drifted_columns"),
    )


def prediction_drift(
    ref: DataFrame,
    cur: DataFrame,
    p: str = SCORE,
    threshold: float = DEFAULTS.prediction_drift_threshold,
    default_reference: float | None = None,
) -> DataFrame:
    """One row: mean score of both sides, the shift and whether it exceeds the threshold.

    ``default_reference`` stands in when the reference has no scores. Without
    current scores there is no drift to detect.
    """
    schema = "prediction_drift_detected boolean, reference_mean double, current_mean double, mean_shift double"
    if p not in cur.columns:
        return cur.sparkSession.createDataFrame([(False, None, None, None)], schema)
    current = cur.agg(F.avg(p).alias("current_mean"))
    if p in ref.columns:
        reference = ref.agg(F.avg(p)).scalar()
    elif default_reference is not None:
        reference = F.lit(float(default_reference))
    else:
        raise ValueError(f"the reference has no column {p!r} and no default was given")
    both = current.withColumn("reference_mean", reference)
    shift = F.col("current_mean") - F.col("reference_mean")
    return both.select(
        F.coalesce(F.abs(shift) > threshold, F.lit(False)).alias("prediction_drift_detected"),
        "reference_mean",
        "current_mean",
        shift.alias("mean_shift"),
    )


def performance_drift(
    ref: DataFrame,
    cur: DataFrame,
    y: str = LABEL,
    p: str = SCORE,
    key: str = KEY,
    threshold: float = DEFAULTS.performance_drop_threshold,
) -> DataFrame:
    """One row: drop of PR-AUC, precision and recall at K from reference to current."""
    for side, df in (("reference", ref), ("current", cur)):
        missing = [c for c in (y, p) if c not in df.columns]
        if missing:
            raise ValueError(f"{side} data lacks column {missing[0]!r}")
    cols = [y, p, key]
    both = ref.select(*cols, F.lit("reference").alias("side")).unionByName(
        cur.select(*cols, F.lit("current").alias("side"))
    )
    m = all_metrics(both, y, p, key, by=["side"])

    def side(name: str, c: str) -> Column:
        return F.max(F.when(F.col("side") == name, F.col(c)))

    drops = {
        f"{out}_drop": side("reference", c) - side("current", c)
        for out, c in (
            ("pr_auc", "pr_auc"),
            ("precision_at_k", "top_precision_at_k"),
            ("recall_at_k", "top_recall_at_k"),
        )
    }
    row = m.agg(*[c.alias(name) for name, c in drops.items()])
    worst = F.greatest(*[F.col(name) for name in drops])
    return row.withColumn("performance_degraded", F.coalesce(worst > threshold, F.lit(False)))
