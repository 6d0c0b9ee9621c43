"""Descriptive statistics: describes, counts, crosstabs, correlations, column roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.config import LABEL
from lapsewise.operators.gram import matrix
from lapsewise.operators.lookup import held_if_small
from lapsewise.operators.ordered import long_columns, quantiles, running, value_points
from lapsewise.operators.quality import columns_of_type


def _rows(row: DataFrame, cells: list[Column], keep: Sequence[str] = ()) -> DataFrame:
    return row.select(*keep, F.explode(F.array(*cells)).alias("r")).select(*keep, "r.*")


def column_stats(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), more: dict | None = None
) -> DataFrame:
    """``(*by, column, count, mean, std, min, max)`` in one pass; nulls are skipped.
    ``more`` adds further statistics as functions of the value."""
    value = F.col("value")
    parts = {
        "count": F.count(value),
        "mean": F.avg(value),
        "std": F.stddev_samp(value),
        "min": F.min(value),
        "max": F.max(value),
        **{name: f(value) for name, f in (more or {}).items()},
    }
    # Columns as rows: a handful of aggregates for any number of columns compiles to
    # small code, and each task sends on one row per group and column.
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    long = df.select(*by, F.explode(F.array(*cells)).alias("cell")).select(*by, "cell.*")
    return long.groupBy(*by, "column").agg(*[f.alias(name) for name, f in parts.items()])


def _wide_quantiles(q: DataFrame, by: Sequence[str], names: dict[float, str]) -> DataFrame:
    picks = [F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name) for p, name in names.items()]
    return q.groupBy(*by).agg(*picks)


QUARTILES = {0.25: "q25", 0.5: "q50", 0.75: "q75"}


def numeric_describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: count, mean, std, min, quartiles, max. Quartiles are exact."""
    shown = ["column", "count", "mean", "std", "min", *QUARTILES.values(), "max"]
    if not long_columns(df, columns):
        # Few distinct values everywhere: the quartiles come out of the same pass.
        exact = {"q": lambda c: F.percentile(c, F.array(*[F.lit(p) for p in QUARTILES]))}
        named = {name: F.col("q")[i] for i, name in enumerate(QUARTILES.values())}
        return column_stats(df, columns, more=exact).withColumns(named).select(*shown)
    q = _wide_quantiles(quantiles(df, columns, list(QUARTILES)), ["column"], QUARTILES)
    return column_stats(df, columns).join(F.broadcast(q), "column", "left").select(*shown)


def _text_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, column, value, n)`` over non-null cells as text, one shuffle for all columns."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    long = df.select(*by, F.explode(F.array(*cells)).alias("cell")).where(F.col("cell.value").isNotNull())
    return long.groupBy(*by, "cell.column", "cell.value").agg(F.count("*").alias("n"))


def string_describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: count, distinct values, most frequent value (first by name on a tie)."""
    top = F.min(F.struct((-F.col("n")).alias("minus_n"), "value")).alias("top")
    out = _text_counts(df, columns).groupBy("column").agg(
        F.sum("n").alias("count"), F.count("*").alias("unique"), top
    )
    return out.select("column", "count", "unique", F.col("top.value").alias("top"), (-F.col("top.minus_n")).alias("freq"))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """``(column, distinct)`` non-null values per column; exact unless asked otherwise."""
    columns = list(columns or df.columns)
    if approximate:
        row = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(f"d{i}") for i, c in enumerate(columns)])
        return _rows(
            row, [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("distinct")) for i, c in enumerate(columns)]
        )
    return _text_counts(df, columns).groupBy("column").agg(F.count("*").alias("distinct"))


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with at most one distinct non-null value (a column of nulls has none).

    One pass of min and max per column: no distinct count is needed to tell one
    value from several.
    """
    columns = list(columns or df.columns)
    row = df.agg(
        *[F.min(f"`{c}`").cast("string").alias(f"lo{i}") for i, c in enumerate(columns)],
        *[(F.max(f"`{c}`") > F.min(f"`{c}`")).alias(f"many{i}") for i, c in enumerate(columns)],
    )
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"lo{i}").alias("value"),
            F.coalesce(F.col(f"many{i}"), F.lit(False)).alias("many"),
        )
        for i, c in enumerate(columns)
    ]
    return _rows(row, cells).where(~F.col("many")).select("column", "value")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``(column, n, share)`` per value, most frequent first."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = df.agg(F.count(column)).scalar()
    return counts.withColumn("share", F.col("n") / total).orderBy(F.col("n").desc(), column)


def target_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    """One row: rows per class, shares and the majority-to-minority ratio."""
    ones, zeros, n = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0), F.count(label)
    return df.agg(
        zeros.alias("retained"),
        ones.alias("churned"),
        (zeros / n).alias("retained_share"),
        (ones / n).alias("churned_share"),
        F.when(F.least(ones, zeros) > 0, F.greatest(ones, zeros) / F.least(ones, zeros)).alias("imbalance_ratio"),
    )


def crosstab(df: DataFrame, row: Column, name: str, column: str = LABEL, values: Sequence = (0, 1), normalize: bool = False) -> DataFrame:
    """Counts of ``row`` x ``column`` for the given column values, or shares of each row."""
    out = df.withColumn(name, row).where(F.col(name).isNotNull()).groupBy(name).agg(
        *[F.count_if(F.col(column) == v).alias(f"{column}_{v}") for v in values]
    )
    if not normalize:
        return out
    names = [f"{column}_{v}" for v in values]
    total = sum((F.col(c) for c in names), F.lit(0))
    return out.select(name, *[(F.col(c) / total).alias(c) for c in names])


def group_describe(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Per group: mean, median, count of a column."""
    mean, count = F.avg(column).alias("mean"), F.count(column).alias("count")
    if not long_columns(df, [column]):
        median = F.percentile(F.col(column).cast("double"), F.lit(0.5)).alias("median")
        return df.groupBy(*by).agg(mean, median, count)
    medians = group_median(df, by, column)
    return df.groupBy(*by).agg(mean, count).join(medians, list(by), "left").select(*by, "mean", "median", "count")


def group_median(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    return quantiles(df, [column], [0.5], by).select(*by, F.col("quantile").alias("median"))


def group_rate(df: DataFrame, by: str | Column, name: str, value: str = LABEL) -> DataFrame:
    """Mean of a column per group, e.g. the churn rate per category."""
    key = F.col(by) if isinstance(by, str) else by
    return df.groupBy(key.alias(name)).agg(F.avg(value).alias("rate"), F.count("*").alias("n"))


def five_number(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Box-plot input: min, quartiles and max per group and column."""
    names = {0.0: "min", 0.25: "q25", 0.5: "median", 0.75: "q75", 1.0: "max"}
    return _wide_quantiles(quantiles(df, columns, list(names), by), [*by, "column"], names)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """``(bin, low, high, n)`` over equal-width bins from min to max, the last one closed."""
    value = F.col(column).cast("double")
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    lo, hi = ends["lo"] or 0.0, ends["hi"] or 0.0
    width = (hi - lo) / bins
    index = F.least(F.floor((value - lo) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
    out = df.where(value.isNotNull()).groupBy(index.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return out.select("bin", (lo + F.col("bin") * width).alias("low"), (lo + (F.col("bin") + 1) * width).alias("high"), "n")


def corr_matrix(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, row, column, correlation)``; each pair over the rows where both are present.
    A constant column has no correlation, not even with itself."""
    spread = F.sqrt(F.col("cxx")) * F.sqrt(F.col("cyy"))
    return matrix(df, columns, F.when((F.col("cxx") > 0) & (F.col("cyy") > 0), F.col("cxy") / spread), "correlation", by)


def cov_matrix(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, row, column, covariance)``, sample covariance; null below two rows."""
    return matrix(df, columns, F.when(F.col("n") > 1, F.col("cxy") / (F.col("n") - 1)), "covariance", by)


def target_correlation(df: DataFrame, label: str = LABEL, n: int = 15, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns by the size of their correlation with the label, top ``n``."""
    columns = [c for c in (columns or columns_of_type(df, "numeric")) if c != label]
    row = df.agg(*[F.corr(f"`{c}`", label).alias(f"c{i}") for i, c in enumerate(columns)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("correlation")) for i, c in enumerate(columns)]
    size = F.round(F.abs("correlation"), 9)
    return _rows(row, cells).where(F.col("correlation").isNotNull()).orderBy(size.desc(), "column").limit(n)


# Names taken as identifiers, compared in lower case.
ID_NAMES = ("rownumber", "row_number", "customerid", "customer_id", "customer_uuid")
FEW_VALUES = 5


def column_roles(df: DataFrame) -> DataFrame:
    """``(column, role, min, max, mean, std)``: id, binary, categorical or numerical.

    A numeric column with at most five distinct values is binary if they are 0 and
    1 alone, otherwise categorical. Statistics are given for numerical columns.
    """
    numeric = [c for c in columns_of_type(df, "numeric") if c.lower() not in ID_NAMES]
    # A sketch settles the long columns; only short ones are counted exactly. Both
    # results have one row per column.
    zero_one = lambda c: F.coalesce(F.bool_and(c.isin(0, 1)), F.lit(True))
    seen = column_stats(df, numeric, more={"about": F.approx_count_distinct, "zero_one": zero_one}).collect()
    short = [r["column"] for r in seen if r["about"] <= 100 * FEW_VALUES]
    exact = {r["column"]: r["distinct"] for r in distinct_counts(df, short).collect()} if short else {}
    rows = []
    for r in seen:
        few = r["column"] in short and exact.get(r["column"], 0) <= FEW_VALUES
        role = ("binary" if r["zero_one"] else "categorical") if few else "numerical"
        rows.append((r["column"], role, *[None if few else r[c] for c in ("min", "max", "mean", "std")]))
    for c in df.columns:
        if c not in numeric:
            rows.append((c, "id" if c.lower() in ID_NAMES else "categorical", None, None, None, None))
    schema = "column string, role string, min double, max double, mean double, std double"
    return df.sparkSession.createDataFrame(rows, schema)


def average_rank(df: DataFrame, column: str, out: str = "rank_share") -> DataFrame:
    """Add the mean rank of the row's value (ties share it) divided by n + 1.

    Ranks are worked out on the distinct values and joined back.
    """
    points = value_points(df, [column], {"n": F.lit(1)})
    run = running(points, ["column"], "value", ["n"])
    mean_rank = F.col("cum_n") - (F.col("n") - 1) / 2
    ranks = run.select(
        F.col("value").alias("_v"),
        (mean_rank / (F.col("total_n") + 1)).alias(out),
        # At most 1,000 values can each hold a thousandth of the rows.
        (F.col("n") * 1000 >= F.col("total_n")).alias("_frequent"),
    )
    rows = df.withColumn("_v", F.col(column).cast("double"))
    small = held_if_small(ranks)
    if small is not None:
        return rows.join(F.broadcast(small), "_v", "left").drop("_v", "_frequent")
    # Frequent values go to every task, so that none is gathered in one.
    hot = F.broadcast(ranks.where("_frequent").drop("_frequent"))
    rest = ranks.where(~F.col("_frequent")).drop("_frequent")
    seldom = rows.join(hot.select("_v"), "_v", "left_anti").join(rest, "_v", "left")
    return rows.join(hot, "_v").unionByName(seldom).drop("_v")
