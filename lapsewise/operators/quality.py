"""Validation reports, leakage, imbalance, missing values, duplicates, cleaning."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapsewise.config import DEFAULTS, KEY, LABEL, Settings


@dataclass(frozen=True)
class Rule:
    """What one column must satisfy. Nulls always fail."""

    column: str
    type: str
    low: float | None = None
    high: float | None = None
    domain: tuple = ()
    unique: bool = False


# Ranges and domains of the customer table.
_CUSTOMER_RULES = (
    Rule("CreditScore", "int", 300, 850),
    Rule("Geography", "string", domain=("France", "Spain", "Germany")),
    Rule("Gender", "string", domain=("Male", "Female")),
    Rule("Age", "int", 18, 100),
    Rule("Tenure", "int", 0, 10),
    Rule("Balance", "double", 0),
    Rule("NumOfProducts", "int", 1, 4),
    Rule("HasCrCard", "int", domain=(0, 1)),
    Rule("IsActiveMember", "int", domain=(0, 1)),
    Rule("EstimatedSalary", "double", 0, 200_000),
    Rule("PointEarned", "int", 0),
    Rule("CardType", "string", domain=("Silver", "Gold", "Diamond", "Platinum")),
    Rule("Exited", "int", domain=(0, 1)),
)
RAW_RULES = (
    Rule("RowNumber", "bigint"),
    Rule("CustomerId", "bigint"),
    Rule("Surname", "string"),
    *_CUSTOMER_RULES,
)
TRAINING_RULES = (Rule("customer_uuid", "string", unique=True), *_CUSTOMER_RULES)
REQUEST_RULES = tuple(
    Rule("Age", "int", 10, 100) if r.column == "Age" else r
    for r in _CUSTOMER_RULES
    if r.column not in ("PointEarned", "Exited")
)


def coerced(column: str, dtype: str) -> Column:
    """Cast without raising: what does not fit becomes null, and a fraction is
    never cut down to a whole number."""
    c = F.col(f"`{column}`")
    out = c.try_cast(dtype)
    if dtype in ("int", "bigint"):
        number = c.try_cast("double")
        out = F.when(number.isNull() | (number == F.floor(number)), out)
    return out


def coerce(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return df.withColumns({r.column: coerced(r.column, r.type) for r in rules if r.column in df.columns})


def _checks(rule: Rule) -> dict[str, Column]:
    """Name -> condition under which a row breaks the rule."""
    raw, value = F.col(f"`{rule.column}`"), coerced(rule.column, rule.type)
    out = {"not_null": raw.isNull(), "type": raw.isNotNull() & value.isNull()}
    if rule.low is not None:
        out["at_least"] = value < rule.low
    if rule.high is not None:
        out["at_most"] = value > rule.high
    if rule.domain:
        out["one_of"] = ~value.isin(*rule.domain)
    return out


_REPORT = "column string, check string, failures bigint"


def validation_report(df: DataFrame, rules: Sequence[Rule], strict: bool = False) -> DataFrame:
    """``(column, check, failures)`` for every check, all counted in one pass.

    ``strict`` also reports columns no rule names. A unique column adds one
    aggregate of its own, so the wide pass stays free of distinct counts.
    """
    present = [r for r in rules if r.column in df.columns]
    absent = [r.column for r in rules if r.column not in df.columns]
    named = {r.column for r in rules}
    extra = [c for c in df.columns if c not in named] if strict else []
    failing = {(r.column, name): F.count_if(cond) for r in present for name, cond in _checks(r).items()}
    fixed = [(c, "present", 1) for c in absent] + [(c, "expected", 1) for c in extra]
    counted = df.agg(*[c.alias(f"f{i}") for i, c in enumerate(failing.values())])
    cells = [
        F.struct(F.lit(col).alias("column"), F.lit(check).alias("check"), F.col(f"f{i}").alias("failures"))
        for i, (col, check) in enumerate(failing)
    ] + [
        F.struct(F.lit(c).alias("column"), F.lit(k).alias("check"), F.lit(n).cast("long").alias("failures"))
        for c, k, n in fixed
    ]
    report = counted.select(F.explode(F.array(*cells)).alias("r")).select("r.*")
    for r in present:
        if r.unique:
            repeated = df.groupBy(F.col(f"`{r.column}`").alias("v")).count().where(F.col("v").isNotNull())
            report = report.unionAll(
                repeated.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("failures")).select(
                    F.lit(r.column).alias("column"), F.lit("unique").alias("check"), "failures"
                )
            )
    return report


class ValidationError(ValueError):
    """Raised with every failed check; ``failures`` holds them as tuples."""

    def __init__(self, failures: list[tuple[str, str, int]]):
        self.failures = failures
        text = "; ".join(f"{c}: {k} ({n})" for c, k, n in failures)
        super().__init__(f"validation failed: {text}")


def validate(df: DataFrame, rules: Sequence[Rule], strict: bool = False) -> DataFrame:
    """The coerced frame, or ``ValidationError`` with all failures at once."""
    failed = validation_report(df, rules, strict).where("failures > 0").orderBy("column", "check").collect()
    if failed:
        raise ValidationError([(r["column"], r["check"], r["failures"]) for r in failed])
    return coerce(df, rules)


def row_errors(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``errors``, the broken checks of each row as ``column:check`` texts.
    Rows with an empty list pass; the rest can be written to quarantine."""
    broken = [
        F.when(cond, F.lit(f"{r.column}:{name}"))
        for r in rules
        if r.column in df.columns
        for name, cond in _checks(r).items()
    ]
    return df.withColumn("errors", F.array_compact(F.array(*broken)))


def staged(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Coerced rows that carry their ``errors``, for jobs that write them once and
    read the verdict from that table instead of parsing the source twice."""
    absent = [(r.column, "present", 1) for r in rules if r.column not in df.columns]
    if absent:
        raise ValidationError(absent)
    return coerce(row_errors(df, rules), rules)


def accepted(rows: DataFrame) -> DataFrame:
    """Staged rows without their errors, or ``ValidationError`` if any row has one."""
    counts = rows.select(F.explode("errors").alias("error")).groupBy("error").count().orderBy("error").collect()
    if counts:
        raise ValidationError([(*r["error"].split(":"), r["count"]) for r in counts])
    return rows.drop("errors")


def leakage_columns(columns: Sequence[str], settings: Settings = DEFAULTS, keep: str = KEY) -> list[str]:
    """Sorted names that must not reach training: configured columns, identifiers
    and anything that looks like a model's own output."""
    listed = set(settings.leakage_columns) | set(settings.id_columns)
    return sorted(c for c in columns if c != keep and (c in listed or c.startswith(("pred", "shap"))))


def correlated_leakage(df: DataFrame, columns: Sequence[str], label: str = LABEL, limit: float = 0.99) -> DataFrame:
    """``(column, correlation)`` of numeric columns that all but equal the label."""
    row = df.agg(*[F.corr(f"`{c}`", label).alias(f"c{i}") for i, c in enumerate(columns)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("correlation")) for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*cells)).alias("r")).select("r.*").where(F.abs("correlation") >= limit)


def class_balance(df: DataFrame, label: str = LABEL, minimum: float = DEFAULTS.min_minority_share) -> DataFrame:
    """One row: counts per class, minority share and whether it reaches the minimum."""
    rate = F.avg(F.col(label).cast("double"))
    share = F.least(rate, 1 - rate)
    return df.agg(
        F.count_if(F.col(label) == 0).alias("retained"),
        F.count_if(F.col(label) == 1).alias("churned"),
        share.alias("minority_share"),
        F.lit(minimum).alias("minimum"),
        (share >= minimum).alias("passed"),
    )


def missing_share(df: DataFrame, limit: float = DEFAULTS.max_missing_share) -> DataFrame:
    """``(column, missing, missing_share, passed)`` for every column, one pass."""
    row = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(df.columns)]
    out = row.select("n", F.explode(F.array(*cells)).alias("r")).select("n", "r.*")
    share = F.when(F.col("n") > 0, F.col("missing") / F.col("n")).otherwise(F.lit(0.0))
    return out.select("column", "missing", share.alias("missing_share"), (share <= limit).alias("passed"))


def null_cells(df: DataFrame) -> DataFrame:
    """One row: null cells over all columns."""
    return df.agg(sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0)).alias("null_cells"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: rows that repeat an earlier row in every column."""
    distinct = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_n"))
    return distinct.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def keep_first(df: DataFrame, key: str = KEY, order: str = "RowNumber") -> DataFrame:
    """First row per key; equal positions are told apart by the other columns, in their
    order, and a missing position comes last. An aggregate with a map-side step: however
    many rows one key has, each input partition sends on a single row of it."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != key]
    place = F.col(f"`{order}`")
    first = F.min(F.struct(place.isNull().alias("missing"), place.alias("place"), F.struct(*rest).alias("row")))
    return df.groupBy(key).agg(first["row"].alias("row")).select(key, "row.*").select(*[f"`{c}`" for c in df.columns])


def clean(
    df: DataFrame,
    key: str = KEY,
    order: str = "RowNumber",
    drop_nulls: bool = True,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """First row per key, without leakage columns, without rows that have a null."""
    dropped = leakage_columns(df.columns, settings, keep=key)
    # The order column is itself dropped, so it is carried under another name.
    kept = [F.col(f"`{c}`") for c in df.columns if c not in dropped]
    narrow = df.select(*kept, F.col(f"`{order}`").alias("_order"))
    out = keep_first(narrow, key, "_order").drop("_order")
    return out.dropna("any") if drop_nulls else out


def clean_report(before: DataFrame, key: str = KEY, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: rows in, repeated keys, rows with a null among first rows, rows out, columns dropped."""
    dropped = leakage_columns(before.columns, settings, keep=key)
    kept = clean(before, key, drop_nulls=False, settings=settings)
    any_null = F.lit(False)
    for c in kept.columns:
        any_null = any_null | F.col(f"`{c}`").isNull()
    # Rows per key first, so that rows in, keys and nulls come from one pass.
    per_key = before.groupBy(key).agg(F.count("*").alias("_n"))
    rows = per_key.agg(F.sum("_n").alias("rows_in"), F.count("*").alias("keys"))
    nulls = kept.agg(F.count_if(any_null).alias("null_rows"))
    return rows.withColumn("null_rows", nulls.scalar()).select(
        "rows_in",
        (F.col("rows_in") - F.col("keys")).alias("duplicates_removed"),
        F.col("null_rows").alias("null_rows_removed"),
        (F.col("keys") - F.col("null_rows")).alias("rows_out"),
        F.lit(len(dropped)).alias("columns_removed"),
    )


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Exactly the required columns; the error names the missing ones in order."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.select(*[f"`{c}`" for c in required])


def split_target(df: DataFrame, target: str = LABEL) -> tuple[DataFrame, DataFrame]:
    """Feature columns and the target column."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is not in the table")
    return df.drop(target), df.select(target)


def columns_of_type(df: DataFrame, kind: str) -> list[str]:
    """Names of the numeric or the string columns."""
    wanted = {"numeric": T.NumericType, "string": T.StringType}[kind]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, wanted)]
