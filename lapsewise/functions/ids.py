"""Identifiers, built from native hash and date expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.config import KEY

# Fixed value: the namespace under which customer ids become UUIDs.
CUSTOMER_NAMESPACE = "59e0ac34-a656-49e5-b518-c971aad9c4d5"


def uuid5(column: Column | str, namespace: str = CUSTOMER_NAMESPACE) -> Column:
    """Name-based (version 5) UUID of the column's decimal text."""
    c = F.col(column) if isinstance(column, str) else column
    name = c.cast("string").cast("binary")
    prefix = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.sha1(F.concat(prefix, name))
    # The variant digit keeps its two low bits and gets the high bits "10".
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, 1)
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def with_customer_uuid(df: DataFrame, id_col: str = "CustomerId", out: str = KEY) -> DataFrame:
    """Add the customer key; a null id gives a null key for validation to catch."""
    if id_col not in df.columns:
        raise ValueError(f"column {id_col!r} is needed to derive {out!r}")
    return df.withColumn(out, F.when(F.col(id_col).isNotNull(), uuid5(id_col)))


def job_id() -> Column:
    """Random (version 4) UUID."""
    return F.uuid()


def run_id(prefix: str, microseconds: bool = True, at: Column | None = None) -> Column:
    """``prefix_yyyyMMdd_HHmmss[_micros]`` of an instant, in the session zone (UTC)."""
    pattern = "yyyyMMdd_HHmmss" + ("_SSSSSS" if microseconds else "")
    when = F.current_timestamp() if at is None else at
    return F.concat(F.lit(prefix + "_"), F.date_format(when, pattern))
