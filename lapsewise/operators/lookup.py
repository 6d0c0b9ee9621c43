"""Small tables next to large ones, with their size checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows a table may have to be held by the driver and sent to every task.
BROADCAST_ROWS = 100_000


def held_if_small(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame | None:
    """The table computed once and held as local rows, or None above ``limit`` rows."""
    rows = table.limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        return None
    return table.sparkSession.createDataFrame(rows, table.schema)


def attach(df: DataFrame, table: DataFrame, on: str, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a lookup table with unique keys.

    Up to ``limit`` rows it is broadcast, so the large side is not shuffled and a
    frequent key costs nothing. Above that it is an ordinary join, whose skewed
    keys Spark splits at run time.
    """
    small = held_if_small(table, limit)
    return df.join(table if small is None else F.broadcast(small), on, how)
