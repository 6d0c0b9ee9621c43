"""Watching the mean score over event time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lapsewise.operators.alerts import DEFAULT_LEVELS, Levels, severity


def mean_by_window(
    df: DataFrame, ts: str, p: str, width: str = "1 day", late: str = "1 hour", until: datetime | None = None
) -> DataFrame:
    """``(start, n, mean)`` per time bucket, for a batch or a stream.

    On a stream the watermark closes a bucket once no row can be late for it. Rows from
    ``until`` on move the watermark but are in no bucket: one of them closes all the others.
    """
    rows = df.withWatermark(ts, late) if df.isStreaming else df
    rows = rows if until is None else rows.where(F.col(ts) < until)
    out = rows.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.avg(p).alias("mean"))
    return out.select(F.col("w.start").alias("start"), "n", "mean")


def graded_shift(buckets: DataFrame, reference: float | Column, levels: Levels = DEFAULT_LEVELS) -> DataFrame:
    """Add the shift from the reference mean and its severity."""
    base = F.lit(reference) if isinstance(reference, float) else reference
    shift = F.col("mean") - base
    return buckets.withColumns({"mean_shift": shift, "severity": severity(F.abs(shift), levels.mean_shift)})


def monitor_stream(
    stream: DataFrame,
    ts: str,
    p: str,
    reference: float,
    out_dir: str,
    checkpoint: str,
    width: str = "1 day",
    late: str = "1 hour",
    levels: Levels = DEFAULT_LEVELS,
    until: datetime | None = None,
) -> StreamingQuery:
    """Append every bucket that has closed, with its shift and severity, as Parquet; then stop.

    The state holds open buckets only. Rows that come after their bucket has closed are
    dropped by the watermark; ``observedMetrics["arrivals"]`` counts all rows that came, so
    what is in no bucket in the end came late (``late_rows``).
    """
    timely = F.lit(True) if until is None else F.col(ts) < until
    seen = stream.observe("arrivals", F.count_if(timely).alias("rows"))
    buckets = graded_shift(mean_by_window(seen, ts, p, width, late, until), reference, levels)
    return (
        buckets.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def open_buckets(query: StreamingQuery) -> int:
    """Buckets still held as state after the last batch of a finished query."""
    last = query.lastProgress
    return sum(s.numRowsTotal for s in last.stateOperators) if last is not None else 0


def late_rows(closed: DataFrame, arrived: int) -> DataFrame:
    """How many of the rows that arrived are in no closed bucket, once no bucket is open."""
    return closed.agg((F.lit(arrived) - F.coalesce(F.sum("n"), F.lit(0))).alias("late_rows"))
