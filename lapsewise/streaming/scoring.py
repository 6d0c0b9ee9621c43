"""Scoring, de-duplicating and upserting customer files as they arrive."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lapsewise.config import DEFAULTS, KEY, REQUEST_FEATURES
from lapsewise.functions.text import normalize
from lapsewise.operators.quality import require_columns
from lapsewise.sources.readers import RAW_CUSTOMER_SCHEMA
from lapsewise.sources.rejects import REJECTED, column_types, fitting, marked, set_aside, text_cells
from lapsewise.sources.versions import merge_version, version_at


def read_customer_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType = RAW_CUSTOMER_SCHEMA,
    files_per_trigger: int = DEFAULTS.csv_files_per_trigger,
) -> DataFrame:
    """CSV files of a folder, each read once, a bounded number per micro-batch. Rows with
    cells that do not fit are left out; ``quarantine_stream`` keeps them."""
    types = column_types(schema)
    return fitting(marked(text_cells(spark, path, schema, stream=True, maxFilesPerTrigger=files_per_trigger), types), types)


def quarantine_stream(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    schema: T.StructType = RAW_CUSTOMER_SCHEMA,
    files_per_trigger: int = DEFAULTS.csv_files_per_trigger,
) -> StreamingQuery:
    """Append the rows that ``read_customer_stream`` leaves out as Parquet, then stop.

    ``observedMetrics["cells"]`` of its progress counts all rows and those set aside.
    """
    rows = marked(text_cells(spark, in_dir, schema, stream=True, maxFilesPerTrigger=files_per_trigger), column_types(schema))
    seen = rows.observe("cells", F.count(F.lit(1)).alias("rows"), F.count_if(F.size(REJECTED) > 0).alias("rejected"))
    return (
        set_aside(seen, in_dir)
        .writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def observed(queries: Iterable[StreamingQuery], name: str) -> dict[str, int]:
    """Observed counts of some finished queries, added up over the batches that Spark
    still remembers (``spark.sql.streaming.numRecentProgressUpdates``)."""
    totals: Counter[str] = Counter()
    for query in queries:
        for progress in query.recentProgress:
            metrics = progress.observedMetrics.get(name)
            totals.update(metrics.asDict() if metrics is not None else {})
    return dict(totals)


def prepare(stream: DataFrame, required: Sequence[str] = REQUEST_FEATURES, keep: Sequence[str] = ("CustomerId",)) -> DataFrame:
    """Normalised rows with the required features; missing headers are an error at start."""
    rows = normalize(stream)
    return require_columns(rows, [*[c for c in keep if c in rows.columns], *required])


def score_stream(
    spark: SparkSession,
    in_dir: str,
    scorer: Callable[[DataFrame], DataFrame],
    out_dir: str,
    checkpoint: str,
    schema: T.StructType = RAW_CUSTOMER_SCHEMA,
    files_per_trigger: int = DEFAULTS.csv_files_per_trigger,
) -> StreamingQuery:
    """Score whatever has arrived and append it as Parquet, then stop.

    The checkpoint remembers the files done, so the next start takes only new ones.
    """
    rows = prepare(read_customer_stream(spark, in_dir, schema, files_per_trigger))
    return (
        scorer(rows)
        .writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def deduplicated(stream: DataFrame, event_time: str, late: str = "1 day", key: str = KEY) -> DataFrame:
    """First row of a key within the watermark; the state kept is bounded by it."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def upsert_stream(
    stream: DataFrame,
    base_dir: str,
    checkpoint: str,
    update_cols: Sequence[str],
    key: str = KEY,
    order: str | None = None,
) -> StreamingQuery:
    """Merge every micro-batch into the versioned table at ``base_dir``, then stop.

    Only the buckets that a batch touches are written anew. The table records the last
    batch of each query, so a batch that runs again after a failure changes nothing, and a
    query with a fresh checkpoint goes on from the newest version.
    """
    spark = stream.sparkSession
    name = f"upsert-{uuid.uuid4().hex}"
    if version_at(spark, base_dir).key != key:
        raise ValueError(f"the table at {base_dir} is not kept by {key!r}")

    def merge(batch: DataFrame, batch_id: int) -> None:
        query = next(q for q in spark.streams.active if q.name == name)
        merge_version(batch, base_dir, update_cols, source=(str(query.id), batch_id), order=order or "updated_at")

    return (
        stream.writeStream.queryName(name)
        .foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
