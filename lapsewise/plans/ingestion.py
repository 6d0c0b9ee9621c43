"""Ingestion: read, normalise, key, validate, clean, upsert, write, record the job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapsewise.config import DEFAULTS, KEY, Settings
from lapsewise.functions.ids import job_id, run_id, with_customer_uuid
from lapsewise.functions.text import normalize
from lapsewise.operators.quality import RAW_RULES, accepted, clean, coerced, keep_first, staged
from lapsewise.sources.readers import load, source_kind
from lapsewise.sources.rejects import LINE, REJECTED, column_types, fitting, marked, set_aside, text_cells
from lapsewise.sources.scratch import stored
from lapsewise.sources.versions import create_version, current_version, merge_version
from lapsewise.sources.writers import UPSERT_COLUMNS, customer_records, write_parquet

JOB_SCHEMA = (
    "job_id string, run_id string, job_type string, status string, input_path string,"
    " event_ts timestamp, rows_processed bigint, output_path string, error_message string"
)


def keyed(raw: DataFrame) -> DataFrame:
    """Normalised rows with the customer key."""
    return with_customer_uuid(normalize(raw))


def job_event(
    spark: SparkSession, job: str, run: str, status: str, input_path: str, rows: int | None = None,
    output_path: str | None = None, error: str | None = None, job_type: str = "ingestion",
) -> DataFrame:
    """One appended row of the job log; ``latest_state`` reads the current one."""
    row = [(job, run, job_type, status, input_path, None, rows, output_path, error)]
    return spark.createDataFrame(row, JOB_SCHEMA).withColumn("event_ts", F.current_timestamp())


@dataclass(frozen=True)
class Ingested:
    job: str
    run: str
    rows: int
    clean_path: str
    customers_path: str
    customers_version: int


def plain_table(spark: SparkSession, path: str) -> DataFrame | None:
    """Parquet files that lie in a folder itself, if there are any."""
    try:
        return spark.read.parquet(f"{path}/*.parquet")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def checked_cells(spark: SparkSession, source: str, schema: T.StructType, quarantine_path: str | None) -> DataFrame:
    """Staged rows of a CSV file whose cells were held against their types."""
    types = column_types(schema)
    rows = marked(text_cells(spark, source, schema), types)
    if quarantine_path:
        rows = stored(rows, "cells")
        set_aside(rows, source).write.mode("append").parquet(quarantine_path)
        return staged(fitting(rows, types), RAW_RULES)
    found = F.transform(F.col(REJECTED)["column"], lambda c: F.concat(c, F.lit(":type")))
    staged_rows = staged(rows, RAW_RULES)
    staged_rows = staged_rows.withColumn("errors", F.array_union("errors", found)).drop(REJECTED, LINE)
    return staged_rows.withColumns({c: coerced(c, t) for c, t in types.items() if c in staged_rows.columns})


def ingest(
    spark: SparkSession,
    source: str,
    clean_path: str,
    customers_path: str,
    jobs_path: str,
    known_customers: DataFrame | None = None,
    schema: T.StructType | None = None,
    settings: Settings = DEFAULTS,
    quarantine_path: str | None = None,
) -> Ingested:
    """Run the whole job. The source is parsed once; its validated rows are merged into the
    customers table, which keeps the customers of earlier deliveries. The table lies in
    versions: a job that dies leaves the newest one as it was. Where there is no version
    yet, it starts with ``known_customers`` or with a plain Parquet table found at
    ``customers_path``. The clean table, without identifiers, feeds training.

    Cells of a CSV file with a schema are read as text: one that does not fit fails the job
    as ``column:type``. With ``quarantine_path`` such rows, and lines with more or fewer
    cells than columns, are appended there instead, and the job goes on without them."""
    ids = spark.range(1).select(job_id().alias("job"), run_id("ingestion").alias("run")).first()
    job, run = ids["job"], ids["run"]
    job_event(spark, job, run, "running", source).write.mode("append").parquet(jobs_path)
    try:
        if schema is not None and source_kind(source) == "csv":
            rows = checked_cells(spark, source, schema, quarantine_path)
        else:
            rows = staged(normalize(load(spark, source)), RAW_RULES)
        rows = with_customer_uuid(accepted(stored(rows, "staged")))
        batch = customer_records(keep_first(rows), run, F.current_timestamp())
        if current_version(spark, customers_path) is None:
            known = plain_table(spark, customers_path) if known_customers is None else known_customers
            create_version(batch.limit(0) if known is None else known, customers_path, KEY)
        version = merge_version(batch, customers_path, UPSERT_COLUMNS)
        write_parquet(clean(rows, settings=settings), clean_path)
        n = spark.read.parquet(clean_path).count()
    except Exception as error:
        job_event(spark, job, run, "failed", source, error=str(error)).write.mode("append").parquet(jobs_path)
        raise
    job_event(spark, job, run, "completed", source, n, clean_path).write.mode("append").parquet(jobs_path)
    return Ingested(job, run, n, clean_path, customers_path, version)
