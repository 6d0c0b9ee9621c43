"""Writing results: files, tables, upserts and job records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.config import KEY
from lapsewise.sources.readers import CSV_FORMAT

COMPRESSIONS = ("snappy", "gzip", "brotli", "zstd")
_TABLE_MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", partition_by: Sequence[str] = ()) -> None:
    if compression not in COMPRESSIONS:
        raise ValueError(f"compression must be one of {', '.join(COMPRESSIONS)}")
    writer = df.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; blanks around a value are kept, as on reading."""
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**CSV_FORMAT, **blanks).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, name: str, if_exists: str = "replace", jdbc: Mapping | None = None) -> None:
    """Write to the catalog, or to a database given ``jdbc`` options."""
    if if_exists not in _TABLE_MODES:
        raise ValueError(f"if_exists must be one of {', '.join(_TABLE_MODES)}")
    writer = df.write.mode(_TABLE_MODES[if_exists])
    if jdbc is None:
        writer.saveAsTable(name)
    else:
        writer.format("jdbc").options(**jdbc).option("dbtable", name).save()


def execute(spark: SparkSession, statement: str, params: Mapping | None = None) -> DataFrame:
    """Run one DDL or DML statement."""
    return spark.sql(statement, args=dict(params) if params else None)


def as_document(df: DataFrame, key: str = KEY) -> Column:
    """JSON text of every column but the key; null fields are kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != key]), {"ignoreNullFields": "false"})


def customer_records(df: DataFrame, run_id: str, at: Column) -> DataFrame:
    """Rows of the ``customers`` table for one ingestion run."""
    return df.select(
        KEY,
        F.col("CustomerId").alias("bank_customer_id"),
        F.col("Surname").alias("surname"),
        as_document(df).alias("raw_data"),
        F.lit(run_id).alias("ingestion_run_id"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def upsert(target: DataFrame, batch: DataFrame, key: str, update_cols: Sequence[str]) -> DataFrame:
    """Merged rows: matched keys take ``update_cols`` from the batch and keep the
    rest, unseen keys are inserted whole, untouched keys stay.

    ``batch`` holds each key once (de-duplicate it first). The caller writes the
    result as a new version; plain Parquet cannot be replaced while it is read.
    """
    old, new = target.alias("old"), batch.withColumn("_hit", F.lit(True)).alias("new")
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    hit = F.col("new._hit").isNotNull()
    seen = F.col(f"old.{key}").isNotNull()

    def merged(c: str) -> Column:
        if c == key:
            return F.coalesce(F.col(f"old.{key}"), F.col(f"new.{key}"))
        take_new = hit if c in update_cols else hit & ~seen
        return F.when(take_new, F.col(f"new.`{c}`")).otherwise(F.col(f"old.`{c}`"))

    return joined.select(*[merged(c).alias(c) for c in target.columns])


UPSERT_COLUMNS = ("raw_data", "updated_at", "ingestion_run_id")


def latest_state(events: DataFrame, key: str = "job_id", order: str = "event_ts") -> DataFrame:
    """Last event per job; an aggregate, so one busy job cannot fill a task."""
    rest = [c for c in events.columns if c != key]
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(order, *[c for c in rest if c != order]))
    return events.groupBy(key).agg(last.alias("last")).select(key, "last.*")
