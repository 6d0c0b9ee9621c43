"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.sources.scratch import stored

__all__ = ["stored", "column", "keyed_text", "table", "lower_ascii", "spans_digest", "count_of", "small_batches", "release", "fresh", "without_ids"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bytes of text that one step inside a task handles at once; a longer text comes alone.
BATCH_BYTES = 8 << 20


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the system: a Python worker serves the tasks of many
    stages, and would keep what the largest of them took."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its whole name, also where the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def keyed_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text of a frame, as ``id`` and ``text``: further columns of
    the input never clash with those an operator makes."""
    return df.select(column(key).cast("long").alias("id"), column(text).cast("string").alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_ids(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is not among the ``id`` of the other frame. Rows with a
    null key are kept, and so are all columns, whatever their names."""
    name = fresh(docs, "id_to_drop")
    gone = ids.select(F.col("id").alias(name)).distinct()
    return docs.join(gone, column(key).cast("long") == F.col(name), "left_anti")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def spans_digest(spans: Column) -> Column:
    """``kind:start:end`` of each span in the array, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_of(kind: str) -> Column:
    """How many spans of one kind there are."""
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def small_batches(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes, so that memory does not follow
    the length of the texts; a single longer row stays whole."""
    for batch in batches:
        parts = max(1, math.ceil(batch.nbytes / limit))
        step = max(1, math.ceil(batch.num_rows / parts))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
    release()
