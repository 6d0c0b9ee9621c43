"""CSV cells that do not fit their column: seen, counted and set aside.

A reader with a schema turns such a cell into a null without a trace. Here the cells are
read as text first; what does not fit is kept beside the row as ``column`` and ``cell``.
Works on a batch and on a stream.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapsewise.config import HEADER_NAMES
from lapsewise.functions.text import normalize
from lapsewise.operators.quality import coerced
from lapsewise.sources.readers import CSV_FORMAT

# A line with more or fewer cells than there are columns, whole.
LINE = "_line"
REJECTED = "_rejected"
REJECT_SCHEMA = "source string, cells string, rejected array<struct<column string, cell string>>"


def column_types(schema: T.StructType, names: Mapping[str, str] = HEADER_NAMES) -> dict[str, str]:
    """Type of each column under its normalised name."""
    return {names.get(f.name, f.name): f.dataType.simpleString() for f in schema.fields}


def text_cells(spark: SparkSession, path: str, schema: T.StructType, stream: bool = False, **options) -> DataFrame:
    """The cells of a CSV file as text, and ``LINE`` where a line does not have the columns."""
    as_text = T.StructType([*(T.StructField(f.name, T.StringType()) for f in schema.fields), T.StructField(LINE, T.StringType())])
    reader = spark.readStream if stream else spark.read
    checked = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": LINE, "columnPruning": False}
    return reader.schema(as_text).options(**CSV_FORMAT, **checked).options(**options).csv(path)


def marked(cells: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Normalised text rows with ``REJECTED``, the cells that do not fit their type. A
    missing cell is no reject; a line of another length is one, as column ``LINE``."""
    rows = normalize(cells)
    known = [c for c in types if c in rows.columns]
    bad = [F.when(F.col(f"`{c}`").isNotNull() & coerced(c, types[c]).isNull(), F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("cell"))) for c in known]
    if LINE in rows.columns:
        bad.append(F.when(F.col(LINE).isNotNull(), F.struct(F.lit(LINE).alias("column"), F.col(LINE).alias("cell"))))
    return rows.withColumn(REJECTED, F.array_compact(F.array(*bad)))


def fitting(rows: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Rows of ``marked`` without rejects, in their types."""
    good = rows.where(F.size(REJECTED) == 0).drop(REJECTED, LINE)
    return good.withColumns({c: coerced(c, t) for c, t in types.items() if c in good.columns})


def set_aside(rows: DataFrame, source: str) -> DataFrame:
    """Rows of ``marked`` with rejects: the source, all cells as JSON text, the rejects."""
    cells = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in (REJECTED, LINE)]))
    return rows.where(F.size(REJECTED) > 0).select(F.lit(source).alias("source"), cells.alias("cells"), F.col(REJECTED).alias("rejected"))
