"""Reading customer tables: files, SQL text, catalog tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The raw customer file, as it arrives (18 columns, two headers with a blank).
RAW_CUSTOMER_SCHEMA = T.StructType(
    [
        T.StructField("RowNumber", T.LongType()),
        T.StructField("CustomerId", T.LongType()),
        T.StructField("Surname", T.StringType()),
        T.StructField("CreditScore", T.IntegerType()),
        T.StructField("Geography", T.StringType()),
        T.StructField("Gender", T.StringType()),
        T.StructField("Age", T.IntegerType()),
        T.StructField("Tenure", T.IntegerType()),
        T.StructField("Balance", T.DoubleType()),
        T.StructField("NumOfProducts", T.IntegerType()),
        T.StructField("HasCrCard", T.IntegerType()),
        T.StructField("IsActiveMember", T.IntegerType()),
        T.StructField("EstimatedSalary", T.DoubleType()),
        T.StructField("Exited", T.IntegerType()),
        T.StructField("Complain", T.IntegerType()),
        T.StructField("Satisfaction Score", T.IntegerType()),
        T.StructField("Card Type", T.StringType()),
        T.StructField("Point Earned", T.IntegerType()),
    ]
)

_NAME = re.compile(r"[A-Za-z_]\w*")
# Quotes as other programs write them: doubled, without escapes.
CSV_FORMAT = {"header": True, "quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, **options) -> DataFrame:
    """CSV with a header, a quote inside quotes doubled. Without a schema the types are
    inferred in an extra pass."""
    reader = spark.read.options(**CSV_FORMAT).options(**options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


def read_query(spark: SparkSession, query: str, params: Mapping | None = None, jdbc: Mapping | None = None) -> DataFrame:
    """Rows of a SQL query: Spark's own catalog, or a database given ``jdbc`` options.

    Named parameters (``:name``) are bound by Spark; a database query takes none.
    """
    if jdbc is None:
        return spark.sql(query, args=dict(params) if params else None)
    if params:
        raise ValueError("parameters are supported for Spark SQL only")
    return spark.read.format("jdbc").options(**jdbc).option("query", query).load()


def source_kind(source: str) -> str:
    for kind in ("parquet", "csv", "sql"):
        if source.rstrip("/").lower().endswith("." + kind):
            return kind
    raise ValueError(f"cannot tell the format of {source!r}: expected .parquet, .csv or .sql")


def load(
    spark: SparkSession,
    source: str,
    kind: str | None = None,
    schema: T.StructType | None = None,
    columns: Sequence[str] | None = None,
    params: Mapping | None = None,
) -> DataFrame:
    """Read by suffix or explicit kind. A ``.sql`` path holds the query's text."""
    by_suffix = kind is None
    kind = kind or source_kind(source)
    if kind == "parquet":
        df = read_parquet(spark, source)
    elif kind == "csv":
        df = read_csv(spark, source, schema)
    elif kind == "sql":
        text = spark.read.text(source, wholetext=True).first()[0] if by_suffix else source
        df = read_query(spark, text, params)
    else:
        raise ValueError(f"unsupported source kind {kind!r}: expected parquet, csv or sql")
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


def query_files(spark: SparkSession, sql: str, files: Mapping[str, str]) -> DataFrame:
    """Run SQL with each named Parquet or CSV path (globs allowed) as a view."""
    for name, path in files.items():
        if not _NAME.fullmatch(name):
            raise ValueError(f"{name!r} is not a valid view name")
        if source_kind(path) == "sql":
            raise ValueError(f"{path!r} must be a .parquet or .csv path")
    for name, path in files.items():
        load(spark, path).createOrReplaceTempView(name)
    return spark.sql(sql)


def table_exists(spark: SparkSession, name: str) -> bool:
    """Whether the catalog knows the table; any lookup error counts as no."""
    try:
        return spark.catalog.tableExists(name)
    except Exception:
        return False
