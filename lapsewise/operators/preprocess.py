"""Scaling, one-hot encoding and the model input vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.config import (
    CATEGORICAL_FEATURES,
    ENGINEERED_CATEGORICAL,
    ENGINEERED_NUMERIC,
    NUMERIC_FEATURES,
)
from lapsewise.functions.features import add_features
from lapsewise.operators.lookup import attach
from lapsewise.operators.ordered import numbered
from lapsewise.sources.scratch import stored


class CustomerFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``add_features`` as a pipeline stage, so that a saved model carries it."""

    @keyword_only
    def __init__(self):
        super().__init__()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return add_features(dataset)


def scale_stats(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: ``mean_<c>`` and population ``std_<c>`` of each column."""
    return train.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.stddev_pop(c).alias(f"std_{c}") for c in columns]
    )


def scale(df: DataFrame, columns: Sequence[str], stats: DataFrame) -> DataFrame:
    """Centre and scale by the statistics of the training rows; a constant column becomes 0."""
    row = stats.first()
    out = {}
    for c in columns:
        mean, std = row[f"mean_{c}"], row[f"std_{c}"]
        out[c] = (F.col(c) - F.lit(mean)) / F.lit(std if std else 1.0)
    return df.withColumns(out)


def one_hot(df: DataFrame, categories: dict[str, Sequence[str]], drop_first: bool = False) -> DataFrame:
    """0/1 columns ``<column>_<value>`` for fitted categories; unknown or null gives zeros."""
    out = {}
    for c, values in categories.items():
        for v in sorted(values)[1 if drop_first else 0 :]:
            out[f"{c}_{v}"] = F.coalesce((F.col(c) == v).cast("int"), F.lit(0))
    return df.withColumns(out)


def category_slots(train: DataFrame, column: str) -> DataFrame:
    """``(value, slot)``: the distinct values of a column in order, numbered from 0. A table
    of any length; nulls have no slot."""
    values = train.select(F.col(f"`{column}`").alias("value")).where("value is not null").distinct()
    return numbered(values, ["value"]).select("value", F.col("_place").alias("slot"))


def one_hot_vectors(df: DataFrame, column: str, slots: DataFrame, out: str) -> DataFrame:
    """A sparse 0/1 vector of the slots instead of a column each, for any number of
    categories; unknown or null gives zeros.

    The slots come by a lookup: sent to every task while they are few, else an ordinary
    join, whose skewed keys Spark splits.
    """
    slots = stored(slots, "slots")
    size = slots.count()
    known = attach(df, slots.select(F.col("value").alias(column), F.col("slot").alias("_slot")), column, "left")
    known = known.withColumn("_slot", F.coalesce("_slot", F.lit(size)).cast("double"))
    # The last category, that of unknown values, is the one the encoder drops.
    ends = df.sparkSession.range(1).select(F.lit(float(size)).alias("_slot"))
    coder = OneHotEncoder(inputCols=["_slot"], outputCols=[out], dropLast=True).fit(ends)
    return coder.transform(known).select(*[f"`{c}`" for c in df.columns], out)


def fitted_categories(train: DataFrame, columns: Sequence[str], limit: int = 1000) -> dict[str, list[str]]:
    """Sorted distinct values of columns that are to become a column each.

    More than ``limit`` values are refused, as they would be as many columns;
    ``one_hot_vectors`` takes any number.
    """
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]
    long = train.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*").where("value IS NOT NULL")
    rows = long.distinct().limit(limit * len(columns) + 1).collect()
    out = {c: sorted(r["value"] for r in rows if r["column"] == c) for c in columns}
    for c, values in out.items():
        if len(values) > limit or len(rows) > limit * len(columns):
            raise ValueError(f"column {c!r} has more than {limit} categories")
    return out


def feature_lists(feature_engineering: bool = True) -> tuple[list[str], list[str]]:
    numeric, text = list(NUMERIC_FEATURES), list(CATEGORICAL_FEATURES)
    if feature_engineering:
        numeric += ENGINEERED_NUMERIC
        text += ENGINEERED_CATEGORICAL
    return numeric, text


def build_preprocessor(feature_engineering: bool = True, scaled: bool = True) -> Pipeline:
    """Features, then scaled numbers and one-hot categories in the vector ``features``.

    Every known category keeps its column and an unknown one is all zeros: the
    encoder's dropped slot is the indexer's slot for unknown values. The scaler
    divides by the sample deviation; trees and regularised paths do not depend on
    the factor sqrt((n-1)/n) that sets it apart from ``scale``.
    """
    numeric, text = feature_lists(feature_engineering)
    stages = [CustomerFeatures()] if feature_engineering else []
    stages.append(VectorAssembler(inputCols=numeric, outputCol="numeric", handleInvalid="keep"))
    if scaled:
        stages.append(StandardScaler(inputCol="numeric", outputCol="scaled", withMean=True, withStd=True))
    indexed = [f"{c}_index" for c in text]
    stages.append(
        StringIndexer(inputCols=text, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc")
    )
    coded = [f"{c}_coded" for c in text]
    stages.append(OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=True))
    stages.append(VectorAssembler(inputCols=["scaled" if scaled else "numeric", *coded], outputCol="features"))
    return Pipeline(stages=stages)


def feature_names(model: PipelineModel, feature_engineering: bool = True) -> list[str]:
    """Names of the vector's slots: numeric columns, then ``column_value``."""
    numeric, text = feature_lists(feature_engineering)
    indexer = next(s for s in model.stages if hasattr(s, "labelsArray"))
    return numeric + [f"{c}_{v}" for c, labels in zip(text, indexer.labelsArray) for v in labels]
