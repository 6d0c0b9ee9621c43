"""Deterministic stratified train/validation/test split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.config import DEFAULTS, KEY, LABEL
from lapsewise.operators.lookup import attach
from lapsewise.operators.ordered import running
from lapsewise.sources.scratch import stored



def draw(key: str, seed: int) -> Column:
    """Repeatable uniform draw of a row: a hash of key and seed."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


def split_cuts(
    df: DataFrame,
    label: str = LABEL,
    key: str = KEY,
    test: float = DEFAULTS.test_size,
    val: float = DEFAULTS.val_size,
    seed: int = DEFAULTS.seed,
) -> DataFrame:
    """``(label, test_cut, val_cut)``: the hashes at which test and validation end.

    Counting 65,536 even blocks of the hash finds the two blocks the cuts fall in;
    only the rows of those blocks are ordered.
    """
    hashed = df.select(label, draw(key, seed).alias("h")).withColumn("b", F.substring("h", 1, 4))
    blocks = running(hashed.groupBy(label, "b").agg(F.count("*").alias("n")), [label], "b", ["n"], block=None)
    n = F.col("total_n")
    n_test = F.ceil(n * F.lit(test)).cast("long")
    n_val = F.ceil((n - n_test) * F.lit(val)).cast("long")
    marks = F.array(
        F.struct(F.lit("test").alias("part"), n_test.alias("at")),
        F.struct(F.lit("val").alias("part"), (n_test + n_val).alias("at")),
    )
    placed = blocks.select(label, "b", (F.col("cum_n") - F.col("n")).alias("before"), "cum_n", F.explode(marks).alias("m"))
    edge = placed.where((F.col("m.at") > F.col("before")) & (F.col("m.at") <= F.col("cum_n")))
    edge = edge.select(label, "b", "m.part", (F.col("m.at") - F.col("before")).alias("nth"))
    ordered = hashed.join(edge, [label, "b"]).withColumn(
        "rn", F.row_number().over(Window.partitionBy(label, "part", "b").orderBy("h"))
    )
    at = ordered.where(F.col("rn") == F.col("nth"))
    return at.groupBy(label).agg(
        F.max(F.when(F.col("part") == "test", F.col("h"))).alias("test_cut"),
        F.max(F.when(F.col("part") == "val", F.col("h"))).alias("val_cut"),
    )


def stratified_split(
    df: DataFrame,
    label: str = LABEL,
    key: str = KEY,
    test: float = DEFAULTS.test_size,
    val: float = DEFAULTS.val_size,
    seed: int = DEFAULTS.seed,
) -> DataFrame:
    """Add ``split``: per label class, exactly ``ceil(test * n)`` rows of test, then
    ``ceil(val * rest)`` of validation, the rest train. Keys are unique; rows
    without a label are left out.

    Rows are compared with the two hashes of their class, which a lookup brings: while the
    classes are few enough to be sent to every task, nothing is shuffled.
    """
    cuts = split_cuts(df, label, key, test, val, seed).select(
        label, F.coalesce("test_cut", F.lit("")).alias("_test"), F.coalesce("val_cut", "test_cut", F.lit("")).alias("_val")
    )
    rows = attach(df.where(F.col(label).isNotNull()), stored(cuts, "cuts"), label)
    h = draw(key, seed)
    part = F.when(h <= F.col("_test"), "test").when(h <= F.col("_val"), "val").otherwise("train")
    return rows.select(*[f"`{c}`" for c in df.columns], part.alias("split"))


def class_weights(df: DataFrame, label: str = LABEL, out: str = "weight") -> DataFrame:
    """Add balanced weights: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n") / F.count("*")).scalar()
    weights = counts.select(label, (total / F.col("_n")).alias(out))
    return attach(df, weights, label).select(*df.columns, out)


def positive_weight(df: DataFrame, label: str = LABEL) -> DataFrame:
    """One row: negatives per positive."""
    ones, zeros = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(F.when(ones > 0, zeros / ones).alias("scale_pos_weight"))
