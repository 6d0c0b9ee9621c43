"""Sums over all pairs of many columns in one pass.

Each task adds up small matrices, one row and column for each column of the table, from
Arrow batches by matrix products; the matrices of all tasks are merged by pair. A pair is
counted over the rows in which both values are present.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Groups whose matrices a task holds before it hands them on.
GROUPS_HELD = 256
MOMENTS = ("n", "mx", "my", "cxx", "cyy", "cxy")


class _Sums:
    """Sums of one group in one task, taken from values near it so that no digits are lost."""

    def __init__(self, values: np.ndarray, present: np.ndarray):
        n = present.sum(axis=0)
        self.base = np.divide(np.where(present, values, 0.0).sum(axis=0), n, out=np.zeros(len(n)), where=n > 0)
        self.base = np.where(np.isfinite(self.base), self.base, 0.0)
        self.n = self.x = self.xx = self.xy = np.zeros((len(n), len(n)))

    def add(self, values: np.ndarray, present: np.ndarray) -> None:
        x, m = np.where(present, values - self.base, 0.0), present.astype(float)
        self.n = self.n + m.T @ m
        self.x = self.x + x.T @ m
        self.xx = self.xx + (x * x).T @ m
        self.xy = self.xy + x.T @ x

    def moments(self) -> list[np.ndarray]:
        """Of each pair: rows, means, and sums of squares and products around the means."""
        n = np.where(self.n > 0, self.n, 1.0)
        x, xx = self.x, self.xx
        mean = x / n
        return [self.n, self.base[:, None] + mean, (self.base[:, None] + mean).T, xx - x * mean, (xx - x * mean).T, self.xy - x * mean.T]


def pair_moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, i, j, n, mx, my, cxx, cyy, cxy)`` for column numbers ``i <= j``: rows with
    both values, their means, sums of squares and of products around the means. A NaN makes
    the sums of its column NaN; null is absent."""
    by, k = list(by), len(columns)
    narrow = df.select(*[F.col(f"`{c}`") for c in by], *[F.col(f"`{c}`").cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    schema = T.StructType(
        [*narrow.schema.fields[: len(by)], T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]
        + [T.StructField(m, T.DoubleType()) for m in MOMENTS]
    )
    upper = np.triu_indices(k)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, _Sums] = {}
        names: pa.Schema | None = None

        def out() -> Iterator[pa.RecordBatch]:
            for group, sums in held.items():
                cells = [pa.array([g] * len(upper[0]), names.field(b).type) for b, g in enumerate(group)]
                cells += [pa.array(u.astype(np.int32)) for u in upper] + [pa.array(m[upper]) for m in sums.moments()]
                yield pa.RecordBatch.from_arrays(cells, [f.name for f in schema.fields])
            held.clear()

        for batch in batches:
            names = batch.schema
            arrays = batch.columns[len(by) :]
            present = np.stack([a.is_valid().to_numpy(zero_copy_only=False) for a in arrays], axis=1)
            values = np.stack([a.to_numpy(zero_copy_only=False).astype(float) for a in arrays], axis=1)
            groups: dict[tuple, list[int]] = {}
            if by:
                for at, group in enumerate(zip(*(c.to_pylist() for c in batch.columns[: len(by)]))):
                    groups.setdefault(group, []).append(at)
            for group, rows in groups.items() if by else [((), slice(None))]:
                if group not in held:
                    if len(held) >= GROUPS_HELD:
                        yield from out()
                    held[group] = _Sums(values[rows], present[rows])
                held[group].add(values[rows], present[rows])
        yield from out()

    parts = narrow.mapInArrow(add_up, schema)
    # As many parts of a pair as tasks; around the mean of all no digits are lost.
    merged = parts.groupBy(*[f"`{b}`" for b in by], "i", "j").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.col("n") * F.col(m)).alias(f"s{m[1]}") for m in ("mx", "my")],
        F.collect_list(F.struct(*MOMENTS)).alias("parts"),
    )
    rows = F.nullif(F.col("n"), F.lit(0.0))
    means = merged.withColumns({"mx": F.col("sx") / rows, "my": F.col("sy") / rows})

    def around(c: str, x: str, y: str) -> Column:
        moved = F.transform("parts", lambda p: p[c] + F.when(p["n"] > 0, p["n"] * (p[x] - F.col(x)) * (p[y] - F.col(y))).otherwise(0.0))
        return F.aggregate(moved, F.lit(0.0), lambda total, v: total + v).alias(c)

    return means.select(
        *[f"`{b}`" for b in by], "i", "j", "n", "mx", "my", around("cxx", "mx", "mx"), around("cyy", "my", "my"), around("cxy", "mx", "my")
    )


def matrix(df: DataFrame, columns: Sequence[str], value, name: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, row, column, <name>)``, a symmetric matrix in long form; ``value`` makes a
    cell from the moments of a pair."""
    names = F.array(*[F.lit(c) for c in columns])
    cells = pair_moments(df, columns, by).withColumn(name, value)
    one, two = names[F.col("i")], names[F.col("j")]
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct(one.alias("row"), two.alias("column")))).otherwise(
        F.array(F.struct(one.alias("row"), two.alias("column")), F.struct(two.alias("row"), one.alias("column")))
    )
    return cells.withColumn("_c", F.explode(both)).select(*[f"`{b}`" for b in by], "_c.row", "_c.column", name)
