"""Exact order statistics without a single-task window.

A window ordered over the whole table runs in one task. Everything here first
collapses rows to distinct values with counts (combined map-side, so a value
held by a third of all rows costs one row), and then splits long value lists
into blocks that keep the order: block totals are summed over a short table and
added to the running totals inside each block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.sources.scratch import stored

# Distinct values one window task may hold before the list is split into blocks.
VALUES_PER_BLOCK = 1 << 18


def long_columns(
    df: DataFrame, columns: Sequence[str], values_per_block: int | None = None
) -> dict[str, int]:
    """Columns with more distinct values than a block holds, and the blocks they need.
    One narrow aggregate."""
    per_block = values_per_block or VALUES_PER_BLOCK
    sizes = df.agg(*[F.approx_count_distinct(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return {c: sizes[c] // per_block + 1 for c in columns if sizes[c] > per_block}


def value_blocks(
    df: DataFrame, columns: Sequence[str], values_per_block: int | None = None, long: Mapping[str, int] | None = None
) -> tuple[DataFrame, dict[str, Column]]:
    """Give every numeric column a block number that never decreases with its value.

    Columns with few distinct values get block 0. The others are cut at
    approximate quantiles: the cuts only balance the blocks, results stay exact
    wherever they fall. Costs one narrow aggregate, two if a column is long.
    """
    blocks = {c: F.lit(0) for c in columns}
    long = long_columns(df, columns, values_per_block) if long is None else long
    if not long:
        return df, blocks
    cuts = df.agg(
        *[
            F.percentile_approx(F.col(c).cast("double"), [i / n for i in range(1, n)], max(10_000, 4 * n)).alias(c)
            for c, n in long.items()
        ]
    ).first()
    inf = float("inf")
    for c in long:
        source, out = f"_value_{c}", f"_block_{c}"
        splits = [-inf, *sorted(set(cuts[c]) - {-inf, inf}), inf]
        if len(splits) < 3:
            continue
        df = df.withColumn(source, F.col(c).cast("double"))
        df = Bucketizer(splits=splits, inputCol=source, outputCol=out, handleInvalid="keep").transform(df).drop(source)
        blocks[c] = F.col(out).cast("int")
    return df, blocks


def value_points(
    df: DataFrame,
    columns: Sequence[str],
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    values_per_block: int | None = None,
    long: Mapping[str, int] | None = None,
) -> DataFrame:
    """One row per distinct non-null value of each column: ``(*by, column, block, value, *sums)``.

    The columns are melted side by side, so all of them share one shuffle.
    """
    df, blocks = value_blocks(df, columns, values_per_block, long)
    df = df.withColumns({f"_{name}": c for name, c in sums.items()})
    cells = [
        F.struct(F.lit(c).alias("column"), blocks[c].alias("block"), F.col(c).cast("double").alias("value"))
        for c in columns
    ]
    return (
        df.select(*by, *[f"_{name}" for name in sums], F.explode(F.array(*cells)).alias("cell"))
        .where(F.col("cell.value").isNotNull())
        .groupBy(*by, "cell.column", "cell.block", "cell.value")
        .agg(*[F.sum(f"_{name}").alias(name) for name in sums])
    )


def running(
    points: DataFrame,
    by: Sequence[str],
    value: str,
    sums: Sequence[str],
    descending: bool = False,
    block: str | None = "block",
    following: str | None = None,
) -> DataFrame:
    """Add ``cum_<s>`` (up to and with the row) and ``total_<s>`` for each sum.

    ``points`` has one row per ``(*by, value)``. With ``block=None`` a group is one
    window task, for values whose number is known to be small. ``following`` names
    an extra column with the next value in order (null at the end).
    """
    order = F.col(value).desc() if descending else F.col(value).asc()
    if block is None:
        whole = Window.partitionBy(*by)
        line = whole.orderBy(order)
        out = {f"cum_{s}": F.sum(s).over(line.rowsBetween(Window.unboundedPreceding, 0)) for s in sums}
        out |= {f"total_{s}": F.sum(s).over(whole) for s in sums}
        if following:
            out[following] = F.lead(value).over(line)
        return points.withColumns(out)

    edge = F.max(value) if descending else F.min(value)
    block_order = F.col(block).desc() if descending else F.col(block).asc()
    of_group = Window.partitionBy(*by)
    before = of_group.orderBy(block_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        points.groupBy(*by, block)
        .agg(*[F.sum(s).alias(f"_s_{s}") for s in sums], edge.alias("_edge"))
        .withColumns(
            {f"_o_{s}": F.coalesce(F.sum(f"_s_{s}").over(before), F.lit(0)) for s in sums}
            | {f"total_{s}": F.sum(f"_s_{s}").over(of_group) for s in sums}
            | {"_next": F.lead("_edge").over(of_group.orderBy(block_order))}
        )
        .drop("_edge", *[f"_s_{s}" for s in sums])
    )
    line = Window.partitionBy(*by, block).orderBy(order)
    local = {f"_c_{s}": F.sum(s).over(line.rowsBetween(Window.unboundedPreceding, 0)) for s in sums}
    if following:
        local[following] = F.lead(value).over(line)
    out = points.withColumns(local).join(offsets, [*by, block])
    added = {f"cum_{s}": F.col(f"_c_{s}") + F.col(f"_o_{s}") for s in sums}
    if following:
        added[following] = F.coalesce(F.col(following), F.col("_next"))
    return out.withColumns(added).drop("_next", *[f"_{p}_{s}" for s in sums for p in "co"])


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    values_per_block: int | None = None,
    accuracy: int | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation: ``(*by, column, prob, quantile)``.

    ``percentile`` keeps a group's distinct values in one buffer. That is used where
    their number was found small; otherwise the values are ranked in blocks. With an
    ``accuracy`` the quantiles are approximate (rank error 1/accuracy), in one pass.
    """
    long = {} if accuracy else long_columns(df, columns, values_per_block)
    if long:
        points = value_points(df, columns, {"n": F.lit(1)}, by, values_per_block, long)
        return points_quantiles(points, probs, [*by, "column"])
    wanted = F.array(*[F.lit(float(p)) for p in probs])

    def measure(c: Column) -> Column:
        return F.percentile_approx(c, wanted, accuracy) if accuracy else F.percentile(c, wanted)

    row = df.groupBy(*by).agg(*[measure(F.col(c).cast("double")).alias(f"_q{i}") for i, c in enumerate(columns)])
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("prob"), F.col(f"_q{i}")[j].alias("quantile"))
        for i, c in enumerate(columns)
        for j, p in enumerate(probs)
    ]
    out = row.select(*by, F.explode(F.array(*cells)).alias("r")).select(*by, "r.*")
    return out.where(F.col("quantile").isNotNull())


def points_quantiles(points: DataFrame, probs: Sequence[float], by: Sequence[str], count: str = "n") -> DataFrame:
    """Quantiles of a collapsed value list, weighted by ``count``."""
    run = running(points.where(F.col(count) > 0), by, "value", [count])
    last = F.col(f"total_{count}") - 1
    below = F.col(f"cum_{count}") - F.col(count)

    def holds(index: Column) -> Column:
        return (index >= below) & (index < F.col(f"cum_{count}"))

    def at(p: Column) -> Column:
        return last.cast("double") * p

    # Only the values next to a wanted position leave this step.
    hits = F.filter(
        F.array(*[F.lit(float(p)) for p in probs]), lambda p: holds(F.floor(at(p))) | holds(F.ceil(at(p)))
    )
    picked = run.select(*by, "value", f"cum_{count}", count, last.alias("_last"), F.explode(hits).alias("prob"))
    where = F.col("_last").cast("double") * F.col("prob")
    below = F.col(f"cum_{count}") - F.col(count)
    sides = picked.groupBy(*by, "prob").agg(
        F.max(F.when(holds(F.floor(where)), F.col("value"))).alias("lo"),
        F.max(F.when(holds(F.ceil(where)), F.col("value"))).alias("hi"),
        F.max(where - F.floor(where)).alias("t"),
    )
    return sides.select(
        *by, "prob", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("t")).alias("quantile")
    )


def numbered(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Rows with ``_place``, their number from 0 in the given order, written once.

    Tasks take ranges of the whole order, so a value that a third of the rows share is
    split wherever the further columns of the order differ. Spark samples the bounds of the
    ranges; they only balance the work. A place is the rows of all ranges before, and the
    rows before it in its own.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    task, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy(task.alias("_task")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    # One row for each task that wrote.
    before = counts.select("_task", F.coalesce(before, F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), task == F.col("_task")).withColumn("_place", F.col("_before") + at)


def positions(
    df: DataFrame, score: str, key: str, by: Sequence[str] = (), out: str = "position", digits: int | None = None
) -> DataFrame:
    """Exact 1-based position by score descending, ties by key ascending, in each group.

    A tie of any size is spread over ranges of the key. Missing scores (null, NaN) are left
    out. Rows equal in group, score and key stand next to each other in no set order.
    """
    value = F.col(score).cast("double")
    rows = df.withColumn("_s", value if digits is None else F.round(value, digits)).where("_s is not null and not isnan(_s)")
    placed = numbered(rows, [*by, F.desc("_s"), key])
    if not by:
        return placed.select(*df.columns, (F.col("_place") + 1).alias(out))
    first = placed.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.min("_place").alias("_first"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
    return placed.join(first, same).select(*df.columns, (F.col("_place") - F.col("_first") + 1).alias(out))


def score_bin(value: Column) -> Column:
    """A whole number that never decreases with a finite or infinite score: its sign, the
    power of two below it, and in 128 steps where it lies between that and the next."""
    size = F.least(F.abs(value), F.lit(1.7976931348623157e308))
    power = F.floor(F.log2(size))
    steps = F.floor((power + 1076 + (size / F.pow(F.lit(2.0), power) - 1)) * 128)
    return F.when(size > 0, steps * F.signum(value)).otherwise(0).cast("long")
