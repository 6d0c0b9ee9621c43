"""Near-duplicate vectors: a join along the epsilon grid order.

Vectors are sorted by grid cells on the leading principal dimensions and cut into blocks.
Two vectors within the threshold differ by at most one cell in each dimension, so most
pairs of blocks are provably too far apart; the others are joined by splitting both
intervals again and again, leaving parts whose boxes are too far from each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapsewise.llm.common import column, stored
from lapsewise.llm.components import Sets, components

LEAST_COSINE = 0.93
# Leading dimensions of the grid, vectors of a block, and vectors compared at once.
DIMENSIONS = 4
BLOCK = 2048
LEAF = 128
# Lengths that have principal directions of their own, the commonest ones; the grid of the
# others is on their first dimensions.
LENGTHS = 16
# Distances are compared with this much to spare, so that rounding loses no pair.
SLACK = 1e-6

BLOCKS = "block long, label long, length int, size int, low array<double>, high array<double>, ids binary, counts binary, vectors binary"


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def matrix(column_: pa.Array) -> np.ndarray:
    """A batch of equally long arrays as rows of doubles."""
    return column_.flatten().to_numpy(zero_copy_only=False).reshape(len(column_), -1)


def principal(vectors: DataFrame, size: int, dimensions: int) -> np.ndarray:
    """Orthonormal directions of most variance, from sums over all vectors; as many numbers
    as the square of the dimension reach the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            if batch.num_rows:
                x = np.hstack([unit(matrix(batch.column(0))), np.ones((batch.num_rows, 1))])
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])

    sums = vectors.select("embedding").mapInArrow(moments, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((size + 1) ** 2)
    total[sums["i"].to_numpy()] = sums["v"].to_numpy()
    total = total.reshape(size + 1, size + 1)
    n = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / n
    _, directions = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    return directions[:, ::-1][:, :dimensions]


def directions_of(directions: dict[int, np.ndarray], length: int) -> np.ndarray:
    """The directions of vectors of a length; the first axes, where it has none of its own."""
    found = directions.get(length)
    return np.eye(length, min(DIMENSIONS, length)) if found is None else found


def _cut_blocks(directions: dict[int, np.ndarray], block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            ids, counts, labels, lengths = (batch.column(i).to_numpy() for i in range(4))
            new = (np.diff(labels, prepend=labels[:1] - 1) != 0) | (np.diff(lengths, prepend=lengths[:1]) != 0)
            cuts = np.flatnonzero(new)
            rows = []
            for a, b in zip(cuts, np.append(cuts[1:], len(labels))):
                for low in range(a, b, block):
                    s = slice(low, min(low + block, b))
                    x = matrix(batch.column(4)[s.start : s.stop])
                    at = unit(x) @ directions_of(directions, x.shape[1])
                    rows.append(
                        (number, int(labels[low]), x.shape[1], len(x), at.min(0).tolist(), at.max(0).tolist(), ids[s].astype(np.int64).tobytes(),
                         counts[s].astype(np.int64).tobytes(), x.tobytes())
                    )
                    number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 9, types)], [f.split()[0] for f in BLOCKS.split(", ")])

    return run


def interval_join(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, reach: float, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with a cosine of at least ``least``; with ``same`` each pair once.

    Both sequences are halved until they are short; halves whose boxes on the grid's
    dimensions are more than ``reach`` apart are left out.
    """
    todo = [(0, len(x), 0, len(y))]
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d or (same and d <= a):
            continue
        gap = np.maximum(0, np.maximum(py[c:d].min(0) - px[a:b].max(0), px[a:b].min(0) - py[c:d].max(0)))
        if gap @ gap > reach * reach:
            continue
        if b - a > LEAF or d - c > LEAF:
            m = (a + b) // 2 if b - a > LEAF else b
            k = (c + d) // 2 if d - c > LEAF else d
            todo += [(a, m, c, k), (m, b, c, k), (a, m, k, d), (m, b, k, d)]
            continue
        cosine = (x[a:b] @ y[c:d].T) / np.outer(nx[a:b], ny[c:d])
        i, j = np.nonzero(cosine >= least)
        i, j = i + a, j + c
        if same:
            i, j = i[i < j], j[i < j]
        yield i, j


def _join(directions: dict[int, np.ndarray], least: float):
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + SLACK

    def run(table: pa.Table) -> pa.Table:
        nodes: list[np.ndarray] = []
        links: list[np.ndarray] = []
        pairs: list[tuple[int, int]] = []
        for row in table.to_pylist():
            sides = []
            for side in "ab":
                ids = np.frombuffer(row[f"ids_{side}"], np.int64)
                v = np.frombuffer(row[f"vectors_{side}"], np.float64).reshape(len(ids), -1)
                sides.append((ids, np.frombuffer(row[f"counts_{side}"], np.int64), v, unit(v) @ directions_of(directions, v.shape[1])))
            (ia, ca, x, px), (ib, cb, y, py) = sides
            same = row["block_a"] == row["block_b"]
            of_a, of_b, known = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64), Sets()
            for i, j in interval_join(x, y, px, py, reach, least, same):
                np.add.at(of_a, i, cb[j])
                np.add.at(of_b, j, ca[i])
                for p, q in zip(ia[i].tolist(), ib[j].tolist()):
                    if known.union(p, q):
                        pairs.append((p, q))
            nodes += [ia[of_a > 0], ib[of_b > 0]]
            links += [of_a[of_a > 0], of_b[of_b > 0]]
        nodes, links = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (nodes, links))
        first = np.concatenate([nodes, np.array([p for p, _ in pairs], np.int64)])
        second = pa.array([None] * len(nodes) + [q for _, q in pairs], pa.int64())
        return pa.table({"a": first, "b": second, "n": np.concatenate([links, np.zeros(len(pairs), np.int64)])})

    return run


def near_vectors(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST_COSINE, dimensions: int = DIMENSIONS, block: int = BLOCK
) -> DataFrame:
    """One row per vector: ``id, n_links, component_id``.

    Vectors with the same label and length link at a cosine of ``least`` or more, in double
    precision; labels are compared in their own type. One that is null, empty, zero, or has a null or non-finite part links with
    nothing, and so does one without a label or a key. Vectors of unequal lengths never
    link (a cosine needs equal lengths). Equal vectors are one class
    that is compared once and counted as often as it occurs; links within a block pair are
    summed up there, and only a spanning forest of them goes on. A vector without links is
    its own component; a null key has none. Other columns are ignored.
    """
    # Whole numbers stand for themselves, labels of other types by a hash.
    whole = column(label).cast("long") if isinstance(rows.select(column(label)).schema[0].dataType, T.IntegralType) else F.when(column(label).isNotNull(), F.xxhash64(column(label)))
    df = rows.select(column(key).cast("long").alias("id"), column(vector).cast("array<double>").alias("embedding"), whole.alias("label"))
    finite = F.forall("embedding", lambda x: F.coalesce((F.abs(x) < F.lit(math.inf)) & ~F.isnan(x), F.lit(False)))
    some = F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & some, F.lit(False))
    # By a power of two, which loses no digits, the largest part is brought near 1, so that
    # squares neither vanish nor overflow.
    # (Structs in arrays of one, so that the power is made once a vector and not once a part.)
    power = F.floor(F.log2(F.array_max(F.transform("embedding", lambda x: F.abs(x)))))
    known = F.array(F.struct(F.col("embedding").alias("v"), power.alias("k")))
    two = F.lit(2.0)
    factors = F.transform(known, lambda s: F.struct(s["v"].alias("v"), F.pow(two, -F.floor(s["k"] / 2)).alias("a"), F.pow(two, F.floor(s["k"] / 2) - s["k"]).alias("b")))
    near_one = F.transform(factors, lambda s: F.transform(s["v"], lambda x: x * s["a"] * s["b"]))[0]
    df = df.withColumn("usable", usable).withColumn("embedding", F.when(F.col("usable"), near_one)).withColumns(
        {f"h{i}": F.when(F.col("usable"), F.xxhash64(F.lit(i), "label", "embedding")) for i in (1, 2)}
    )
    good = df.where("usable")
    classes = good.groupBy("h1", "h2").agg(
        F.min("id").alias("id"), F.count("*").alias("n"), F.min("label").alias("label"), F.first("embedding").alias("embedding")
    )
    classes = stored(classes.withColumn("length", F.size("embedding")), "classes")
    # One block needs no directions: it is joined with itself alone.
    common = classes.groupBy("length").count().where(F.col("count") > block).orderBy(F.desc("count"), "length").limit(LENGTHS).collect()
    directions = {r.length: principal(classes.where(F.col("length") == r.length), r.length, min(dimensions, r.length)) for r in common}
    width = math.sqrt(max(0.0, 2 - 2 * least)) or 1.0
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    cells = []
    for i in range(dimensions):
        place = F.coalesce(F.get("embedding", F.lit(i)), F.lit(0.0))
        for length, of_length in directions.items():
            if i < length:
                d = F.lit(of_length[:, i].tolist())
                along = F.aggregate(F.zip_with("embedding", d, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
                place = F.when(F.col("length") == length, along).otherwise(place)
        cells.append(F.floor(place / norm / width).alias(f"c{i}"))
    placed = stored(classes.select("id", "n", "label", "length", "embedding", *cells), "cells")
    order = ["label", "length", *[f"c{i}" for i in range(len(cells))], "id"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "n", "label", "length", "embedding")
    blocks = stored(sorted_.mapInArrow(_cut_blocks(directions, block), BLOCKS), "blocks")
    # Pairs of blocks of one label whose boxes come near enough.
    meta = blocks.select("block", "label", "length", "low", "high")
    left, right = (meta.select(*[F.col(c).alias(f"{c}_{s}") for c in meta.columns]) for s in "ab")
    gap = F.aggregate(
        F.transform(
            F.arrays_zip("low_a", "high_a", "low_b", "high_b"),
            lambda z: F.pow(F.greatest(z["low_b"] - z["high_a"], z["low_a"] - z["high_b"], F.lit(0.0)), F.lit(2)),
        ),
        F.lit(0.0), lambda a, x: a + x,
    )
    alike = (F.col("label_a") == F.col("label_b")) & (F.col("length_a") == F.col("length_b"))
    near = left.join(right, alike & (F.col("block_a") <= F.col("block_b")))
    near = near.where(gap <= (width + SLACK) ** 2).select("block_a", "block_b")
    held = blocks.select("block", "ids", "counts", "vectors")
    for s in "ab":
        near = near.join(held.select(*[F.col(c).alias(f"{c}_{s}") for c in held.columns]), f"block_{s}")
    found = stored(near.groupBy("block_a", "block_b").applyInArrow(_join(directions, least), "a long, b long, n long"), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("node_")).agg(F.sum("n").alias("links"))
    parents = components(found.where("b is not null").select("a", "b"))
    named = classes.select("h1", "h2", "id", "n").join(links, F.col("id") == F.col("node_"), "left").join(parents, F.col("id") == F.col("node"), "left")
    named = named.select(
        F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    joined = df.join(named, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    return joined.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
