"""Prefix trie of conversations: which openings many of them share.

A turn becomes a 64-bit hash of its role and text and a number of code points; texts are not
moved. Conversations are cut into segments of ``WIDTH`` turns, so that one very long
conversation is many rows. A segment is filed under the hash of all turns before it, and
equal segments of one file become one row with a count: however often a conversation is
copied, it is one row here.

Distinct rows are dealt into shards by ranges of their turn ids. In a shard the ids are a
padded matrix: ``lexsort`` puts rows in order, column changes accumulated by OR tell where
rows part, hence where nodes start, and ``reduceat`` adds up each depth. Nodes that reach
over the border of a shard are added up by their key afterwards.

Sums over a subtree need no walk over it: with ``k`` turns shared with the row before, a row
brings the nodes below depth ``k``. ``(members - 1) * code points`` of all nodes is
``members * code points`` of all rows less the code points that rows bring.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.llm.common import column, stored

# Turns a segment holds.
WIDTH = 64
# Distinct segments that a shard holds, about.
SHARD_ROWS = 50_000
# Characters of conversation ids that are hashed at once.
ENDS_CHARS = 1 << 18
NO_ENDS = hashlib.sha256(b"").digest()

TURN = "conv long, pos long, tid long, n long"
ROW_SCHEMA = (
    "seg long, p1 long, p2 long, n1 long, n2 long, ids binary, lens array<long>, n long, n_end long, conv long, "
    "ends binary, below_leaves long, below_saved long"
)
SORTED_SCHEMA = ROW_SCHEMA + ", shard int, before int, after int"
NODE_SCHEMA = (
    "depth long, k1 long, k2 long, conv_id long, parent_conv_id long, q1 long, q2 long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary"
)
# Shared turns of rows that have no neighbour there, or one in another shard.
NONE, OPEN = -1, -2


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """``conv, pos, tid, n``: every turn with its place (from 0) in its conversation.

    By turn, nulls first; equal turns by role, then by a hash of role and text. The order
    is made in ranges of (conversation, turn), so a conversation that holds a third of all
    rows lies in many; places are counted in each and moved by the counts before it.
    """
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    role, text = (F.coalesce(column(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(
        column("conv_id").cast("long").alias("conv"),
        column("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.xxhash64(role, text).alias("tid"),
        F.char_length(text).cast("long").alias("n"),
    ).where("conv is not null")
    order = ["turn", "role", "tid"]
    ranged = turns.repartitionByRange(parts, "conv", *order).withColumn("block", F.spark_partition_id())
    ranged = stored(ranged, "turns")
    place = F.row_number().over(Window.partitionBy("block", "conv").orderBy(*order)).cast("long") - 1
    counts = ranged.groupBy("conv", "block").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    # A block continues one conversation at most: no more rows than blocks.
    moved = counts.withColumn("moved", before).where("moved > 0").drop("rows")
    numbered = ranged.withColumn("pos", place).join(F.broadcast(moved), ["conv", "block"], "left")
    numbered = numbered.withColumn("pos", F.col("pos") + F.coalesce("moved", F.lit(0)))
    return stored(numbered.select("conv", "pos", "tid", "n"), "places")


def with_shared_openings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations in which every conversation ``c`` opens with the first ``h``
    turns of conversation ``c - c % 100`` (``%`` as in SQL) instead of its own first ``h``,
    ``h`` being the CRC-32 of ``c`` modulo 6."""
    convs = turns.select("conv").distinct()
    heads = convs.withColumn("base", F.col("conv") - F.col("conv") % 100)
    heads = stored(heads.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % 6), "heads")
    first = turns.where("pos < 5").select(F.col("conv").alias("base"), "pos", "tid", "n")
    opening = heads.join(first, "base").where("pos < h").select("conv", "pos", "tid", "n")
    taken = heads.join(first.groupBy("base").agg(F.count("*").alias("some")), "base", "left")
    taken = taken.select("conv", "h", (F.least("h", F.coalesce("some", F.lit(0))) - F.col("h")).alias("shift"))
    own = turns.join(taken, "conv").where("pos >= h").select("conv", (F.col("pos") + F.col("shift")).alias("pos"), "tid", "n")
    return opening.union(own), convs


def _segments(turns: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """One row for each conversation and segment, with the key of the turns before it
    (``p1``, ``p2``) and of all to its end; a conversation without turns has an empty one."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "tid", "n")))
    cut = turns.groupBy("conv", F.expr(f"pos div {width}").alias("seg")).agg(ordered.alias("turns"))
    hexes = F.array_join(F.transform("turns", lambda t: F.lpad(F.hex(t["tid"]), 16, "0")), "")
    cut = cut.select("conv", "seg", F.unhex(hexes).alias("ids"), F.transform("turns", lambda t: t["n"]).alias("lens"))
    bare = convs.join(cut.select("conv").distinct(), "conv", "left_anti")
    bare = bare.select("conv", F.lit(0).cast("long"), F.lit(b"").alias("ids"), F.expr("cast(array() as array<bigint>)"))
    cut = cut.union(bare)
    own = [F.xxhash64("seg", "ids"), F.xxhash64("ids", "seg", F.lit("second"))]
    ordered = Window.partitionBy("conv").orderBy("seg")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumns({"h1": own[0], "h2": own[1]})
    cut = cut.withColumns({f"n{i}": F.bit_xor(f"h{i}").over(so_far) for i in (1, 2)} | {"last": F.lead("seg").over(ordered).isNull()})
    return cut.select(
        "conv", "seg", "ids", "lens", "last", "n1", "n2", *(F.col(f"n{i}").bitwiseXOR(F.col(f"h{i}")).alias(f"p{i}") for i in (1, 2))
    )


def _ids_in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (n1, n2, conv) as pieces of comma-joined ids, each of one key."""
    names = ["n1", "n2", "first", "piece"]
    for batch in batches:
        a, b, conv = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0)) + 1
        bounds = [0, *cuts.tolist(), len(a)]
        rows = []
        for start, end in zip(bounds, bounds[1:]):
            for at in range(start, end, ENDS_CHARS // 20):
                piece = conv[at : min(end, at + ENDS_CHARS // 20)].tolist()
                rows.append((int(a[start]), int(b[start]), piece[0], ",".join(map(str, piece)).encode()))
        if rows:
            types = [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _pieces_hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each key, which come in order; one piece is held at once."""
    key, state, done = None, None, []

    def out(rows: list) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["n1", "n2", "ends"])

    for batch in batches:
        for a, b, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
            if (a, b) == key:
                state.update(b",")
            else:
                if key is not None:
                    done.append((*key, state.digest()))
                key, state = (a, b), hashlib.sha256()
            state.update(piece.as_py())
        yield out(done)
        done = []
    if key is not None:
        yield out([(*key, state.digest())])


def _ends(segments: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end with a segment, ascending. Ids are
    joined in ranges of (segment, id); only pieces of some thousand ids meet by segment,
    where the digest, which is a sequence by nature, runs over them one by one."""
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ending = segments.where("last").select("n1", "n2", "conv")
    pieces = ending.repartitionByRange(parts, "n1", "n2", "conv").sortWithinPartitions("n1", "n2", "conv")
    pieces = pieces.mapInArrow(_ids_in_pieces, "n1 long, n2 long, first long, piece binary")
    pieces = pieces.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "first")
    return pieces.mapInArrow(_pieces_hashed, "n1 long, n2 long, ends binary")


def _matrix(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Turn ids of some segments as a matrix padded by zeros, and how many each has."""
    sizes = np.array([len(x) // 8 for x in ids], np.int64)
    out = np.zeros((len(ids), max(1, int(sizes.max(initial=0)))), np.uint64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(ids), ">u8")
    return out, sizes


def _shared(files: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many turns each row but the first shares with the one before; NONE in another file."""
    changed = np.logical_or.accumulate(ids[1:] != ids[:-1], axis=1)
    same = np.minimum((~changed).sum(axis=1), np.minimum(sizes[1:], sizes[:-1]))
    return np.where((files[1:] != files[:-1]).any(axis=1), NONE, same)


def _files(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy()) for c in ("seg", "p1", "p2")], axis=1)


def _sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a shard in order, with the turns each shares with its neighbours. A shard
    is a bounded number of distinct rows."""
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    files = _files(table)
    ids, sizes = _matrix(table.column("ids").to_pylist())
    order = np.lexsort((sizes, *ids.T[::-1], *files.T[::-1]))
    files, ids, sizes = files[order], ids[order], sizes[order]
    between = _shared(files, ids, sizes)
    table = table.take(pa.array(order))
    shard = TaskContext.get().partitionId()
    for name, values in (
        ("shard", np.full(len(order), shard)),
        ("before", np.concatenate([[OPEN], between])),
        ("after", np.concatenate([between, [OPEN]])),
    ):
        table = table.append_column(name, pa.array(values, pa.int32()))
    yield from table.combine_chunks().to_batches(max_chunksize=5_000)


def _sorted_rows(rows: DataFrame, shard_rows: int) -> tuple[DataFrame, dict[int, int], dict[int, int]]:
    """Distinct rows in shards, and the turns shared over the borders of each shard. The
    driver sees the first and the last row of each shard."""
    shards = max(1, -(-rows.count() // shard_rows))
    ranged = rows.repartitionByRange(shards, "seg", "p1", "p2", "ids")
    table = stored(ranged.mapInArrow(_sort_shard, SORTED_SCHEMA), "sorted")
    edges: dict[int, dict[str, tuple]] = {}
    for r in table.where(f"before = {OPEN} or after = {OPEN}").select("shard", "before", "after", "seg", "p1", "p2", "ids").toLocalIterator():
        for side in ("before", "after"):
            if r[side] == OPEN:
                edges.setdefault(r["shard"], {})[side] = ((r["seg"], r["p1"], r["p2"]), bytes(r["ids"]))
    before, after = {}, {}
    known = sorted(edges)
    for left, right in zip(known, known[1:]):
        (file_a, a), (file_b, b) = edges[left]["after"], edges[right]["before"]
        ids, sizes = _matrix([a, b])
        after[left] = before[right] = int(_shared(np.array([file_a, file_b]), ids, sizes)[0])
    return table, before, after


class _Rows:
    """A stretch of sorted rows as arrays."""

    def __init__(self, batch: pa.RecordBatch, before: dict[int, int], after: dict[int, int]):
        number = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
        self.files = _files(batch)
        self.binary = batch.column("ids").to_pylist()
        self.ids, self.sizes = _matrix(self.binary)
        self.n, self.n_end, self.conv = number("n"), number("n_end"), number("conv")
        self.below_leaves, self.below_saved = number("below_leaves"), number("below_saved")
        self.n1, self.n2 = number("n1"), number("n2")
        self.ends = batch.column("ends").to_pylist()
        shard = int(batch.column("shard")[0].as_py())
        self.before, self.after = number("before"), number("after")
        self.before[self.before == OPEN] = before.get(shard, NONE)
        self.after[self.after == OPEN] = after.get(shard, NONE)
        # texts[i, d]: code points of turn d (from 1) and all later turns of the segment.
        width = self.ids.shape[1]
        lens = np.zeros((len(self.n), width), np.int64)
        lens[np.arange(width) < self.sizes[:, None]] = np.concatenate([batch.column("lens").flatten().to_numpy(zero_copy_only=False), []]).astype(np.int64)
        self.texts = np.zeros((len(self.n), width + 2), np.int64)
        self.texts[:, 1 : width + 1] = np.cumsum(lens[:, ::-1], axis=1)[:, ::-1]
        self.texts[:, 0] = self.texts[:, 1]
        self.leaf = (self.n == self.n_end) & (self.after < self.sizes)

    def saved(self, depth: int) -> np.ndarray:
        """What each row adds to the saved code points of its node at a depth."""
        brought = np.maximum(self.before + 1, depth)
        return self.n * self.texts[:, depth] - self.texts[np.arange(len(self.n)), brought] + self.below_saved


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in which all rows are of one shard."""
    for batch in batches:
        shard = batch.column("shard").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def _own_sums(before: dict[int, int], after: dict[int, int]):
    """What each row brings to the nodes above its segment."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _stretches(batches):
            rows = _Rows(batch, before, after)
            columns = [rows.conv, rows.files[:, 0], rows.leaf.astype(np.int64), rows.saved(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["conv", "seg", "leaves", "saved"])

    return sums


def _key(rows: _Rows, i: int, depth: int, width: int) -> tuple[int, int]:
    """Name of the node at a depth of the segment on the path of a row."""
    if depth == 0:
        return int(rows.files[i, 1]), int(rows.files[i, 2])
    if depth == width:
        return int(rows.n1[i]), int(rows.n2[i])
    name = hashlib.blake2b(rows.binary[i][: 8 * depth] + repr(rows.files[i].tolist()).encode(), digest_size=16).digest()
    return int.from_bytes(name[:8], "little", signed=True), int.from_bytes(name[8:], "little", signed=True)


def _nodes(before: dict[int, int], after: dict[int, int], width: int):
    """Nodes of each stretch of rows. Those with a key (``k1``, ``k2``) are parts of nodes;
    those whose parent is such a part name its key (``q1``, ``q2``)."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _stretches(batches):
            rows = _Rows(batch, before, after)
            out: list[list] = [[] for _ in NODE_SCHEMA.split(",")]
            # Where a row parts from the one before; the first one starts all its nodes here.
            parted = rows.before.copy()
            parted[0] = NONE
            above: tuple | None = None
            for depth in range(int(rows.sizes.max()) + 1):
                alive = np.flatnonzero(rows.sizes >= depth)
                first = np.flatnonzero(parted[alive] < depth)
                starts = alive[first]
                ends = np.append(starts[1:], len(rows.n))
                add = lambda v: np.add.reduceat(v[alive], first)
                conv = np.minimum.reduceat(rows.conv[alive], first)
                n_convs, leaves, saved = add(rows.n), add(rows.leaf + rows.below_leaves), add(rows.saved(depth))
                children = add((rows.before <= depth) & (rows.sizes > depth))
                whole = np.ones(len(starts), bool)
                if depth == 0:
                    whole[:] = False
                    deeper = rows.files[starts, 0] > 0
                    # The members of a file are counted in the segment before.
                    n_convs[deeper] = leaves[deeper] = saved[deeper] = 0
                elif depth == width:
                    whole &= rows.n[starts] == rows.n_end[starts]
                whole[0] &= rows.before[0] < depth
                if ends[-1] == len(rows.n) and rows.sizes[-1] >= depth:
                    whole[-1] &= rows.after[-1] < depth
                keys = [(None, None) if w else _key(rows, i, depth, width) for i, w in zip(starts.tolist(), whole.tolist())]
                if depth == 0:
                    parents = [(None, None, None)] * len(starts)
                    conv = [None if d else c for c, d in zip(conv.tolist(), deeper.tolist())]
                else:
                    at = np.searchsorted(above[0], starts, "right") - 1
                    parents = [(None if above[2][p][0] is not None else above[1][p], *above[2][p]) for p in at.tolist()]
                    conv = conv.tolist()
                above = (starts, conv, keys)
                ended = [rows.ends[i] if rows.sizes[i] == depth and (depth or not rows.files[i, 0]) else None for i in starts.tolist()]
                values = [(width * rows.files[starts, 0] + depth).tolist(), *zip(*keys), conv, *zip(*parents)]
                values += [n_convs.tolist(), children.tolist(), leaves.tolist(), saved.tolist(), ended]
                for held, more in zip(out, values):
                    held.extend(more)
            types = [pa.int64()] * 11 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [f.split()[0] for f in NODE_SCHEMA.split(",")])

    return nodes


def prefix_trie(turns: DataFrame, convs: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node: ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``
    (null for the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256``.

    ``turns`` holds ``conv, pos, tid, n`` with places from 0 without gaps, ``convs`` every
    conversation, also one without turns. Without conversations there is no node. Memory
    follows the rows of a shard; a very long conversation is spread by its segments, a very
    frequent one is one row. Each conversation is only seen whole by a running total over
    its segments. Equal 64-bit hashes of different turns after the same opening would be
    taken for one turn.
    """
    segments = stored(_segments(turns, convs, width), "segments")
    key = ["seg", "p1", "p2", "n1", "n2", "ids"]
    rows = segments.groupBy(*key).agg(
        F.any_value("lens").alias("lens"),
        F.count("*").alias("n"),
        F.count_if("last").alias("n_end"),
        F.min("conv").alias("conv"),
    )
    rows = stored(rows.join(_ends(segments), ["n1", "n2"], "left"), "rows")
    bare = [F.lit(0).cast("long").alias(c) for c in ("below_leaves", "below_saved")]
    names = [f.split()[0] for f in ROW_SCHEMA.split(", ")]

    # What later segments bring is handed to the conversation that stands for them.
    deep, before, after = _sorted_rows(rows.where("seg > 0").select("*", *bare).select(*names), shard_rows)
    brought = deep.mapInArrow(_own_sums(before, after), "conv long, seg long, leaves long, saved long")
    long = segments.join(segments.where("seg = 1").select("conv"), "conv", "left_semi").select("conv", "seg", "n1", "n2")
    later = Window.partitionBy("conv").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    below = long.join(brought, ["conv", "seg"], "left").select(
        "n1", "n2", F.sum("leaves").over(later).alias("leaves"), F.sum("saved").over(later).alias("saved")
    )
    below = below.groupBy("n1", "n2").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"below_{c}") for c in ("leaves", "saved")))
    rows = rows.join(below, ["n1", "n2"], "left").fillna(0, ["below_leaves", "below_saved"]).select(*names)

    table, before, after = _sorted_rows(rows, shard_rows)
    nodes = stored(table.mapInArrow(_nodes(before, after, width), NODE_SCHEMA), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    same = [F.max(c).alias(c) for c in ("parent_conv_id", "q1", "q2", "ends")]
    parts = nodes.where("k1 is not null").groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), *same, *sums)
    parts = stored(parts, "parts")
    whole = nodes.where("k1 is null").unionByName(parts)
    parent = parts.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("of_part"))
    # The parent of all first turns is the root, whose member is known without a join.
    root = parts.where("depth = 0").select("conv_id").first()
    first = whole.where("depth = 1").withColumn("of_part", F.lit(root[0] if root else None).cast("long"))
    found = first.unionByName(whole.where("depth <> 1").join(parent, ["depth", "q1", "q2"], "left"))
    return found.select(
        "conv_id",
        "depth",
        F.coalesce("parent_conv_id", "of_part").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.lower(F.hex(F.coalesce("ends", F.lit(NO_ENDS)))).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, **sizes: int) -> DataFrame:
    """The trie of all conversations of a table ``conv_id, turn, role, text`` as they are.
    Rows without ``conv_id`` are left out; a null role or text counts as empty; repeated
    rows are turns of their own; further columns are ignored."""
    turns = turns_in_order(conversations)
    return prefix_trie(turns, turns.select("conv").distinct(), **sizes)


def rebuilt_trie(conversations: DataFrame, **sizes: int) -> DataFrame:
    """The trie after ``with_shared_openings``."""
    turns, convs = with_shared_openings(turns_in_order(conversations))
    return prefix_trie(turns, convs, **sizes)
