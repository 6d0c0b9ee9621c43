"""Documents with much the same word n-grams: a join over tries of n-gram sets.

Only n-grams that two documents share can link them, so the others are told apart first
and counted only. The order of n-grams is by how many documents hold them, rare ones
first; two sets that are similar enough share one of the first few, which gathers
documents into clusters. Within a cluster the sets form a trie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.common import keyed_text, release, small_batches, stored, without_ids
from lapsewise.llm.components import Sets, components
from lapsewise.llm.hashing import Substrings, U, mix

# Words in an n-gram, and the least similarity as a fraction.
WORDS = 5
LEAST = (75, 100)
# Text hashed at once, and text whose n-grams go out together.
STEP_BYTES, FLUSH_BYTES = 1 << 20, 6 << 20
# Documents that one trie holds; a larger cluster is joined block by block, each pair of
# blocks that can hold similar sets by itself.
BLOCK = 1000
BITS = 40  # of a hash, besides those that choose its part

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingle_sets(texts: list[str | None], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-grams of each text, sorted, and how many each text has."""
    raw = [(t or "").encode() for t in texts]
    data = FOLD[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    bounds = np.cumsum([len(r) + 1 for r in raw])
    space = SPACE[data]
    inside = np.concatenate([[False], ~space, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, U), np.zeros(len(texts), np.int64)
    words = Substrings(data).hashes(starts, ends)
    of = np.searchsorted(bounds, starts, side="right")
    counts = np.bincount(of, minlength=len(texts))
    first = np.cumsum(counts) - counts
    # An n-gram at each word that has enough after it, or at the first of a short text.
    place = np.arange(len(words)) - first[of]
    begins = (place + size <= counts[of]) | (place == 0)
    at = np.flatnonzero(begins)
    total = np.zeros(len(at), U)
    for j in range(size):
        there = place[at] + j < counts[of[at]]
        total += np.where(there, words[np.minimum(at + j, len(words) - 1)], U(0)) * U(0x9E3779B97F4A7C15 + 2 * j * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    grams, owner = mix(total), of[at]
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.bincount(owner[new], minlength=len(texts))


def _profiles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, STEP_BYTES):
            grams, n = shingle_sets(batch.column(1).to_pylist(), size)
            ends = np.cumsum(n)
            sums = []
            for hashed in (mix(grams), mix(grams ^ U(0xA5A5A5A5A5A5A5A5))):
                total = np.concatenate([np.zeros(1, U), np.cumsum(hashed, dtype=U)])
                sums.append((total[ends] - total[ends - n]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(sums[0]), pa.array(sums[1])], ["id", "n", "h1", "h2"])

    return run


def _deal(size: int, parts: int):
    """For each part of the hash values, the n-grams of many documents."""

    def rows(label: int, ids: np.ndarray, grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        part = (grams % U(parts)).astype(np.int64)
        token = (grams // U(parts)) & U((1 << BITS) - 1)
        owner = np.repeat(np.arange(len(n)), n)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        # One row names the texts of the block, whose places the others give.
        heads = (-1 - (label ^ label >> 33) % parts, label, np.diff(ids, prepend=0).tobytes(), n.astype(np.uint32).tobytes(), b"", b"")
        out = [heads]
        for p in range(parts):
            mine = order[cuts[p] : cuts[p + 1]]
            if len(mine):
                held = np.bincount(owner[mine], minlength=len(n))
                has = held > 0
                t = token[mine]
                out.append(
                    (p, label, np.flatnonzero(has).astype(np.uint32).tobytes(), b"", held[has].astype(np.uint32).tobytes(),
                     (t & U(0xFFFFFFFF)).astype(np.uint32).tobytes() + (t >> U(32)).astype(np.uint8).tobytes())
                )
        types = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
        cols = list(zip(*out)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["part", "label", "ids", "sizes", "held", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, kept, weight = TaskContext.get().partitionId() << 33, [], 0
        for batch in small_batches(batches, STEP_BYTES):
            grams, n = shingle_sets(batch.column(1).to_pylist(), size)
            kept.append((batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), grams, n))
            weight += batch.nbytes
            if weight >= FLUSH_BYTES:
                yield rows(label, *map(np.concatenate, zip(*kept)))
                label, kept, weight = label + 1, [], 0
        if kept:
            yield rows(label, *map(np.concatenate, zip(*kept)))

    return run


DEALT = "part int, label long, ids binary, sizes binary, held binary, tokens binary"
SHARED = "label long, part int, ids binary, sizes binary, held binary, tokens binary, docs binary"


def _tokens(data: bytes) -> np.ndarray:
    n = len(data) // 5
    return np.frombuffer(data, np.uint32, n).astype(U) | np.frombuffer(data, np.uint8, n, 4 * n).astype(U) << U(32)


def _keep_shared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of one part, the n-grams that two documents have, with the number of documents. The
    names of the texts pass as they are."""
    if key[0].as_py() < 0:
        return table.append_column("docs", pa.array([b""] * table.num_rows, pa.binary())).select(["label", "part", "ids", "sizes", "held", "tokens", "docs"])
    columns = {c: table.column(c).to_pylist() for c in ("label", "ids", "sizes", "held", "tokens")}
    tokens = [_tokens(t) for t in columns["tokens"]]
    every = np.concatenate(tokens)
    _, where, counts = np.unique(every, return_inverse=True, return_counts=True)
    docs = counts[where]
    out, at = [], 0
    for i, mine in enumerate(tokens):
        n = docs[at : at + len(mine)]
        at += len(mine)
        keep = n > 1
        held = np.frombuffer(columns["held"][i], np.uint32)
        owner = np.repeat(np.arange(len(held)), held)[keep]
        left = np.bincount(owner, minlength=len(held))
        has = left > 0
        if has.any():
            places = np.frombuffer(columns["ids"][i], np.uint32)
            t = mine[keep]
            out.append(
                (columns["label"][i], key[0].as_py(), places[has].tobytes(), b"", left[has].astype(np.uint32).tobytes(),
                 (t & U(0xFFFFFFFF)).astype(np.uint32).tobytes() + (t >> U(32)).astype(np.uint8).tobytes(), n[keep].astype(np.uint32).tobytes())
            )
    del columns, tokens, every, where, counts, docs
    release()
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
    names = ["label", "part", "ids", "sizes", "held", "tokens", "docs"]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, types)], names=names)


def _gather(least: tuple[int, int]):
    def run(table: pa.Table) -> pa.Table:
        """Documents most of whose n-grams others share, with these by rarity."""
        names = sizes_of = np.zeros(0, np.int64)
        rows, tokens, docs = [], [], []
        for part, i, s, h, t, d in zip(*(table.column(c).to_pylist() for c in ("part", "ids", "sizes", "held", "tokens", "docs"))):
            if part < 0:
                names, sizes_of = np.cumsum(np.frombuffer(i, np.int64)), np.frombuffer(s, np.uint32).astype(np.int64)
                continue
            rows.append(np.repeat(np.frombuffer(i, np.uint32), np.frombuffer(h, np.uint32)))
            tokens.append(_tokens(t) | U(part) << U(BITS))
            docs.append(np.frombuffer(d, np.uint32))
        if not rows:
            return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "tokens": pa.array([], pa.binary())})
        rows, tokens, docs = map(np.concatenate, (rows, tokens, docs))
        order = np.lexsort((tokens, docs, rows))
        rows, tokens = rows[order], tokens[order]
        new = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        ends = np.append(new[1:], len(rows))
        ids, n, f = names[rows[new]], sizes_of[rows[new]], ends - new
        keep = np.flatnonzero(f * least[1] >= n * least[0])
        sets = [tokens[new[k] : ends[k]].astype(np.int64).tobytes() for k in keep]
        return pa.table({"id": pa.array(ids[keep]), "n": pa.array(n[keep]), "tokens": pa.array(sets, pa.binary())})

    return run


def _prefixes(least: tuple[int, int]):
    """The n-grams of a set of which a similar set must share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for key, n, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                tokens = np.frombuffer(data, np.int64)
                length = n - -(-n * least[0] // least[1]) + 1 - (n - len(tokens))
                if length > 0:
                    out.append(tokens[:length])
                    ids.append(np.full(min(length, len(tokens)), key))
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out or none)), pa.array(np.concatenate(ids or none))], ["token", "id"])

    return run


class Trie:
    """Sets of numbers, each sorted, as paths; equal beginnings share nodes. A node holds
    the numbers on the edge to it, its depth, and the sizes of the sets below it."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.children: list[list[int]] = [[]]
        self.depth, self.low, self.high, self.far, self.ends = [0], [0], [0], [0], [[]]
        self.edges: list[np.ndarray] = [np.zeros(0, np.int64)]
        path, before = [0], None
        for i in self.order:
            mine = sets[i]
            if before is None:
                common = 0
            else:
                m = min(len(mine), len(before))
                differ = np.flatnonzero(mine[:m] != before[:m])
                common = int(differ[0]) if len(differ) else m
            while self.depth[path[-1]] > common:
                last = path.pop()
                if self.depth[path[-1]] < common:  # the edge to ``last`` splits
                    top = path[-1]
                    cut = common - self.depth[top]
                    new = self._node(self.edges[last][:cut], common)
                    self.edges[last] = self.edges[last][cut:]
                    self.children[top][-1] = new
                    self.children[new].append(last)
                    path.append(new)
            if len(mine) > common:
                new = self._node(mine[common:], len(mine))
                self.children[path[-1]].append(new)
                path.append(new)
            self.ends[path[-1]].append(i)
            before = mine
        # Sizes below each node; a child is always reached from its parent.
        for node in self._bottom_up():
            mine = [(sizes[i], sizes[i], self.depth[node]) for i in self.ends[node]]
            mine += [(self.low[c], self.high[c], self.far[c]) for c in self.children[node]]
            self.low[node], self.high[node], self.far[node] = min(x[0] for x in mine), max(x[1] for x in mine), max(x[2] for x in mine)
        lengths = np.array([len(e) for e in self.edges])
        # The place after the last edge marks a number that no set has.
        self.flat = np.concatenate([*self.edges, np.full(1, -1)])
        self.starts = np.cumsum(lengths) - lengths
        self.empty = lengths == 0

    def _node(self, edge: np.ndarray, depth: int) -> int:
        self.children.append([])
        self.ends.append([])
        self.edges.append(edge)
        self.depth.append(depth)
        for x in (self.low, self.high, self.far):
            x.append(0)
        return len(self.edges) - 1

    def _bottom_up(self) -> list[int]:
        order, todo = [], [0]
        while todo:
            node = todo.pop()
            order.append(node)
            todo.extend(self.children[node])
        return order[::-1]

    def similar(self, mask: np.ndarray, size: int, held: int, least: tuple[int, int]) -> Iterator[int]:
        """Sets similar to the one that ``mask`` marks: overlaps add up along the paths, and
        a subtree is left where what remains on either side can't suffice."""
        a, b = least
        on_edge = np.add.reduceat(mask[self.flat], self.starts)
        on_edge[self.empty] = 0
        on_edge = on_edge.tolist()
        todo = [(0, 0)]
        while todo:
            node, overlap = todo.pop()
            overlap += on_edge[node]
            most = overlap + min(held - overlap, self.far[node] - self.depth[node])
            if (a + b) * most < a * (size + self.low[node]):
                continue
            for i in self.ends[node]:
                yield i, overlap
            todo.extend((c, overlap) for c in self.children[node])


def joined(ids: list[int], sizes: list[int], tokens: list[np.ndarray], block: list[int], apart: bool, least: tuple[int, int]) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets; with ``apart`` only links between the
    two blocks are looked for."""
    values, local, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(values))
    local = rank[local]
    ends = np.cumsum([len(t) for t in tokens])
    sets = [np.sort(local[e - len(t) : e]) for e, t in zip(ends, tokens)]
    stored_ = [i for i in range(len(ids)) if not apart or block[i] == max(block)]
    asked = [i for i in range(len(ids)) if not apart or block[i] != max(block)]
    if not stored_ or not asked:
        return []
    trie = Trie([sets[i] for i in stored_], [sizes[i] for i in stored_])
    known, links = Sets(), []
    mask = np.zeros(len(values) + 1, np.int64)
    for q in asked:
        mask[sets[q]] = 1
        for s, overlap in trie.similar(mask, sizes[q], len(sets[q]), least):
            i = stored_[s]
            if i != q and least[1] * overlap >= least[0] * (sizes[q] + sizes[i] - overlap) and known.union(ids[q], ids[i]):
                links.append((ids[q], ids[i]))
        mask[sets[q]] = 0
    return links


def _join_clusters(least: tuple[int, int]):
    def run(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in ("cluster", "i", "j", "block", "id", "n", "tokens")}
        groups: dict[tuple, list[int]] = {}
        for r, key in enumerate(zip(columns["cluster"], columns["i"], columns["j"])):
            groups.setdefault(key, []).append(r)
        links: list[tuple[int, int]] = []
        for (_, i, j), rows in groups.items():
            take = lambda c: [columns[c][r] for r in rows]
            if len(rows) > 1:
                sets = [np.frombuffer(t, np.int64) for t in take("tokens")]
                links += joined(take("id"), take("n"), sets, take("block"), i != j, least)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return run


LINKS = "a long, b long"


def _large_clusters(sets: DataFrame, places: DataFrame, member: DataFrame, least: tuple[int, int], block: int) -> DataFrame:
    """Links that connect the similar sets of clusters of ``k`` blocks; every task group
    holds two blocks at most.

    First each block is joined with itself and with the first one, which finds most near
    copies. What is not connected by then can only be similar over a prefix n-gram that
    two of the groups found so far hold, and at sizes that come near enough; the sets that
    have one are joined block by block, without those pairs of blocks where both are of
    the largest group.
    """
    mine = member.withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    others = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array(F.lit(0), F.col("block")))
    pairs = mine.withColumn("other", F.explode(others)).select(
        "id", "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block"
    )
    near = sets.join(pairs, "id").select("cluster", "i", "j", "block", "id", "n", "tokens")
    first = stored(near.groupBy("cluster", "i", "j").applyInArrow(_join_clusters(least), LINKS), "first_links")
    groups = components(first).withColumnRenamed("node", "id")
    groups = member.join(groups, "id", "left").select("id", "cluster", F.coalesce("component", "id").alias("group"))
    groups = stored(groups, "groups")
    held = places.join(groups, "id")
    across = held.groupBy("token").agg(F.min("group").alias("m"), F.max("group").alias("x")).where("m < x").select("token")
    open_ = held.join(across, "token", "left_semi").select("id", "cluster", "group").distinct()
    largest = open_.groupBy("cluster", "group").count().groupBy("cluster").agg(F.max_by("group", F.struct("count", "group")).alias("largest"))
    # Sizes of similar sets are in the same band or in neighbouring ones; the bands are a
    # little wider than that takes.
    width = math.log(1.0001 * least[1] / least[0])
    open_ = sets.select("id", "n").distinct().join(open_.join(largest, "cluster"), "id").select(
        "id", "n", "cluster", F.floor(F.log("n") / width).alias("band"), (F.col("group") == F.col("largest")).cast("int").alias("side")
    )
    kind = ["cluster", "band", "side"]
    counts = open_.groupBy(*kind).agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    named = open_.join(counts, kind).withColumn("name", F.concat_ws(":", *kind, F.pmod(F.xxhash64("id"), F.col("k"))))
    named = stored(named.select("id", "n", "cluster", "band", "side", "name"), "open_sets")
    blocks = named.select(*kind, "name").distinct()
    a, b = (blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in blocks.columns]) for s in "ab")
    meet = a.join(b, (F.col("cluster_a") == F.col("cluster_b")) & (F.col("band_b") - F.col("band_a")).isin(0, 1) & (F.col("side_a") + F.col("side_b") < 2))
    meet = stored(meet.where("band_a < band_b or name_a <= name_b").select("name_a", "name_b"), "block_pairs")
    apart = F.col("name_a") != F.col("name_b")
    sides = meet.select(F.col("name_a").alias("name"), F.lit(0).alias("block"), "name_a", "name_b").union(
        meet.where(apart).select(F.col("name_b").alias("name"), F.lit(1).alias("block"), "name_a", "name_b")
    )
    dealt = sets.join(named.join(sides, "name").select("id", "n", "block", "name_a", "name_b"), ["id", "n"])
    dealt = dealt.select("name_a", "name_b", F.lit(0).alias("cluster"), F.lit(0).alias("i"), apart.cast("int").alias("j"), "block", "id", "n", "tokens")
    return first.union(dealt.groupBy("name_a", "name_b").applyInArrow(_join_clusters(least), LINKS))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, least: tuple[int, int] = LEAST, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``id``, ``n_shingles`` (size of its set of word n-grams) and
    ``component_id`` (least id reachable by links of similarity ``least`` or more).

    Texts with the same set are one class, and only its least id is joined. A text without
    words has an empty set and is alone; one of fewer words than ``size`` has them all as
    one n-gram. Rows with a null key are returned with a null component and link with
    nothing; rows that share a key count as one document where links are followed. Other
    columns are ignored. No pairs are made within a class, and within a cluster only as
    many links as connect it.
    """
    spark = docs.sparkSession
    df = keyed_text(docs, key, text)
    profiles = stored(df.mapInArrow(_profiles(size), "id long, n long, h1 long, h2 long"), "profiles")
    classes = profiles.where("n > 0 and id is not null").groupBy("n", "h1", "h2").agg(F.min("id").alias("first"))
    classes = stored(classes, "classes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.where("id is not null and text is not null").mapInArrow(_deal(size, parts), DEALT)
    shared = dealt.groupBy("part").applyInArrow(_keep_shared, SHARED)
    sets = shared.groupBy("label").applyInArrow(_gather(least), "id long, n long, tokens binary")
    firsts = classes.select(F.col("first").alias("id"), "n")
    sets = stored(sets.join(firsts, ["id", "n"], "left_semi"), "sets")
    places = stored(sets.mapInArrow(_prefixes(least), "token long, id long"), "prefixes")
    least_id = places.groupBy("token").agg(F.min("id").alias("m"), F.max("id").alias("x")).where("m < x").select(F.col("token").alias("t"), "m")
    near = places.join(least_id, F.col("token") == F.col("t")).where("id <> m").select(F.col("id").alias("a"), F.col("m").alias("b")).distinct()
    clusters = stored(components(near), "clusters")
    members = clusters.groupBy("component").agg(F.count("*").alias("members"))
    member = clusters.join(members, "component").select(
        F.col("node").alias("id"), F.col("component").alias("cluster"), F.ceil(F.col("members") / block).cast("int").alias("k")
    )
    member = stored(member, "members")
    groups = max(parts, sets.count() // 2000)
    one = F.lit(0)
    small = sets.join(member.where("k = 1"), "id").select("cluster", one.alias("i"), one.alias("j"), one.alias("block"), "id", "n", "tokens")
    small = small.withColumn("bin", F.pmod(F.xxhash64("cluster"), F.lit(groups)))
    links = small.groupBy("bin").applyInArrow(_join_clusters(least), LINKS)
    if not member.where("k > 1").isEmpty():
        links = links.union(_large_clusters(sets, places, member.where("k > 1"), least, block))
    found = components(links)
    named = classes.join(found, F.col("first") == F.col("node"), "left").select(
        "n", "h1", "h2", F.coalesce("component", "first").alias("component_id")
    )
    return profiles.join(named, ["n", "h1", "h2"], "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")
    )


def firsts(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that come first in their component; rows with a null key and
    repeated rows of a first document are kept."""
    return without_ids(docs, key, near_duplicates(docs, key, text, **options).where("id <> component_id"))
