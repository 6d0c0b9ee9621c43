"""Byte-level BPE over a corpus: each distinct pre-token is encoded once.

Texts are cut into pre-tokens. A block of texts keeps, for every position, the number of
the pre-token there, and deals its distinct pre-tokens by their hash into parts. A part of
all blocks meets in one place, where each distinct pre-token is encoded once; the ids go
back to their blocks and are put in place by position.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lapsewise.llm.common import keyed_text, release, small_batches
from lapsewise.sources.scratch import scratch_dir

PART_SCHEMA = "block long, part int, ids array<long>, counts binary, data binary, parts binary"
OUT_SCHEMA = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
# Text that one block holds, unless a single text is longer.
BLOCK_BYTES = 24 << 20
# Distinct pre-tokens whose ids one task remembers at once; beyond it starts to remember anew.
KNOWN_WORDS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ids of a public rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def pack(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


unpack = zstandard.decompress


def pack_numbers(x: np.ndarray) -> bytes:
    """Unsigned numbers below 2**23, in one to three bytes each: the first bytes of all,
    then the further bytes of those that need them."""
    middle, large = (x >= 192) & (x < 14528), x >= 14528
    first = np.where(large, 248 + ((x - 14528) >> 16), np.where(middle, 192 + ((x - 192) >> 8), x)).astype(np.uint8)
    second = np.where(large, (x - 14528) >> 8, x - 192)[middle | large].astype(np.uint8)
    third = (x[large] - 14528).astype(np.uint8)
    if large.any() and int(x.max()) - 14528 >= 8 << 16:
        return b"w" + pack(x.astype(np.uint32).tobytes())
    parts = [pack(a.tobytes()) for a in (first, second, third)]
    return b"n" + b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def unpack_numbers(data: bytes) -> np.ndarray:
    if data[:1] == b"w":
        return np.frombuffer(unpack(data[1:]), np.uint32)
    parts, at = [], 1
    for _ in range(3):
        size = int.from_bytes(data[at : at + 4], "little")
        parts.append(np.frombuffer(unpack(data[at + 4 : at + 4 + size]), np.uint8).astype(np.uint32))
        at += 4 + size
    out, more, last = parts[0].copy(), parts[1], parts[2]
    longer = parts[0] >= 192
    large = parts[0] >= 248
    high = parts[0][longer]
    both = np.where(high >= 248, 0, 192 + ((high - 192) << 8) + more)
    both[high >= 248] = 14528 + ((high[high >= 248] - 248) << 16) + (more[high >= 248] << 8) + last
    out[longer] = both
    assert last.size == int(large.sum())
    return out


def pack_lists(parts: list) -> bytes:
    """Lists of numbers: all lengths, then all numbers."""
    sizes = np.fromiter(map(len, parts), np.uint32, len(parts))
    flat = np.fromiter((x for p in parts for x in p), np.uint32, int(sizes.sum()))
    return pack_numbers(np.concatenate([np.array([len(parts)], np.uint32), sizes, flat]))


def unpack_lists(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    every = unpack_numbers(data)
    return every[1 : 1 + every[0]], every[1 + every[0] :]


def text_blocks(docs: DataFrame, pattern: str, parts: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of texts: in part -1 the keys, the pre-tokens of each text and the places;
    in the others the distinct pre-tokens that fall there, in the order of their numbers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        block = TaskContext.get().partitionId() << 33
        for batch in small_batches(batches, BLOCK_BYTES):
            numbers: dict[str, int] = {}
            places, counts = [], []
            for body in batch.column(1):
                found = split.findall(body.as_py() or "")
                places.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.uint32, len(found)))
                counts.append(len(found))
                del found
            # Frequent pre-tokens get small numbers; a part keeps that order.
            every = np.concatenate(places)
            del places
            order = np.argsort(-np.bincount(every, minlength=len(numbers)), kind="stable")
            rank = np.empty(len(numbers), np.uint32)
            rank[order] = np.arange(len(numbers), dtype=np.uint32)
            every = pack_numbers(rank[every])
            words = [w.encode() for w in numbers]
            del numbers, rank
            of = np.fromiter((zlib.crc32(w) % parts for w in words), np.uint32, len(words))[order]
            rows = [(block, -1, batch.column(0).to_pylist(), np.array(counts, np.int64).tobytes(), every, pack_numbers(of))]
            by_part = order[np.argsort(of, kind="stable")]
            ends = np.cumsum(np.bincount(of, minlength=parts))
            for i, (start, end) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
                if end > start:
                    rows.append((block, i, None, None, pack_words([words[at] for at in by_part[start:end].tolist()]), None))
            del words, order, by_part
            types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            names = ["block", "part", "ids", "counts", "data", "parts"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
            block += 1

    return keyed_text(docs, key, text).mapInArrow(cut, PART_SCHEMA)


def pack_words(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), np.uint32, len(words)).tobytes()
    return pack(len(words).to_bytes(4, "little") + sizes + b"".join(words))


def words_of(data: bytes) -> Iterator[bytes]:
    data = unpack(data)
    n = int.from_bytes(data[:4], "little")
    at = 4 + 4 * n
    for size in np.frombuffer(data, np.uint32, n, 4).tolist():
        yield data[at : at + size]
        at += size


def encode_parts(parts: DataFrame, path: str) -> DataFrame:
    """The same parts with the token ids of each pre-token instead of the pre-tokens. All
    blocks of a part are read in one task, which encodes each distinct one once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(path), special_tokens={})
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            out = []
            for data in batch.column(2).to_pylist():
                tokens = []
                for word in words_of(data):
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= KNOWN_WORDS:
                            known.clear()
                        ids = known[word] = codec._encode_single_piece(word)
                    tokens.append(ids)
                out.append(pack_lists(tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["of_block", "of_part", "tokens"])
        known.clear()
        release()

    return parts.mapInArrow(encode, "of_block long, of_part int, tokens binary")


def _assembler(path: str):
    """Puts the ids of one block in place and decodes them by the token-byte table."""

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        table = {rank: token for token, rank in read_ranks(path).items()}
        answers = {i: unpack_lists(data) for i, data in zip(right.column("of_part").to_pylist(), right.column("tokens").to_pylist())}
        of = unpack_numbers(left.column("parts")[0].as_py())
        # Word i of the block is the next one of its part.
        size = np.zeros(len(of), np.int64)
        starts, flat, base = np.zeros(len(of), np.int64), [], 0
        for i, (sizes, ids) in answers.items():
            mine = of == i
            size[mine] = sizes
            starts[mine] = base + np.cumsum(sizes, dtype=np.int64) - sizes
            flat.append(ids)
            base += len(ids)
        tokens = np.concatenate(flat).tolist() if flat else []
        ends = (starts + size).tolist()
        starts = starts.tolist()
        coded = [",".join(map(str, tokens[a:b])) for a, b in zip(starts, ends)]
        decoded = [b"".join(map(table.__getitem__, tokens[a:b])) for a, b in zip(starts, ends)]
        rows: list[tuple] = []
        for ids, counts, data in zip(*(left.column(c).to_pylist() for c in ("ids", "counts", "data"))):
            every, at = unpack_numbers(data), 0
            for key, n in zip(ids, np.frombuffer(counts, np.int64).tolist()):
                here = every[at : at + n]
                at += n
                numbers = here.tolist()
                sha = hashlib.sha256(",".join(map(coded.__getitem__, numbers)).encode()).hexdigest()
                back = hashlib.sha256(b"".join(map(decoded.__getitem__, numbers))).hexdigest()
                rows.append((key, int(size[here].sum()), sha, back))
        types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
        del answers, coded, decoded, tokens, starts, ends
        release()
        return pa.table({name: pa.array(c, t) for name, c, t in zip(names, list(zip(*rows)) or [()] * 4, types)})

    return assemble


def encode_corpus(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", assemble=None, schema: str = OUT_SCHEMA
) -> DataFrame:
    """One row per input row, made by ``assemble`` from a block and the ids of its words.

    By default ``id``, the number of tokens, and SHA-256 of the ids (decimal, by commas)
    and of the bytes decoded from them. A null or empty text has no tokens. Null keys and
    repeated rows are kept; other columns are ignored. A block holds some megabytes of
    text, or one longer text; a frequent pre-token counts once a block. There are as many
    parts as shuffle partitions.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = scratch_dir(spark, "bpe-blocks")
    text_blocks(docs, pattern, parts, key, text).write.option("compression", "uncompressed").parquet(place)
    blocks = spark.read.schema(PART_SCHEMA).parquet(place)
    words = blocks.where("part >= 0").select("block", "part", "data").repartition(parts, "part")
    texts = blocks.where("part = -1").select("block", "ids", "counts", "data", "parts")
    return (
        texts.groupBy("block")
        .cogroup(encode_parts(words, path).groupBy("of_block"))
        .applyInArrow(assemble or _assembler(path), schema)
    )
