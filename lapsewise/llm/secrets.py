"""Secrets: patterns with a fixed form, and strings that a primed compressor cannot predict."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.common import column, count_of, fresh, keyed_text, small_batches, spans_digest

# Kinds with a fixed form, in the order they are listed in.
KINDS = ["assign", "access", "hex"]


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(map(either_case, ["password", "passwd", "secret", "token"])) + "|" + either_case("api") + "_?" + either_case("key")
ASSIGN = re.compile(rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
# A run below the least length has no longer part, so a bound in the pattern drops the same runs.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST_VALUE = 6

# Candidates of the novelty test: long unbroken strings with a digit and a letter.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
# Sensitive words begin a word or a part of a name: after no letter, or at a camel-case border.
WORDS = ["pass", "pwd", "secret", "token", "auth", "bearer", "credential", "private", "api", "key", "login", "access"]
SENSITIVE = re.compile(
    rf"(?<![^\W\d_])(?i:{'|'.join(WORDS)})|(?<=[^\W\d_])(?:{'|'.join(w.capitalize() for w in WORDS)})|(?<=[a-z])(?:{'|'.join(w.upper() for w in WORDS)})"
)
# The rest of a candidate behind a name and '='; '=' at its end is padding.
VALUE = re.compile(r"[^=]+=*\Z|[^=]+(?==)")
LEAST_CANDIDATE = 16
# Characters before a candidate that tell what it is, and that prime the compressor.
NEAR, AROUND = 48, 512
# Marginal compressed bits a character from which a string counts as unpredictable.
LEAST_BITS = 4.0

# Identifiers and code that the compressor knows beforehand.
DICTIONARY = (
    "password passwd secret token api_key apikey access_key client_secret private_key authorization bearer credential "
    "username login session cookie config settings environment production development staging example placeholder "
    "function return class import export default const static public private protected void string integer boolean "
    "self.value = None if __name__ == '__main__': def __init__(self, request, response, connection, database): "
    "https://www.example.com/index.html?page=1&ref=home http://localhost:8080/api/v1/users/ "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 2020-01-01T00:00:00Z "
)

# What a text must contain for any span: the JVM tests it, so that few texts reach Python.
NEEDED = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
    r"""|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16}"""
)

SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())]))
SCHEMA = "id long, spans array<struct<kind: string, start: int, end: int, bits: double>>"


def compressed(data: bytes, history: bytes) -> int:
    """Bytes of ``data`` compressed by a compressor that has just seen ``history``."""
    primed = zstandard.ZstdCompressionDict(history, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False).compress(data))


def entropy(value: str) -> float:
    counts = [value.count(c) for c in set(value)]
    return -sum(n / len(value) * math.log2(n / len(value)) for n in counts)


def novelty(value: str, around: str) -> float:
    """Marginal compressed bits a character of ``value`` next to the text around it.

    The frame that any compressed string has is subtracted. A string of literals is
    coded at the cost of its own alphabet, which the compressor does not do for short
    inputs: the smaller of both counts.
    """
    history = (DICTIONARY + around).encode()
    extra = compressed(value.encode(), history) - compressed(b"", history)
    return min(8 * extra / len(value), 2 * entropy(value))


def base_spans(text: str) -> list[tuple[str, int, int, float]]:
    """Spans of a fixed form, by start and then by kind."""
    found = [("assign", m.start(), m.end(), 0.0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [("access", m.start(), m.end(), 0.0) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), 0.0) for m in HEX.finditer(text)]
    return found


def surroundings(text: str, start: int, end: int) -> str:
    """The text on either side of a string, with its other copies blanked out: a string that
    stands twice is no less a secret. Copies that the limits cut count too."""
    copy = text[start:end].rstrip("=")
    blank, far = " " * len(copy), AROUND + end - start
    before, after = text[max(0, start - far) : start].replace(copy, blank), text[end : end + far].replace(copy, blank)
    return before[-AROUND:] + after[:AROUND]


def novel_span(text: str, start: int, end: int, least_bits: float) -> list[tuple[str, int, int, float]]:
    """The span of one string, if it is unpredictable and stands next to a sensitive word."""
    value = text[start:end]
    if not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value):
        return []
    if not SENSITIVE.search(text, max(0, start - NEAR), start):
        return []
    bits = novelty(value, surroundings(text, start, end))
    return [("novel", start, end, round(bits, 3))] if bits >= least_bits else []


def novel_spans(text: str, least_bits: float = LEAST_BITS) -> list[tuple[str, int, int, float]]:
    """Unpredictable strings that stand next to a sensitive word.

    In NAME=value the value is looked at by itself, and the name is part of what stands
    before it; where no part is found, the string is looked at as a whole.
    """
    found = []
    for m in CANDIDATE.finditer(text):
        parts = [(v.start(), v.end()) for v in VALUE.finditer(text, m.start(), m.end())] if "=" in m[0].rstrip("=") else []
        spans = [s for a, b in parts if b - a >= LEAST_CANDIDATE for s in novel_span(text, a, b, least_bits)]
        found += spans or novel_span(text, m.start(), m.end(), least_bits)
    return found


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    order = {kind: i for i, kind in enumerate([*KINDS, "novel"])}
    return sorted(base_spans(text) + novel_spans(text), key=lambda s: (s[1], order[s[0]]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        spans = [
            [] if text is None else [dict(zip(("kind", "start", "end", "bits"), s)) for s in spans_of(text)]
            for text in batch.column(1).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPANS)], ["id", "spans"])


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``id`` and ``spans`` (kind, start, end, bits), by start.

    Kinds assign, access and hex have a fixed form; ``novel`` spans are strings next to a
    sensitive word whose marginal compressed size is near that of random characters.
    Positions are code points, the end exclusive. Spans of different kinds may overlap.
    Null and empty texts have none; null keys and repeated rows are kept; columns beyond
    key and text are ignored. The cost of a candidate does not depend on the text's
    length, as only AROUND characters on either side prime the compressor.
    """
    df = keyed_text(docs, key, text)
    return df.withColumn("text", F.when(F.col("text").rlike(NEEDED), F.col("text"))).mapInArrow(_scan, SCHEMA)


def without_spans(text: str, spans: list[tuple[str, int, int, float]], mark: str) -> str:
    """A text with each run of overlapping spans replaced by one mark."""
    parts, at = [], 0
    for _, start, end, _ in sorted(spans, key=lambda s: s[1]):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join(parts) + text[at:]


def masked(docs: DataFrame, text: str = "text", mark: str = "<secret>") -> DataFrame:
    """The same rows and columns with ``mark`` in place of every secret of the text.

    Null texts stay null. Only texts that may hold a secret are sent to Python.
    """

    names = docs.columns
    at = names.index(text)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches([batch]):
                bodies = part.column(at).to_pylist()
                flags = part.column(part.num_columns - 1).to_pylist()
                clean = [without_spans(t, spans_of(t), mark) if f else t for t, f in zip(bodies, flags)]
                columns = [pa.array(clean, pa.string()) if i == at else part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(columns, names)

    flagged = docs.withColumn(fresh(docs, "may_hold_a_secret"), F.coalesce(column(text).rlike(NEEDED), F.lit(False)))
    # By place, as names may hold dots.
    return flagged.toDF(*map(str, range(len(names) + 1))).mapInArrow(mask, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    counts = [count_of(kind) for kind in KINDS]
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(spans_digest(base), 256).alias("base_sha256"), spans_digest(F.col("spans")).alias("spans")
    )
