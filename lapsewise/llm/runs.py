"""Periodic runs of words: stretches that say the same piece at least four times over.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are
the same) and at least ``max(6, 4 * q)`` words that no neighbour extends.

Periods below ``DIRECT`` are found by comparing the text with itself at each lag. Longer
ones are found scale by scale: at scale ``Q`` (periods of ``Q`` to ``2Q - 1``) every word
position gets the hash of the ``2Q`` words that start there, and the least hash of every
``Q`` neighbouring positions is marked. Inside a run those windows repeat at the distance of
the period, so a mark and the one a period later have the same hash; and no equal one lies
between them, as ``2Q`` words that start less than a period apart inside a run differ.
Pairs of neighbouring equal marks at a distance of the scale are therefore all that is
needed as seeds; they are extended word by word, which also settles that they are right.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.common import keyed_text, small_batches
from lapsewise.llm.hashing import U, mix

LEAST_WORDS, LEAST_TURNS = 6, 4
# Periods below this are looked for at every lag, longer ones by scale; a power of two.
DIRECT = 8
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
OUT_SCHEMA = "id long, runs array<struct<start long, length long, period long>>, collapsed string"


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]])))
    return edges[::2], edges[1::2] - edges[::2]


def _direct(words: np.ndarray, period: int) -> list[tuple[int, int, int]]:
    """Start, end and period of every stretch of four turns at one lag."""
    starts, lengths = _stretches(words[period:] == words[:-period])
    long = lengths + period >= max(LEAST_WORDS, LEAST_TURNS * period)
    return [(a, a + n + period, period) for a, n in zip(starts[long].tolist(), lengths[long].tolist())]


def _window(values: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of every ``size`` neighbours (a power of two)."""
    step = 1
    while step < size:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def _seeds(words: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of neighbouring equal marks ``scale`` to ``2 * scale - 1`` apart."""
    hashes = mix(words.astype(U))
    step = 1
    while step < 2 * scale:
        hashes = mix(mix(hashes[:-step]) + hashes[step:])
        step *= 2
    if len(hashes) < scale:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    least = _window(hashes, scale, np.minimum)
    # A position is marked if a window that holds it has its hash as least.
    around = np.concatenate([np.zeros(scale - 1, U), least, np.zeros(scale - 1, U)])
    marks = np.flatnonzero(_window(around, scale, np.maximum) == hashes)
    order = marks[np.argsort(hashes[marks], kind="stable")]
    apart = np.diff(order)
    good = (hashes[order[1:]] == hashes[order[:-1]]) & (apart >= scale) & (apart < 2 * scale)
    at, lag = order[:-1][good], apart[good]
    by = np.lexsort((at, lag))
    return at[by], lag[by]


def _same_length(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values are the same."""
    n, done, step = min(len(a), len(b)), 0, 64
    a, b = a[:n], b[:n]
    while done < n:
        other = np.flatnonzero(a[done : done + step] != b[done : done + step])
        if len(other):
            return done + int(other[0])
        done, step = min(n, done + step), step * 2
    return n


def _scaled(words: np.ndarray, scale: int) -> list[tuple[int, int, int]]:
    """Start, end and period of every run with a period of this scale."""
    found, last, end = [], -1, -1
    for at, lag in zip(*(x.tolist() for x in _seeds(words, scale))):
        if lag == last and at < end - lag:
            continue
        back = _same_length(words[:at][::-1], words[: at + lag][::-1])
        ahead = _same_length(words[at:], words[at + lag :])
        last, end = lag, at + lag + ahead
        if end - (at - back) >= LEAST_TURNS * lag:
            found.append((at - back, end, lag))
    return found


def find_runs(words: np.ndarray, sizes: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs of each of several texts as (start, length, period), by start, then period.

    ``words`` holds the word numbers (0 and up) of all texts one after the other, ``sizes``
    how many each text has. Every text is followed by a number of its own, which no run
    can pass.
    """
    n = len(sizes)
    starts = np.cumsum(sizes) - sizes + np.arange(n)
    line = np.empty(int(sizes.sum()) + n, np.int64)
    line[starts + sizes] = -1 - np.arange(n)
    line[np.delete(np.arange(len(line)), starts + sizes)] = words
    text = np.repeat(np.arange(n), sizes + 1)
    found: dict[tuple[int, int], int] = {}

    def keep(runs: list[tuple[int, int, int]], of: np.ndarray | None = None) -> None:
        # A stretch that has a shorter period too has been found with it before.
        for a, b, period in runs:
            if of is not None:
                a, b = int(of[a]), int(of[b - 1]) + 1
            found.setdefault((a, b), period)

    for period in range(1, min(DIRECT, len(line))):
        keep(_direct(line, period))
    scale = DIRECT
    while (long := sizes >= LEAST_TURNS * scale).any():
        of = np.flatnonzero(long[text])
        keep(_scaled(line[of], scale), of)
        scale *= 2
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    for (a, b), period in sorted(found.items(), key=lambda x: (x[0][0], x[1])):
        i = int(text[a])
        runs[i].append((a - int(starts[i]), b - a, period))
    return runs


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when of each run only the first turn is kept."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) == 0


def planted_tail(key: int | None, n: int) -> np.ndarray | None:
    """The word order of a text of ``n`` words of which the tail is made periodic: every
    tenth key by its CRC-32, from a place and with a period that follow from it."""
    h = zlib.crc32(str(key).encode())
    if key is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def word_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", reorder: Callable[[int | None, int], np.ndarray | None] | None = None
) -> DataFrame:
    """``id``, ``runs`` (start, length, period in words from 0, by start, then period) and
    ``collapsed``, the words left when of each run only the first turn is kept, joined by
    single spaces; one row per input row.

    Words are what stands between ASCII white space (space, tab to carriage return); they
    are compared as they are. ``reorder`` may give another word order of a text, from its
    key and number of words. A null, empty or blank text has no words, no run and an empty
    ``collapsed``. Null keys and repeated rows are kept and judged each on its own; further
    columns are ignored. Memory follows a batch of 8 MB or one longer text (about 150 bytes
    a word).
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            numbers: dict[bytes, int] = {}
            keys, orders = batch.column(0).to_pylist(), []
            for i, body in zip(keys, batch.column(1).cast(pa.binary())):
                found = (body.as_py() or b"").split()
                words = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int64, len(found))
                order = reorder(i, len(words)) if reorder else None
                orders.append(words if order is None else words[order])
            sizes = np.array([len(o) for o in orders], np.int64)
            runs = find_runs(np.concatenate(orders), sizes)
            spoken = list(numbers)
            collapsed = [
                b" ".join(map(spoken.__getitem__, (o[kept_words(len(o), r)] if r else o).tolist())).decode("utf-8", "replace")
                for o, r in zip(orders, runs)
            ]
            rows = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(rows, pa.list_(RUN)), pa.array(collapsed, pa.string())], ["id", "runs", "collapsed"]
            )

    return keyed_text(docs, key, text).mapInArrow(scan, OUT_SCHEMA)


def _best(field: str) -> Column:
    return F.col(f"_best.{field}")


def digest(found: DataFrame) -> DataFrame:
    """One row per text: the number of runs, the longest run (ties: the first, then the
    shortest period; null without a run) and SHA-256 of the list of runs and of the
    collapsed text."""
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), -r["start"], -r["period"])))
    return (
        found.select(
            F.col("id").alias("doc_id"),
            F.size("runs").cast("long").alias("n_runs"),
            longest.alias("_best"),
            F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
            F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        )
        .select(
            "doc_id",
            "n_runs",
            (-_best("col2")).alias("start"),
            _best("length").alias("length"),
            (-_best("col3")).alias("period"),
            F.expr("(1000 * _best.length) div -_best.col3").alias("exponent_milli"),
            "runs_sha256",
            "collapsed_sha256",
        )
    )
