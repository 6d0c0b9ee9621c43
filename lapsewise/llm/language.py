"""Language of texts: unigram models over word pieces, summed over all segmentations."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.common import column, small_batches, stored

WORD = re.compile(r"[^\W\d_]+")
# Rows per language that a model is fitted on, at most about so many.
FIT_ROWS = 300
ROUNDS = 2
# Probability of a character that is no piece, and pseudo-count of a piece.
UNKNOWN, PSEUDO = 1e-8, 0.05
# Scores of words that a task remembers before it starts anew.
REMEMBERED = 400_000
# Bytes of text that a step inside a task reads at once.
STEP_BYTES = 2 << 20
# Words whose segmentations are summed together, and their most letters; a longer word is
# summed alone, in logarithms, as its sums would underflow.
STEP_WORDS, SHORT = 5_000, 30
CODE_BITS = 21  # of a character


def word_pieces(path: str) -> list[str]:
    """Lower-case pieces of a public sentencepiece vocabulary, without markers and bytes."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i)
            if piece == piece.lower() and WORD.fullmatch(piece.replace("▁", "") or "-"):
                pieces[piece] = None
    return list(pieces)


class Pieces:
    """The pieces as a trie that many positions of many words walk at once."""

    def __init__(self, pieces: list[str]):
        steps: dict[int, int] = {}
        last = np.zeros(len(pieces), np.int64)
        for i, piece in enumerate(pieces):
            at = 0
            for c in piece:
                at = steps.setdefault(at << CODE_BITS | ord(c), len(steps) + 1)
            last[i] = at
        # The key after all others is never asked for.
        self.keys = np.array(sorted(steps) + [np.iinfo(np.int64).max], np.int64)
        self.to = np.array([steps.get(k, 0) for k in self.keys.tolist()], np.int64)
        self.piece = np.full(len(steps) + 1, -1)
        self.piece[last] = np.arange(len(pieces))
        self.longest = max(map(len, pieces), default=1)

    def lattice(self, words: list[str]) -> Lattice:
        """All segmentations of the words: each edge is a piece between two places, or -1
        for a character that is no piece. A word ends on a place of its own."""
        codes = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        offset = np.arange(len(codes)) - np.repeat(ends - sizes, sizes + 1)
        at = np.setdiff1d(np.arange(len(codes)), ends, assume_unique=True)
        state, found = np.zeros(len(at), np.int64), []
        for length in range(1, self.longest + 1):
            key = state << CODE_BITS | codes[at + length - 1]
            step = np.searchsorted(self.keys, key)
            known = self.keys[step] == key
            piece = np.where(known, self.piece[self.to[step]], -1)
            edge = piece >= 0 if length > 1 else np.ones(len(at), bool)
            found.append((at[edge], at[edge] + length, piece[edge]))
            at, state = at[known], self.to[step[known]]
        start, end, piece = map(np.concatenate, zip(*found))
        return Lattice(start, end, piece, offset, ends - sizes, ends)


@dataclass
class Lattice:
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    offset: np.ndarray  # of each place in its word
    firsts: np.ndarray
    lasts: np.ndarray

    def sums(self, chance: np.ndarray, back: bool = False) -> np.ndarray:
        """At each place the sum over all ways there from the begin of its word, or with
        ``back`` from its end; ``chance`` has a row for each edge."""
        source, target = (self.end, self.start) if back else (self.start, self.end)
        out = np.zeros((len(self.offset), chance.shape[1]))
        out[self.lasts if back else self.firsts] = 1.0
        order = np.argsort(self.offset[target] * len(self.offset) + target)
        source, target, chance = source[order], target[order], chance[order]
        runs = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        # Places equally far into their words are summed together.
        level = self.offset[target[runs]]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1]])), len(runs))
        steps = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        for a, b in reversed(steps) if back else steps:
            lo, hi = runs[a], runs[b] if b < len(runs) else len(target)
            out[target[runs[a:b]]] = np.add.reduceat(out[source[lo:hi]] * chance[lo:hi], runs[a:b] - lo, axis=0)
        return out


@dataclass
class LanguageModel:
    languages: list[str]
    index: dict[str, int]
    chances: np.ndarray  # piece x language
    pieces: Pieces | None = None

    def __post_init__(self):
        self.pieces = self.pieces or Pieces(list(self.index))

    def by_edge(self, lattice: Lattice, languages: slice = slice(None)) -> np.ndarray:
        # The last row is that of -1.
        chances = self.chances[:, languages]
        return np.vstack([chances, np.full((1, chances.shape[1]), UNKNOWN)])[lattice.piece]

    def edges_to(self, word: str, end: int) -> list[tuple[int, int]]:
        """Begin and number of each piece of a word that ends at a place; -1 for a character
        that is no piece."""
        edges = [(s, i) for s in range(max(0, end - self.pieces.longest), end) if (i := self.index.get(word[s:end])) is not None]
        return edges if any(s == end - 1 for s, _ in edges) else [*edges, (end - 1, -1)]

    def score_word(self, word: str) -> np.ndarray:
        """Log probability of a word by language, with sums scaled at each place and only
        the places kept that a piece can still reach back to."""
        logs: dict[int, np.ndarray] = {0: np.zeros(len(self.languages))}
        for end in range(1, len(word) + 1):
            edges = self.edges_to(word, end)
            top = np.max([logs[s] for s, _ in edges], axis=0)
            total = sum(np.exp(logs[s] - top) * (self.chances[i] if i >= 0 else UNKNOWN) for s, i in edges)
            logs[end] = top + np.log(total)
            logs.pop(end - self.pieces.longest, None)
        return logs[len(word)]

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word by language: the sum over all its segmentations."""
        out = np.zeros((len(words), len(self.languages)))
        # Sums over short words do not underflow.
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        for at in range(0, len(short), STEP_WORDS):
            mine = short[at : at + STEP_WORDS]
            lattice = self.pieces.lattice([words[i] for i in mine])
            sums = lattice.sums(self.by_edge(lattice))
            out[mine] = np.log(np.maximum(sums[lattice.lasts], 1e-300))
        for i, w in enumerate(words):
            if len(w) > SHORT:
                out[i] = self.score_word(w)
        return out

    def add_word(self, totals: np.ndarray, word: str, count: float, language: int) -> None:
        """Adds the expected uses of each piece in one word of any length to ``totals``."""
        costs, last = self.chances[:, language], len(word)

        def log_of(piece: int) -> float:
            return math.log(costs[piece] if piece >= 0 else UNKNOWN)

        ahead = np.zeros(last + 1)
        for end in range(1, last + 1):
            ahead[end] = np.logaddexp.reduce([ahead[s] + log_of(i) for s, i in self.edges_to(word, end)])
        back = np.full(last + 1, -np.inf)
        back[last] = 0.0
        for end in range(last, 0, -1):
            for s, i in self.edges_to(word, end):
                way = log_of(i) + back[end]
                if i >= 0:
                    totals[i] += count * math.exp(ahead[s] + way - ahead[last])
                back[s] = np.logaddexp(back[s], way)

    def expected(self, words: list[str], counts: np.ndarray, language: int) -> np.ndarray:
        """Expected uses of each piece in counted words (forward and backward sums)."""
        totals = np.zeros(len(self.chances))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(sizes > SHORT).tolist():
            self.add_word(totals, words[i], float(counts[i]), language)
        words, counts = [w for w in words if len(w) <= SHORT], counts[sizes <= SHORT]
        for at in range(0, len(words), STEP_WORDS):
            lattice = self.pieces.lattice(words[at : at + STEP_WORDS])
            chance = self.by_edge(lattice, slice(language, language + 1))
            ahead, back = lattice.sums(chance)[:, 0], lattice.sums(chance, back=True)[:, 0]
            whole = ahead[lattice.lasts]
            weight = np.divide(counts[at : at + STEP_WORDS], whole, out=np.zeros(len(whole)), where=whole > 0)
            weight = np.repeat(weight, lattice.lasts - lattice.firsts + 1)  # by place
            used = weight[lattice.start] * ahead[lattice.start] * chance[:, 0] * back[lattice.end]
            real = lattice.piece >= 0
            totals += np.bincount(lattice.piece[real], used[real], len(totals))
        return totals


def words_of(text: str) -> Counter:
    """Words, counted."""
    found = Counter(WORD.findall(text.lower()))
    if not all(map(str.isalpha, found)):
        found = Counter({w: n for w, n in found.items() if any(map(str.isalpha, w))})
    return found


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word, n in words_of(text or "").items():
                counts[lang, word] += n
        rows = list(counts.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())],
            ["lang", "word", "n"],
        )


def fit_languages(
    labelled: DataFrame, vocabulary: str, key: str, text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS, rounds: int = ROUNDS
) -> LanguageModel:
    """Piece probabilities by language, from about ``fit_rows`` rows of each language.

    Rows are chosen by a hash of their key, evenly over all labelled rows. Each round of
    expectation and maximisation is a pass over the distinct words with counts; only
    totals by piece and language, as many as the vocabulary has, reach the driver.
    Rows without text or language teach nothing.
    """
    df = labelled.select(column(key).alias("id"), column(lang).alias("lang"), column(text).alias("text")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in df.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    pieces = word_pieces(vocabulary)
    index = {p: i for i, p in enumerate(pieces)}
    model = LanguageModel(languages, index, np.full((len(pieces), len(languages)), 1.0 / max(1, len(pieces))))
    if not languages:
        return model
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, fit_rows / n))])
    drawn = df.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    words = drawn.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long")
    words = stored(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    for _ in range(rounds):
        current = model

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = np.zeros((len(current.languages), len(current.index)))
            for batch in batches:
                names, spelled = np.array(batch.column(0).to_pylist(), object), np.array(batch.column(1).to_pylist(), object)
                for i, name in enumerate(current.languages):
                    mine = names == name
                    totals[i] += current.expected(["▁" + w for w in spelled[mine]], batch.column(2).to_numpy()[mine], i)
            rows, cols = np.nonzero(totals)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(cols), pa.array(totals[rows, cols])], ["l", "p", "c"])

        sums = words.mapInArrow(expect, "l long, p long, c double").groupBy("l", "p").agg(F.sum("c").alias("c")).toArrow()
        totals = np.full(model.chances.shape, PSEUDO)
        totals[sums["p"].to_numpy(), sums["l"].to_numpy()] += sums["c"].to_numpy()
        model = LanguageModel(languages, index, totals / totals.sum(axis=0), model.pieces)
    return model


def predict_languages(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``id, lang, score``.

    The score is the probability of the language among those known. A text that is null
    or has no letter is ``und`` with score 0, and so is every text where the model knows
    no language. Words are read whole at any length; repeated rows each give a row;
    other columns are ignored.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        logs = np.zeros((0, len(model.languages)))
        for batch in small_batches(batches, STEP_BYTES):
            names, scores = [], []
            counted = [words_of(body) if body and model.languages else {} for body in batch.column(1).to_pylist()]
            if len(known) > REMEMBERED:
                known, logs = {}, logs[:0]
            fresh = list(set().union(*counted) - known.keys())
            if fresh:
                known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
                logs = np.concatenate([logs, model.score_words(["▁" + w for w in fresh])])
            for counts in counted:
                if not counts:
                    names.append("und")
                    scores.append(0.0)
                    continue
                n = np.fromiter(counts.values(), float, len(counts))
                total = n @ logs[np.fromiter(map(known.__getitem__, counts), np.int64, len(counts))]
                best = int(total.argmax())
                names.append(model.languages[best])
                scores.append(1.0 / float(np.exp(np.maximum(total - total[best], -700.0)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang", "score"])

    df = docs.select(column(key).cast("long").alias("id"), column(text).cast("string").alias("text"))
    return df.mapInArrow(predict, "id long, lang string, score double")


def held_out(key: Column) -> Column:
    """Whether a document is kept out of the training rows."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2
