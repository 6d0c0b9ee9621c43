"""Toxicity of texts: a bidirectional recurrent network with attention over words.

A word comes in twice: as a hashed word, and by its character n-grams, of which each input
takes the greatest. Both tables start with how much a word or n-gram leans to toxic texts
in the labelled rows. Gated recurrent units read a window of words in both directions,
attention pools what they saw, and a text has the score of its highest window. Windows
overlap and cover the whole text.

Labels are of texts, not of windows: in training each text teaches by the window that
scores highest at the time.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.common import column, keyed_text, small_batches, stored
from lapsewise.llm.hashing import U, mix

WORD = re.compile(r"[^\W_]+")
# Clean and toxic labelled rows that a model is fitted on, and their most characters.
FIT_ROWS, FIT_CHARS = (2_000, 1_000), 30_000
# Words in a window, and from one window to the next.
WINDOW, STEP = 32, 24
# Inputs by word and by n-gram, units in each direction.
INPUTS, UNITS = 4, 8
WORD_BUCKETS, GRAM_BUCKETS = 1 << 15, 1 << 17
GRAMS = (3, 4, 5, 6)
# Texts that a word or n-gram must be in to lean anywhere, and pseudo-texts that hold it.
LEAST_TEXTS, PSEUDO = 3, 4.0
ROUNDS, RATE, BATCH = 12, 0.02, 64
# One labelled text of so many is not learned from; it tells which round was the best.
CHECKED = 6
THRESHOLD = 0.3
# Bytes of text that a step inside a task scores at once.
STEP_BYTES = 2 << 20
KEEP = 30.0  # drives the update gate so far that padding leaves the state as it was


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def word_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word; buckets of all its n-grams (with marks for begin and end), and
    where those of each word start. Every word has one n-gram at least."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(U) + U(1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(codes))
    owner = np.repeat(np.arange(len(words)), sizes)
    power = U(0x9E3779B97F4A7C15)
    total, owners, buckets = codes.copy(), [], []
    for n in range(2, max(GRAMS) + 1):
        total = mix(total[:-1]) * power + codes[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(left[: len(total)] >= n)
            owners.append(owner[at])
            buckets.append((mix(total[at] + U(n)) % U(GRAM_BUCKETS)).astype(np.int64))
    owners, buckets = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owners, kind="stable")
    starts = np.searchsorted(owners[order], np.arange(len(words)))
    # A word's own hash is that of the whole of its codes.
    place = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    whole = np.add.reduceat(mix(codes * power + place.astype(U)), ends - sizes)
    return (mix(whole) % U(WORD_BUCKETS)).astype(np.int64), buckets[order], starts


def leaning(buckets: list[np.ndarray], toxic: np.ndarray, size: int) -> np.ndarray:
    """How much each bucket leans to toxic texts: the log of the ratio of its shares, over
    its standard error; ``buckets`` holds those of each text."""
    counts = np.zeros((2, size))
    for own, label in zip(buckets, toxic):
        counts[int(label), np.unique(own)] += 1
    n = np.array([[np.sum(toxic == 0)], [np.sum(toxic == 1)]])
    prior = PSEUDO * n / n.sum()
    lean = np.diff(np.log((counts + prior) / (n + PSEUDO)), axis=0)[0] / np.sqrt((1 / (counts + prior)).sum(axis=0))
    return np.where(counts.sum(axis=0) >= LEAST_TEXTS, np.clip(lean / 3, -1, 3), 0)


class Network:
    """Parameters by name, forward pass and gradients."""

    def __init__(self, seed: int = 7):
        rnd = np.random.default_rng(seed)
        small = lambda *shape: (0.2 * rnd.standard_normal(shape)).astype(np.float32)
        self.words, self.grams = small(WORD_BUCKETS, INPUTS) / 10, small(GRAM_BUCKETS, INPUTS) / 10
        self.p = {}
        for side in ("ahead", "back"):
            self.p[f"x_{side}"] = small(2 * INPUTS, 3 * UNITS)
            self.p[f"h_{side}"] = small(UNITS, 3 * UNITS)
            self.p[f"b_{side}"] = np.zeros(3 * UNITS, np.float32)
        self.p |= {"attend": small(2 * UNITS), "out": small(2 * UNITS), "bias": np.zeros(1, np.float32)}

    def inputs(self, own: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Inputs of each word."""
        best = [np.maximum.reduceat(self.grams[grams, i], starts) for i in range(INPUTS)]
        return np.concatenate([self.words[own], np.stack(best, axis=1)], axis=1)

    def scores(self, x: np.ndarray, windows: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Log odds of each window. ``windows`` holds row numbers of ``x``, and -1 where a
        window has no more words; with ``trace`` all states are kept there."""
        b, t = windows.shape
        states = np.zeros((t, b, 2 * UNITS), x.dtype)
        for k, side in enumerate(("ahead", "back")):
            given = x @ self.p[f"x_{side}"] + self.p[f"b_{side}"]
            rest = np.zeros((1, 3 * UNITS), x.dtype)
            rest[0, :UNITS] = KEEP
            given = np.concatenate([given, rest])  # row -1
            h, mine = np.zeros((b, UNITS), x.dtype), slice(k * UNITS, (k + 1) * UNITS)
            for i in range(t) if side == "ahead" else reversed(range(t)):
                g, own = given[windows[:, i]], h @ self.p[f"h_{side}"]
                gates = sigmoid(g[:, : 2 * UNITS] + own[:, : 2 * UNITS])
                keep, reset = gates[:, :UNITS], gates[:, UNITS:]
                new = np.tanh(g[:, 2 * UNITS :] + reset * own[:, 2 * UNITS :])
                if trace is not None:
                    trace[side, i] = h, keep, reset, new, own[:, 2 * UNITS :]
                h = new + keep * (h - new)
                states[i, :, mine] = h
        weight = np.where(windows.T >= 0, states @ self.p["attend"], -np.inf)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        if trace is not None:
            trace |= {"states": states, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradients(self, x: np.ndarray, windows: np.ndarray, trace: dict, slope: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of ``x``, for the slope of the loss by window."""
        states, weight, pooled = trace["states"], trace["weight"], trace["pooled"]
        grad = {"bias": slope.sum(keepdims=True), "out": slope @ pooled}
        through = slope[:, None] * self.p["out"]
        by_weight = np.einsum("tbh,bh->tb", states, through)
        by_score = weight * (by_weight - (weight * by_weight).sum(axis=0))
        grad["attend"] = np.einsum("tb,tbh->h", by_score, states)
        by_state = weight[:, :, None] * through + by_score[:, :, None] * self.p["attend"]
        by_x = np.zeros((len(x) + 1, x.shape[1]), x.dtype)
        for k, side in enumerate(("ahead", "back")):
            mine, u = slice(k * UNITS, (k + 1) * UNITS), self.p[f"h_{side}"]
            by_u, by_given, carried = np.zeros_like(u), np.zeros((len(x) + 1, 3 * UNITS), x.dtype), 0.0
            t = windows.shape[1]
            for i in reversed(range(t)) if side == "ahead" else range(t):
                h, keep, reset, new, own = trace[side, i]
                dh = by_state[i, :, mine] + carried
                by_new = dh * (1 - keep) * (1 - new * new)
                by_keep = dh * (h - new) * keep * (1 - keep)
                by_reset = by_new * own * reset * (1 - reset)
                by_own = np.concatenate([by_keep, by_reset, by_new * reset], axis=1)
                by_u += h.T @ by_own
                carried = dh * keep + by_own @ u.T
                np.add.at(by_given, windows[:, i], np.concatenate([by_keep, by_reset, by_new], axis=1))
            by_given = by_given[:-1]
            grad |= {f"h_{side}": by_u, f"x_{side}": x.T @ by_given, f"b_{side}": by_given.sum(axis=0)}
            by_x[:-1] += by_given @ self.p[f"x_{side}"].T
        return grad, by_x[:-1]


def windows_of(n: int) -> np.ndarray:
    """Word numbers of all windows of a text of ``n`` words; the last one ends with the text."""
    starts = np.arange(0, max(1, n - WINDOW + STEP), STEP)
    starts = np.minimum(starts, max(0, n - WINDOW))
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < n, at, -1)


class Texts:
    """Texts as numbers of their distinct words, in windows."""

    def __init__(self, texts: list[str | None]):
        numbers: dict[str, int] = {}
        found = [[numbers.setdefault(w, len(numbers)) for w in words_of(t)] for t in texts]
        self.hashes = word_hashes(list(numbers)) if numbers else None
        self.words = [np.array(f, np.int64) for f in found]
        # Row -1 of a text is no word.
        made = [np.append(w, -1)[windows_of(len(w))] for w in self.words if len(w)]
        self.windows = np.concatenate(made) if made else np.zeros((0, WINDOW), np.int64)
        self.counts = np.array([len(windows_of(len(w))) if len(w) else 0 for w in self.words], np.int64)

    def highest(self, network: Network, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest log odds of each text with words, and the window that has it."""
        odds = np.concatenate([network.scores(x, self.windows[i : i + 8192]) for i in range(0, len(self.windows), 8192)])
        starts = (np.cumsum(self.counts) - self.counts)[self.counts > 0]
        top = np.maximum.reduceat(odds, starts)
        of = np.repeat(np.arange(len(starts)), self.counts[self.counts > 0])
        at = np.flatnonzero(odds == top[of])
        return top, at[np.unique(of[at], return_index=True)[1]]


def train(texts: list[str], toxic: list[int], shares: tuple[float, float] = (1.0, 1.0), rounds: int = ROUNDS, seed: int = 7) -> Network:
    """A network for labelled texts; ``shares`` weighs clean and toxic ones. Texts without
    words teach nothing. Every ``CHECKED``-th text is kept apart: the network is that of
    the round with the least loss on those."""
    data = Texts(texts)
    label = np.array(toxic)
    learned = np.arange(len(label)) % CHECKED > 0
    if len(set(label[learned & (data.counts > 0)].tolist())) < 2:
        learned[:] = True
    network = Network(seed)
    own, grams, starts = data.hashes
    counts = np.diff(np.append(starts, len(grams)))
    kinds = [np.unique(data.words[i]) for i in np.flatnonzero(learned)]
    network.words[:, 0] = leaning([own[k] for k in kinds], label[learned], WORD_BUCKETS)
    of_word = lambda k: np.concatenate([grams[starts[i] : starts[i] + counts[i]] for i in k] or [grams[:0]])
    network.grams[:, 0] = leaning([of_word(k.tolist()) for k in kinds], label[learned], GRAM_BUCKETS)
    label, learned = label[data.counts > 0], learned[data.counts > 0]
    loads = np.where(label == 1, shares[1], shares[0]) / np.mean(np.where(label == 1, shares[1], shares[0]))
    checked = ~learned if not learned.all() else learned
    rnd = np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in network.p.items()}
    square = {k: np.zeros_like(v) for k, v in network.p.items()}
    step, best, least = 0, network, np.inf
    for number in range(rounds + 1):
        top, at = data.highest(network, network.inputs(own, grams, starts))
        losses = np.logaddexp(0, np.where(label == 1, -top, top)) * loads
        if number and losses[checked].mean() < least:
            least, best = losses[checked].mean(), copy.deepcopy(network)
        if number == rounds:
            break
        order = rnd.permutation(np.flatnonzero(learned))
        for chosen in (order[i : i + BATCH] for i in range(0, len(order), BATCH)):
            used, windows = np.unique(data.windows[at[chosen]], return_inverse=True)
            windows = windows.reshape(len(chosen), WINDOW)
            if used[0] == -1:
                used, windows = used[1:], windows - 1
            mine = np.concatenate([np.arange(starts[i], starts[i] + counts[i]) for i in used])
            first = np.cumsum(counts[used]) - counts[used]
            x = network.inputs(own[used], grams[mine], first)
            trace: dict = {}
            odds = network.scores(x, windows, trace)
            slope = ((sigmoid(odds) - label[chosen]) * loads[chosen] / len(chosen)).astype(np.float32)
            grad, by_x = network.gradients(x, windows, trace, slope)
            step += 1
            for k, g in grad.items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                network.p[k] -= RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
            # Tables are changed only where a word or the greatest n-gram was used.
            np.add.at(network.words, own[used], -RATE * by_x[:, :INPUTS])
            word = np.repeat(np.arange(len(used)), counts[used])
            for i in range(INPUTS):
                greatest = np.flatnonzero(network.grams[grams[mine], i] == x[word, INPUTS + i])
                word_of, at_first = np.unique(word[greatest], return_index=True)
                np.add.at(network.grams[:, i], grams[mine[greatest[at_first]]], -RATE * by_x[word_of, INPUTS + i])
    return best


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: tuple[int, int] = FIT_ROWS) -> Network | float:
    """A network fitted on at most ``fit_rows`` clean and toxic labelled texts, of up to
    ``FIT_CHARS`` characters, chosen by a hash of their key and taken once each if equal.

    Rows without key, text or label teach nothing; of two labels of one key the toxic one
    counts. Where one class has no rows the result is the share of toxic ones (0 without
    any) instead of a network.
    """
    marks = labels.select(column(key).cast("long").alias("id"), column(label).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    marks = marks.groupBy("id").agg(F.max("toxic").alias("toxic"))
    usable = F.col("text").rlike(r"[^\W_]")
    rows = keyed_text(docs, key, text).where("id is not null")
    # Keys are chosen first; texts are only moved for those. Of a repeated key the last text counts.
    known = rows.where(usable).select("id", (F.char_length("text") <= FIT_CHARS).alias("fits")).groupBy("id").agg(F.bool_and("fits").alias("fits"))
    known = stored(known.join(marks, "id"), "labelled")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = [
        (r["id"], kind)
        for kind in (0, 1)
        for r in known.where((F.col("toxic") == kind) & F.col("fits")).orderBy(F.xxhash64("id"), "id").select("id").limit(fit_rows[kind]).collect()
    ]
    picked = docs.sparkSession.createDataFrame(chosen, "id long, toxic int")
    bodies = rows.where(usable).join(F.broadcast(picked), "id").groupBy("id", "toxic").agg(F.max("text").alias("text"))
    found = sorted(bodies.collect(), key=lambda r: (r["toxic"], r["id"]))
    each = dict.fromkeys((r["text"], r["toxic"]) for r in found)
    texts, toxic = [t for t, _ in each], [k for _, k in each]
    if len(set(toxic)) < 2 or not any(words_of(t) for t in texts):
        return 1.0 if sizes.get(1) and not sizes.get(0) else 0.0
    return train(texts, toxic, (sizes[0] / toxic.count(0), sizes[1] / toxic.count(1)))


def score_texts(docs: DataFrame, network: Network | float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``score`` (0 to 1) of each row, from all windows of its whole text.

    A null or empty text and one without letters or digits scores 0. Null keys and repeated
    rows are kept; further columns are ignored.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, STEP_BYTES):
            data = Texts(batch.column(1).to_pylist())
            out = np.zeros(batch.num_rows)
            some = data.counts > 0
            if isinstance(network, float):
                out[some] = network
            elif some.any():
                top, _ = data.highest(network, network.inputs(*data.hashes))
                out[some] = np.round(sigmoid(top.astype(float)), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["id", "score"])

    return keyed_text(docs, key, text).mapInArrow(score, "id long, score double")
