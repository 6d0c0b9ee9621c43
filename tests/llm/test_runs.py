import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lapsewise.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i + q] for i in range(len(words) - q)))


def plain_runs(words):
    """All runs by looking at every lag, and at the smallest period of what is found."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and smallest_period(words[i : i + length]) == q:
                found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(key, text, planted):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(key).encode())
    if planted and key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    out = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in out)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None,) * 3
    milli = None if not found else 1000 * best[1] // best[2]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (key, len(found), *best, milli, sha("".join("%d,%d,%d\n" % r for r in found)), sha(kept))


def rhythm(rnd, size):
    """Words of a few kinds, with pieces said several times over and copies with one change."""
    out = []
    while len(out) < size:
        piece = [f"w{rnd.randrange(rnd.choice([2, 3, 50]))}" for _ in range(rnd.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 64, 100]))]
        turns = rnd.choice([1, 2, 3, 4, 5, 6])
        said = (piece * turns)[: max(1, len(piece) * turns - rnd.randrange(3))]
        if rnd.random() < 0.3:
            said[rnd.randrange(len(said))] = "changed"
        out += said
    return out[:size]


@pytest.mark.parametrize("seed", range(30))
def test_runs_are_those_of_every_lag(seed):
    rnd = random.Random(seed)
    texts = [rhythm(rnd, rnd.randrange(0, 700)) for _ in range(6)] + [[]]
    texts.append([f"w{rnd.randrange(2)}" for _ in range(300)])
    texts.append(["a"] * 50 + ["b"] + ["a"] * 50)
    numbers = {}
    ids = [np.array([numbers.setdefault(w, len(numbers)) for w in t], np.int64) for t in texts]
    found = runs.find_runs(np.concatenate(ids), np.array([len(i) for i in ids]))
    assert found == [plain_runs(t) for t in texts]


def test_runs_of_one_long_text():
    """A period of thousands of words, and one that stays just under four turns."""
    rnd = random.Random(5)
    piece = [f"w{rnd.randrange(10**6)}" for _ in range(5000)]
    other = [f"v{rnd.randrange(10**6)}" for _ in range(3000)]
    words = ["x"] + piece * 5 + ["y"] + other * 4 + ["z"] + (other * 4)[:-1]
    numbers = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    assert runs.find_runs(ids, np.array([len(ids)])) == [[(1, 25000, 5000), (25002, 12000, 3000)]]


@pytest.mark.parametrize("planted", [False, True])
def test_rows(spark, docs, corpus, planted):
    rnd = random.Random(9)
    extra = [(100 + i, " \t".join(rhythm(rnd, rnd.randrange(1, 400)))) for i in range(60)]
    extra += [(200, "a b c\x1cd " * 9), (201, "日本 " * 7), (202, "a " * 5), (203, "a " * 6)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    found = runs.digest(runs.word_runs(df, reorder=runs.planted_tail if planted else None))
    rows = [(r[0], r[1]) for r in corpus if r[0] != 67 or not planted] + extra
    want = [plain_row(k, t, planted) for k, t in rows]
    got = [tuple(r) for r in found.collect() if r[0] != 67 or not planted]
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)
    assert found.dtypes == [("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"), ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]


def test_own_columns_and_collapsed_text(spark, docs, no_docs):
    df = spark.createDataFrame([(1, "say it say it say it say it now", "x", 5)], "`doc.id` long, body string, runs string, collapsed int")
    row = runs.word_runs(df, "doc.id", "body").first()
    assert row["collapsed"] == "say it now" and [tuple(r) for r in row["runs"]] == [(0, 8, 2)]
    assert runs.digest(runs.word_runs(no_docs)).collect() == []
