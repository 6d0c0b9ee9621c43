"""Operators that compare documents or vectors, against brute force."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from lapsewise.llm import decontaminate, jaccard, repeats, vectors
from lapsewise.llm.components import components


def least_of(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("block", [1000, 3])
def test_jaccard(docs, corpus, block):
    sets = {r[0]: shingles(r[1]) for r in corpus if r[0] is not None}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = least_of(sets, edges)
    rows = jaccard.near_duplicates(docs, block=block).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert r.component_id == (None if r.id is None else want[r.id])
        assert r.id is None or r.n_shingles == len(sets[r.id])
    assert edges and len(set(want.values())) < len(want)


def test_jaccard_of_large_clusters(spark, monkeypatch):
    """Chains of near copies, and families of them that share a rare n-gram only."""
    inner = jaccard._join_clusters

    def bounded(least):
        run = inner(least)

        def checked(table):
            assert table.num_rows <= 60
            return run(table)

        return checked

    monkeypatch.setattr(jaccard, "_join_clusters", bounded)
    rnd, texts = random.Random(8), []
    for family in range(3):
        words = [f"f{family}w{i}" for i in range(60)]
        for i in range(60):
            if i % 2:
                words[i] = f"f{family}new{i}"
            texts.append(" ".join(words + [f"f{family}more{x}" for x in range(i % 3 * 7)] + ["the", "link", "of", "all", "families"]))
    texts += [" ".join([f"only{i}x{k}" for k in range(8)] + ["the", "link", "of", "all", "families"]) for i in range(30)]
    rnd.shuffle(texts)
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    edges = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = least_of(sets, edges)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.id: r.component_id for r in jaccard.near_duplicates(df, block=10).collect()} == want
    assert 1 < len(set(want.values())) < len(want)


def test_jaccard_of_nothing(no_docs, docs):
    assert jaccard.near_duplicates(no_docs).count() == 0
    kept = jaccard.firsts(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 60").count() == 0 and kept.where("doc_id is null").count() == 2


@pytest.mark.parametrize("crowded", [5000, 2])
def test_repeats(docs, corpus, crowded):
    span = 20
    texts = {}
    for r in corpus:
        if r[0] is not None:
            texts[r[0]] = (r[1] or "").encode()
    want, seen = {}, set()
    for i in sorted(texts):
        b, gone = texts[i], bytearray(len(texts[i]))
        parts = [b[k : k + span] for k in range(len(b) - span + 1)]
        for k, part in enumerate(parts):
            if part in seen:
                gone[k : k + span] = b"\1" * span
        seen |= set(parts)
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    rows = repeats.remove_repeats(docs, span=span, gram=8, crowded=crowded).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        if r.id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.id]


def test_repeats_of_nothing(no_docs):
    assert repeats.remove_repeats(no_docs).count() == 0


def test_suffix_order_is_sorted():
    rnd = random.Random(1)
    for _ in range(30):
        pieces = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.randrange(6, 40))) for _ in range(rnd.randrange(1, 9))]
        data = np.frombuffer(b"".join(pieces), np.uint8)
        order, _ = repeats.suffix_order(data, np.array([len(p) for p in pieces]), 6)
        found = [data[i : i + 6].tobytes() for i in order]
        assert found == sorted(p[i : i + 6] for p in pieces for i in range(len(p) - 5))


def test_decontamination(spark, docs, no_docs, corpus):
    long = next(r[1] for r in corpus if r[0] == 67).split()
    changed = long[300:340]
    changed[10] = changed[27] = "other"
    items = [(1, " ".join(changed)), (2, "nothing of this kind stands in any text of them all at all really"), (3, None), (4, ""), (None, "x y"), (5, "a b")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_overlaps(docs, benchmark).collect()
    assert [(r.id, r.item_id, r.start) for r in found] == [(67, 1, 300)]
    assert found == decontaminate.find_overlaps(docs, benchmark, sent_words=0).collect()
    assert decontaminate.find_overlaps(no_docs, benchmark).count() == 0
    assert decontaminate.find_overlaps(docs, benchmark.limit(0)).count() == 0
    kept = decontaminate.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(corpus) - 1


def test_every_alignment_holds_a_seed(spark):
    """All ways to change words, of items of all lengths up to over a window."""
    items, texts, want = [], [], set()
    for n in range(1, 18):
        words = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        size = min(n, 16)
        for changes in range(n * 3 // 16 + 2):
            for c in itertools.combinations(range(n), changes):
                doc = len(texts)
                texts.append((doc, " ".join(["before", *("other" if i in c else w for i, w in enumerate(words)), "after"])))
                best = max(sum(i not in c for i in range(s, s + size)) for s in range(n - size + 1))
                if best * 16 >= size * 13:
                    want.add((doc, n, 1, best))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_overlaps(docs, benchmark).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_items_of_few_words(spark):
    docs = spark.createDataFrame([(1, "这是一个句子。然后"), (2, "so It is!"), (3, "is it"), (4, "")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "这是一个句子"), (2, "it is")], "item_id long, text string")
    want = [(1, 1, 0, 1), (2, 2, 1, 2)]
    assert sorted(map(tuple, decontaminate.find_overlaps(docs, benchmark).collect())) == want
    assert sorted(map(tuple, decontaminate.find_overlaps(docs, benchmark, sent_words=0).collect())) == want
    with pytest.raises(ValueError):
        decontaminate.find_overlaps(docs, benchmark, masks={1: ["11101101", "1101100111", "11010011011"]})


@pytest.mark.parametrize("block", [2048, 7])
def test_vectors(spark, block):
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(60, 8))
    near = base[:30] + 0.2 * rnd.normal(size=(30, 8))
    x = [list(map(float, v)) for v in np.vstack([base, near, base[:5], base[:3] * 2])]
    rows = [(i, v, i % 2 if i < 60 else (i - 60) % 2, 9) for i, v in enumerate(x)]
    odd = [None, [0.0] * 8, [math.nan] * 8, [math.inf] + [1.0] * 7, [None] + [1.0] * 7, [], [1.0]]
    rows += [(200 + i, v, 1, 9) for i, v in enumerate(odd)] + [(300, x[0], None, 9), (None, x[0], 0, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id int")
    good = {r[0]: (np.array(r[1]), r[2]) for r in rows[: len(x)]}
    edges = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and good[a][0] @ good[b][0] >= 0.93 * np.linalg.norm(good[a][0]) * np.linalg.norm(good[b][0])]
    want = least_of(good, edges)
    found = vectors.near_vectors(df, block=block).collect()
    assert len(found) == len(rows) and edges
    for r in found:
        assert r.component_id == want.get(r.id, r.id)
        assert r.n_links == sum(r.id in e for e in edges)
    assert vectors.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2048, 5])
def test_vectors_of_several_lengths(spark, block):
    rnd = np.random.default_rng(6)
    rows = []
    for length, n in ((8, 40), (3, 30), (1, 4), (12, 1)):
        base = rnd.normal(size=(n, length))
        for v in np.vstack([base, base[: n // 2] + 0.1 * rnd.normal(size=(n // 2, length)), base[: n // 4]]):
            rows.append((len(rows), list(map(float, v)), len(rows) % 2))
    good = {i: (np.array(v), label) for i, v, label in rows}

    def linked(a, b):
        (x, p), (y, q) = good[a], good[b]
        return len(x) == len(y) and p == q and x @ y >= 0.93 * np.linalg.norm(x) * np.linalg.norm(y)

    edges = [(a, b) for a in good for b in good if a < b and linked(a, b)]
    want = least_of(good, edges)
    found = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=block).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.component_id, r.n_links) == (want[r.id], sum(r.id in e for e in edges))


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(90), rnd.randrange(90)) for _ in range(50)] + [(5, None), (7, 7)]
    nodes = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    want = least_of(nodes, [e for e in edges if None not in e])
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    assert {r.node: r.component for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0
