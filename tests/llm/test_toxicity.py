import random

import numpy as np
import pytest

from lapsewise.llm import toxicity
from lapsewise.llm.registry import QUERIES

BAD = ["grumpf", "grumpfel", "snarkog", "snarkit"]


def plain_text(rnd, n, bad=0):
    words = [rnd.choice("the of and to in".split()) if rnd.random() < 0.5 else "".join(rnd.choice(["al", "be", "ga", "to", "ri"]) for _ in range(rnd.randrange(1, 5))) for _ in range(n)]
    for _ in range(bad):
        words[rnd.randrange(n)] = rnd.choice(BAD)
    return " ".join(words)


@pytest.fixture(scope="module")
def network():
    rnd = random.Random(1)
    clean = [plain_text(rnd, rnd.randrange(5, 200)) for _ in range(120)]
    toxic = [plain_text(rnd, rnd.randrange(5, 200), 3) for _ in range(60)]
    return toxicity.train(clean + toxic, [0] * 120 + [1] * 60)


def scores(spark, network, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return dict(map(tuple, toxicity.score_texts(df, network).collect()))


def test_gradients_are_slopes_of_the_loss():
    network, rnd = toxicity.Network(3), np.random.default_rng(4)
    network.p = {k: v.astype(float) for k, v in network.p.items()}
    x = rnd.standard_normal((9, 2 * toxicity.INPUTS))
    windows = rnd.integers(0, 9, (4, 6))
    windows[1, 3:] = -1
    weight = rnd.standard_normal(4)
    trace = {}
    network.scores(x, windows, trace)
    grad, by_x = network.gradients(x, windows, trace, weight)
    loss = lambda: float(weight @ network.scores(x, windows))
    for values, slopes in [(network.p[k], grad[k]) for k in network.p] + [(x, by_x)]:
        for i in rnd.integers(0, values.size, 5):
            old, before = values.flat[i], loss()
            values.flat[i] = old + 1e-6
            after = loss()
            values.flat[i] = old
            assert slopes.flat[i] == pytest.approx((after - before) / 1e-6, abs=1e-4)


def test_windows_overlap_and_cover_the_text():
    for n in [1, 31, 32, 33, 56, 57, 500]:
        at = toxicity.windows_of(n)
        assert set(at[at >= 0].tolist()) == set(range(n))
        assert all(b[0] < a[a >= 0][-1] for a, b in zip(at, at[1:]))


def test_held_out_texts(spark, network):
    rnd = random.Random(2)
    texts = [plain_text(rnd, rnd.randrange(5, 400), 3 * (i % 2)) for i in range(200)]
    found = scores(spark, network, texts)
    right = [(found[i] >= toxicity.THRESHOLD) == bool(i % 2) for i in range(200)]
    assert sum(right) >= 180


def test_the_whole_of_a_long_text_counts(spark, network):
    rnd = random.Random(3)
    calm = plain_text(rnd, 9000)
    found = scores(spark, network, [calm, calm + " snarkit grumpf snarkog", "snarkit grumpf " + calm])
    assert found[0] + 0.3 < min(found[1], found[2])


def test_scores_do_not_follow_the_layout(spark, network):
    rnd = random.Random(6)
    rows = [(i, plain_text(rnd, rnd.randrange(1, 90), i % 3)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (dict(map(tuple, toxicity.score_texts(df.repartition(n), network).collect())) for n in (1, 7))
    assert one == pytest.approx(many, abs=2e-6)


def test_odd_rows(spark, network, docs, corpus, no_docs):
    found = toxicity.score_texts(docs, network).collect()
    assert len(found) == len(corpus)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert all(r["score"] == 0 for r in found if r["id"] in (62, 63, 64))
    assert toxicity.score_texts(no_docs, network).collect() == []
    assert set(scores(spark, network, ["", None, "?!", "日本" * 50]).values()) != set()


def test_labels(spark, docs):
    """Repeated, missing and unusable labels; a class without rows."""
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int, text string")
    assert toxicity.fit_toxicity(docs, labels([])) == 0.0
    assert toxicity.fit_toxicity(docs, labels([(1, 0, "x"), (None, 1, "x"), (2, None, "x"), (3, 5, "x"), (999, 1, "x")])) == 0.0
    assert toxicity.fit_toxicity(docs, labels([(1, 1, "x"), (1, 0, "x")])) == 1.0
    assert isinstance(toxicity.fit_toxicity(docs, labels([(1, 1, "x"), (2, 0, "x"), (3, 0, "x"), (63, 1, "x")])), toxicity.Network)


def test_query_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    found = QUERIES["op11_toxicity"](spark, d)
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = found.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] for r in rows if r["toxic"] == 0]) < 0.1
    assert np.mean([r["predicted"] for r in rows if r["toxic"] == 1]) > 0.5
