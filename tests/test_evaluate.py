import math

import numpy as np
import pytest

from lapsewise.operators import evaluate
from lapsewise.operators.lookup import held_if_small
from lapsewise.operators.evaluate import (
    all_metrics,
    average_precision,
    confusion,
    curve_metrics,
    joint_objective,
    metrics_by_segment,
    model_comparison,
    pr_auc,
    roc_auc,
    topk_metrics,
)


def frame(spark, y, s, seg=None):
    rows = [(i, int(a), float(b), (seg[i] if seg else "x")) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "k long, y int, s double, seg string")


# Positives above all others, in no order of their keys.
PERFECT = ([int(i % 4 == 2) for i in range(14)], [(i * 5 % 14 + 14 * (i % 4 == 2)) / 28 for i in range(14)])


def test_perfect_ranking(spark):
    m = topk_metrics(frame(spark, *PERFECT), "y", "s", "k", k=3).first()
    assert (m["precision_at_k"], m["recall_at_k"], m["tp_at_k"], m["fp_at_k"]) == (1.0, 1.0, 3, 0)


def test_k_beats_share_and_share_of_ten(spark):
    df = frame(spark, [int(i < 4) for i in range(16)], [1 / (i + 2) for i in range(16)])
    assert topk_metrics(df, "y", "s", "k", k=5, pct=0.75).first()["k"] == 5
    m = topk_metrics(df, "y", "s", "k", pct=0.125).first()
    assert m["k"] == 2 and m["lift_at_k"] == 4.0 and m["k_percent"] == 0.125
    assert topk_metrics(df, "y", "s", "k", k=17).first()["k"] == 16


def test_no_positives(spark):
    df = frame(spark, [0] * 7, [0.125 * i for i in range(7)])
    m = topk_metrics(df, "y", "s", "k", k=2).first()
    assert m["recall_at_k"] == 0.0 and m["lift_at_k"] == 0.0
    assert math.isnan(topk_metrics(df, "y", "s", "k", k=2, on_zero="nan").first()["lift_at_k"])
    c = curve_metrics(df, "y", "s").first()
    assert c["roc_auc"] == 0.0 and c["pr_auc"] is None


def test_areas_with_mixed_ties(spark):
    df = frame(spark, [1, 0, 1, 0], [0.9, 0.9, 0.7, 0.1])
    assert pr_auc(df, "y", "s").first()[0] == pytest.approx(2 / 3)
    assert average_precision(df, "y", "s").first()[0] == pytest.approx(7 / 12)
    assert roc_auc(df, "y", "s").first()[0] == pytest.approx(0.625)
    perfect = frame(spark, [1, 1, 1, 0, 0, 0], [0.9, 0.8, 0.7, 0.3, 0.2, 0.1])
    assert pr_auc(perfect, "y", "s").first()[0] == 1.0


def brute(y, s, keys, k):
    order = sorted(range(len(y)), key=lambda i: (-s[i], keys[i]))
    tp = sum(y[i] for i in order[:k])
    pos, neg = [s[i] for i in range(len(y)) if y[i]], [s[i] for i in range(len(y)) if not y[i]]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    area, last_r, last_p = 0.0, 0.0, 1.0
    for t in sorted(set(s), reverse=True):
        hit = [i for i in range(len(y)) if s[i] >= t]
        r, p = sum(y[i] for i in hit) / len(pos), sum(y[i] for i in hit) / len(hit)
        area += (r - last_r) * (p + last_p) / 2
        last_r, last_p = r, p
    return tp, wins / (len(pos) * len(neg)), area


@pytest.mark.parametrize("digits, groups", [(6, 100), (None, 100), (6, 1)])
def test_segments_against_brute_force(spark, digits, groups, monkeypatch):
    """Scores of one decimal: the cut falls inside a tie in every segment. With one
    group allowed the sums are not held but joined."""
    monkeypatch.setattr(evaluate, "held_if_small", lambda df: held_if_small(df, groups))
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.3).astype(int).tolist()
    s = np.round(rng.random(400), 1).tolist()
    seg = rng.choice(["a", "b", "c"], 400, p=[0.7, 0.2, 0.1]).tolist()
    df = frame(spark, y, s, seg)
    out = {r["seg"]: r for r in all_metrics(df, "y", "s", "k", by=["seg"], digits=digits).collect()}
    for g in "abc":
        at = [i for i in range(400) if seg[i] == g]
        k = max(1, int(len(at) * 0.15))
        tp, roc, area = brute([y[i] for i in at], [s[i] for i in at], at, k)
        r = out[g]
        assert (r["top_k"], r["top_tp_at_k"], r["n_samples"]) == (k, tp, len(at))
        assert r["roc_auc"] == pytest.approx(roc) and r["pr_auc"] == pytest.approx(area)
        assert r["true_positives"] + r["false_negatives"] == r["n_positives"]
    short = {r["segment"]: r for r in metrics_by_segment(df, "seg", "y", "s", "k").collect()}
    assert short["a"]["recall_at_k"] == out["a"]["top_recall_at_k"]


def test_null_segment_is_left_out(spark):
    df = frame(spark, [1, 0, 1], [0.9, 0.5, 0.4], ["a", "a", None])
    assert [r["segment"] for r in metrics_by_segment(df, "seg", "y", "s", "k").collect()] == ["a"]


def test_confusion_has_four_counts_for_one_class(spark):
    c = confusion(frame(spark, [0, 0, 0], [0.9, 0.2, 0.1]), "y", "s").first()
    assert (c["true_negatives"], c["false_positives"], c["false_negatives"], c["true_positives"]) == (2, 1, 0, 0)
    assert c["precision"] == 0.0 and c["f1"] == 0.0


def test_objective_and_comparison(spark):
    df = frame(spark, *PERFECT)
    row = joint_objective(all_metrics(df, "y", "s", "k", pct=0.3), 0.25, 0.75).first()
    assert row["objective"] == pytest.approx(1.0)
    both = df.selectExpr("k AS customer_uuid", "y", "s AS score", "'good' AS model").unionByName(
        df.selectExpr("k AS customer_uuid", "y", "1 - s AS score", "'bad' AS model")
    )
    assert [r["model"] for r in model_comparison(both).collect()] == ["good", "bad"]
