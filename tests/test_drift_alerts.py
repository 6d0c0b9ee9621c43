import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapsewise.operators.alerts import (
    Levels,
    alerts,
    approval,
    critical,
    data_drift_alert,
    performance_alert,
    prediction_drift_alert,
    retrain_decision,
    retraining_report,
)
from lapsewise.operators.drift import (
    column_drift,
    compare,
    corr_diff,
    data_drift,
    feature_columns,
    ks,
    performance_drift,
    prediction_drift,
    psi,
)
from lapsewise.plans.monitoring import monitor


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(11)
    a, b = rng.normal(0, 1, 800), rng.normal(0.4, 1.3, 500)
    a[:260] = 0.0  # a third of the reference shares one value
    return a, b, *(spark.createDataFrame([(float(v), float(v) ** 2) for v in x], "x double, z double") for x in (a, b))


def test_a_table_does_not_drift_from_itself(customers):
    cols = ["Age", "Balance", "CreditScore"]
    assert all(r["value"] == 0 for r in compare(customers, customers, cols).collect())
    rows = column_drift(customers, customers, [*cols, "Geography"])
    assert not data_drift(rows).first()["drift_detected"]


def test_ks_psi_wasserstein_against_brute_force(sides):
    a, b, ref, cur = sides
    grid = np.union1d(a, b)
    fa = np.searchsorted(np.sort(a), grid, "right") / len(a)
    fb = np.searchsorted(np.sort(b), grid, "right") / len(b)
    assert ks(ref, cur, ["x"]).first()["ks"] == pytest.approx(np.max(np.abs(fa - fb)))

    edges = np.unique(np.quantile(a, np.linspace(0, 1, 11)))
    e, c = (np.histogram(v, bins=edges)[0] / (len(v) + 1e-8) for v in (a, b))
    want = np.sum((e - c) * np.log((e + 1e-8) / (c + 1e-8)))
    assert psi(ref, cur, ["x"]).first()["psi"] == pytest.approx(want)

    area = np.sum(np.abs(fa - fb)[:-1] * np.diff(grid)) / a.std()
    row = column_drift(ref, cur, ["x"]).first()
    assert row["method"] == "wasserstein_normed" and row["value"] == pytest.approx(area)

    diff = np.abs(np.corrcoef(a, a**2) - np.corrcoef(b, b**2)).mean()
    assert corr_diff(ref, cur, ["x", "z"]).first()[0] == pytest.approx(diff)
    assert corr_diff(ref, cur, ["x"]).first()[0] == 0.0


def test_jensen_shannon(spark):
    ref = spark.createDataFrame([("a",)] * 3 + [("b",)], "c string")
    cur = spark.createDataFrame([("a",)] + [("n",)], "c string")
    p, q = np.array([0.75, 0.25, 0]), np.array([0.5, 0, 0.5])
    m = (p + q) / 2
    kl = lambda x: sum(v * math.log(v / w) for v, w in zip(x, m) if v > 0)
    row = column_drift(ref, cur, ["c"]).first()
    assert row["value"] == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2)) and row["drifted"]


def test_degenerate_columns(spark):
    one = spark.createDataFrame([(1.0,)] * 4, "x double")
    none = spark.createDataFrame([(None,)], "x double")
    assert psi(one, one, ["x"]).first()["psi"] == 0.0
    assert psi(one, none, ["x"]).first()["psi"] == 0.0
    text = spark.createDataFrame([("a",)], "x string")
    assert ks(text, text, ["x"]).first()["ks"] is None


def test_feature_columns_leave_out_label_scores_and_ids():
    names = ["customer_uuid", "CustomerId", "Age", "Exited", "probability", "prediction"]
    assert feature_columns(names) == ["Age"]


def test_prediction_drift(spark):
    high = spark.createDataFrame([(0.9,), (1.0,)], "probability double")
    low = spark.createDataFrame([(0.1,), (0.2,)], "probability double")
    row = prediction_drift(low, high).first()
    assert row["prediction_drift_detected"] and row["mean_shift"] == pytest.approx(0.8)
    bare = spark.range(2)
    assert not prediction_drift(low, bare).first()["prediction_drift_detected"]
    assert prediction_drift(bare, high, default_reference=0.5).first()["mean_shift"] == pytest.approx(0.45)
    with pytest.raises(ValueError):
        prediction_drift(bare, high)


def test_performance_drift_needs_both_columns(spark, customers):
    with pytest.raises(ValueError):
        performance_drift(customers, customers.drop("probability"))
    assert not performance_drift(customers, customers).first()["performance_degraded"]


def row(spark, **fields):
    return spark.createDataFrame([tuple(fields.values())], list(fields))


@pytest.mark.parametrize(
    "make, flag, name, value, want",
    [
        (data_drift_alert, "drift_detected", "drift_share", 0.3, "info"),
        (data_drift_alert, "drift_detected", "drift_share", 0.55, "warning"),
        (data_drift_alert, "drift_detected", "drift_share", 0.75, "critical"),
        (prediction_drift_alert, "prediction_drift_detected", "mean_shift", -0.12, "warning"),
        (prediction_drift_alert, "prediction_drift_detected", "mean_shift", 0.20, "critical"),
        (performance_alert, "performance_degraded", "pr_auc_drop", 0.07, "warning"),
        (performance_alert, "performance_degraded", "pr_auc_drop", 0.12, "critical"),
    ],
)
def test_severities(spark, make, flag, name, value, want):
    out = make(row(spark, **{flag: True, name: value})).collect()
    assert [r["severity"] for r in out] == [want]
    assert make(row(spark, **{flag: False, name: value})).count() == 0


def test_custom_levels_and_messages(spark):
    out = data_drift_alert(row(spark, drift_detected=True, drift_share=0.4), Levels(drift_share=(0.3, 0.5))).first()
    assert out["severity"] == "warning" and out["message"] == "Data drift detected: 40.0% of features drifted"
    assert '"drift_share":0.4' in out["details"]


def test_alerts_decision_and_approval(spark):
    data = row(spark, drift_detected=True, drift_share=0.75)
    prediction = row(spark, prediction_drift_detected=True, mean_shift=0.12)
    performance = row(spark, performance_degraded=True, pr_auc_drop=0.07)
    rows = alerts(data, prediction, performance)
    assert [r["alert_type"] for r in rows.orderBy("position").collect()] == [
        "data_drift", "prediction_drift", "performance_degradation",
    ]
    assert critical(rows).count() == 1
    decision = retrain_decision(data, performance, rows)
    got = decision.first()
    assert got["should_retrain"] and got["reasons"] == [
        "Significant data drift detected: 75.0% of features",
        "Performance degradation: PR-AUC dropped by 0.070",
        "1 critical alerts triggered",
    ]
    assert [approval(decision, r, a).first()["approved"] for r, a in ((True, False), (True, True), (False, False))] == [
        False, True, True,
    ]
    told = {(r["section"], r["item"]): r["value"] for r in retraining_report(approval(decision)).collect()}
    assert told["decision", "recommendation"] == "RETRAIN" and told["results", "status"] == "Awaiting Approval"
    assert told["metrics", "drift_share"] == "75.0%" and told["reasons", "3"] == "1 critical alerts triggered"
    fitted = row(spark, pr_auc=0.7, top_precision_at_k=0.6, top_recall_at_k=0.4, top_lift_at_k=3.0)
    told = {r["item"]: r["value"] for r in retraining_report(approval(decision), fitted).where("section = 'results'").collect()}
    assert told["status"] == "COMPLETED" and told["lift_at_k"] == "3.0000"
    calm = row(spark, drift_detected=False, drift_share=0.1)
    quiet = retrain_decision(calm, None, alerts(calm))
    assert not quiet.first()["should_retrain"] and not approval(quiet, auto=True).first()["approved"]


def test_monitor_flow(customers):
    moved = customers.withColumn("Age", F.col("Age") + 20).withColumn("Balance", F.col("Balance") * 2)
    result = monitor(customers, moved, ["Age", "Balance", "Geography"])
    assert result.data.first()["n_drifted_columns"] == 2
    assert result.decision.first()["should_retrain"]
    assert {r["section"] for r in result.report().collect()} >= {"data_drift", "drifted_features", "alerts"}
