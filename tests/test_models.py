import math

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from lapsewise.functions.scoring import RISK_WEIGHTS, risk_logit
from lapsewise.operators.explain import ACTIONS, NO_ACTION, _tree_arrays, linear_contributions, recommend, tree_contributions
from lapsewise.operators.logistic import fit_logistic
from lapsewise.operators.preprocess import build_preprocessor, category_slots, feature_names, fitted_categories, one_hot, one_hot_vectors, scale, scale_stats
from lapsewise.operators.split import class_weights, positive_weight, stratified_split
from lapsewise.operators import train as training
from lapsewise.operators.train import (
    boosted_trees,
    candidates,
    conditional_model,
    cross_validate,
    evaluate_splits,
    feature_importance,
    fit,
    predict,
    sample_params,
    task_count,
    tree_rows,
    tune,
)
from lapsewise.operators.quality import TRAINING_RULES
from lapsewise.plans.training import check_training_data, train_churn_model
from lapsewise.sources.scratch import stored

SMALL = {"n_estimators": 5, "max_depth": 3}


@pytest.fixture(scope="module")
def split_rows(customers):
    return stored(stratified_split(customers), "split")


@pytest.fixture(scope="module")
def trees(split_rows):
    return fit(split_rows, boosted_trees(SMALL))


def test_split_sizes_are_exact_and_repeatable(customers, split_rows):
    n = {r["Exited"]: r["count"] for r in customers.groupBy("Exited").count().collect()}
    got = {(r["Exited"], r["split"]): r["count"] for r in split_rows.groupBy("Exited", "split").count().collect()}
    for label, size in n.items():
        test = math.ceil(size * 0.2)
        val = math.ceil((size - test) * 0.2)
        assert (got[label, "test"], got[label, "val"], got[label, "train"]) == (test, val, size - test - val)
    again = stratified_split(customers.repartition(7)).select("customer_uuid", "split")
    assert again.exceptAll(split_rows.select("customer_uuid", "split")).count() == 0
    other = stratified_split(customers, seed=1).select("customer_uuid", "split")
    assert other.exceptAll(split_rows.select("customer_uuid", "split")).count() > 0


def test_weights(spark):
    df = spark.createDataFrame([(1,)] * 2 + [(0,)] * 8, "Exited int")
    assert {r["Exited"]: r["weight"] for r in class_weights(df).collect()} == {1: 2.5, 0: 0.625}
    assert positive_weight(df).first()[0] == 4.0


def test_scale_uses_population_deviation_of_the_training_rows(spark):
    train = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "a double, b double")
    out = scale(spark.createDataFrame([(3.0, 1.0)], "a double, b double"), ["a", "b"], scale_stats(train, ["a", "b"]))
    assert tuple(out.first()) == (2.0, 0.0)


def test_one_hot_unknown_is_all_zeros(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    cats = fitted_categories(train, ["c"])
    rows = one_hot(spark.createDataFrame([("a",), ("z",), (None,)], "c string"), cats)
    assert rows.columns == ["c", "c_a", "c_b"]
    assert [tuple(r)[1:] for r in rows.collect()] == [(1, 0), (0, 0), (0, 0)]
    assert one_hot(train, cats, drop_first=True).columns == ["c", "c_b"]
    with pytest.raises(ValueError):
        fitted_categories(train, ["c"], limit=1)


def test_preprocessor_shape_names_and_unknown_category(spark, split_rows, tmp_path):
    model = build_preprocessor().fit(split_rows.where("split = 'train'"))
    names = feature_names(model)
    row = model.transform(split_rows.limit(1).withColumn("Geography", F.lit("Atlantis"))).first()
    assert len(row["features"]) == len(names) == 12 + 3 + 2 + 4 + 3
    geo = [row["features"][i] for i, n in enumerate(names) if n.startswith("Geography_")]
    assert geo == [0.0, 0.0, 0.0]
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.transform(split_rows.limit(3)).select("features").count() == 3


def test_predict_and_importance(spark, split_rows, trees):
    out = predict(trees, split_rows)
    assert {"probability", "prediction", "risk_level"} <= set(out.columns)
    assert out.where("probability < 0 OR probability > 1").count() == 0
    assert predict(trees, split_rows, include_features=False).columns == [
        "customer_uuid", "probability", "prediction", "risk_level",
    ]
    rows = feature_importance(trees, spark).collect()
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0)
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)


def test_every_split_is_evaluated(split_rows):
    model = fit(split_rows, candidates()["logistic_regression"])
    m = {r["split"]: r for r in evaluate_splits(model, split_rows).collect()}
    assert set(m) == {"train", "val", "test"} and m["train"]["roc_auc"] > 0.6


def test_tree_contributions_add_up_to_the_margin(split_rows, trees):
    rows = tree_contributions(split_rows, trees, feature_names(trees), n=100)
    both = rows.join(predict(trees, split_rows).select("customer_uuid", "probability"), "customer_uuid").collect()
    assert both
    for r in both:
        assert 1 / (1 + math.exp(-2 * r["prediction_value"])) == pytest.approx(r["probability"], abs=1e-9)
        total = r["base_value"] + sum(c["contribution"] for c in r["top_features"])
        assert total == pytest.approx(r["prediction_value"], abs=1e-9)


def test_tree_contributions_of_each_feature(split_rows, trees):
    names = feature_names(trees)
    rows = split_rows.withColumn("Age", F.when(F.col("CreditScore") % 5 == 0, float("nan")).otherwise(F.col("Age")))
    got = {r["customer_uuid"]: r["top_features"] for r in tree_contributions(rows, trees, names, n=100).collect()}
    arrays = _tree_arrays(trees)
    for r in PipelineModel(stages=trees.stages[:-1]).transform(rows).select("customer_uuid", "features").limit(60).collect():
        x, credit = r["features"].toArray(), dict.fromkeys(names, 0.0)
        for t in arrays:
            at = 0
            while t["left"][at] >= 0:
                down = t["left"][at] if x[t["feature"][at]] <= t["cut"][at] else t["right"][at]
                credit[names[t["feature"][at]]] += t["value"][down] - t["value"][at]
                at = down
        found = sorted(c["contribution"] for c in got[r["customer_uuid"]])
        assert found == pytest.approx(sorted(credit.values()), abs=1e-12)


def test_linear_contributions_and_advice(customers):
    rows = customers.withColumn("IsSingleProduct", (F.col("NumOfProducts") == 1).cast("int"))
    means = rows.agg(*[F.avg(c).alias(c) for c in RISK_WEIGHTS])
    out = linear_contributions(rows, RISK_WEIGHTS, means).withColumn("logit", risk_logit()).collect()
    for r in out:
        assert r["prediction_value"] == pytest.approx(r["logit"])
        sizes = [abs(c["contribution"]) for c in r["top_features"]]
        assert sizes == sorted(sizes, reverse=True)


def test_recommendations(spark):
    schema = "risk_level string, top_features array<struct<feature:string,contribution:double,impact:string>>"
    listed = [("Age", 0.1, "increase"), ("Tenure", -0.9, "decrease"), ("Unknown", 0.5, "increase"), ("Balance", 0.05, "increase")]
    df = spark.createDataFrame([("high", listed), ("low", listed), ("medium", []), ("high", None), ("high", listed[2:3])], schema)
    got = [r["recommendations"] for r in recommend(df).collect()]
    assert got[0] == [ACTIONS["Tenure"][1], ACTIONS["Age"][0]]
    assert got[1] == [NO_ACTION]
    assert got[2] == ["Monitor closely. Send satisfaction survey."]
    assert got[3] == got[4] == ["Immediate intervention required. Offer retention incentives."]


def test_search(split_rows):
    space = {"max_depth": (2, 3), "learning_rate": (0.05, 0.2), "n_estimators": (2, 3)}
    grid = sample_params(2, space=space)
    assert grid == sample_params(2, space=space)
    found = tune(split_rows, [*grid, {"max_depth": -1}])
    assert len(found) == 2 and found[0]["objective"] >= found[1]["objective"]
    with pytest.raises(RuntimeError):
        tune(split_rows, [{"max_depth": -1}])


def test_tree_rows_are_dealt_over_the_cores(spark, monkeypatch):
    assert [task_count(n, 12) for n in (0, 1, 50_000, 50_001, 700_000, 6_000_000, 6_000_001)] == [1, 1, 1, 2, 12, 12, 24]
    monkeypatch.setattr(training, "LEAST_ROWS", 100)
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 4000, 1, 1).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), "id")
    dealt = tree_rows(rows, 4000, ["id"], "k")
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == cores and max(sizes) < 1.3 * 4000 / cores
    assert sorted(r["id"] for r in dealt.collect()) == list(range(4000))
    again = tree_rows(rows.repartition(3), 4000, ["id"], "k")
    assert again.rdd.glom().collect() == dealt.rdd.glom().collect()


def test_boosted_trees_read_a_checkpoint(spark, split_rows, monkeypatch):
    read = []
    whole = GBTClassifier._fit
    monkeypatch.setattr(GBTClassifier, "_fit", lambda self, rows: read.append(rows) or whole(self, rows))
    model = fit(split_rows, boosted_trees(SMALL))
    (rows,) = read
    assert "Scan ExistingRDD" in rows._jdf.queryExecution().toString() and "parquet" not in rows._jdf.queryExecution().toString()
    assert rows.count() == split_rows.where("split <> 'test'").count()
    # As many partitions as before: the same rows in the same order, so the same trees.
    ready = PipelineModel(stages=model.stages[:-1]).transform(split_rows.where("split <> 'test'").withColumn("is_validation", F.col("split") == "val"))
    if ready.rdd.getNumPartitions() == 1:
        plain = whole(boosted_trees(SMALL), ready.select("features", "Exited", "is_validation"))
        # The first line names the estimator.
        assert plain.toDebugString.split("\n")[1:] == model.stages[-1].toDebugString.split("\n")[1:]


def test_cross_validation(split_rows):
    train = split_rows.where("split = 'train'")
    model, table = cross_validate(train, candidates()["logistic_regression"], {"regParam": [0.0, 10.0]}, folds=2)
    assert [set(r) for r in table] == [{"regParam", "average_precision"}] * 2
    assert table[0]["average_precision"] >= table[1]["average_precision"]
    assert predict(model, split_rows).count() == split_rows.count()


def test_conditional_model(customers):
    model = conditional_model(customers)
    p = model.probability()
    # At the optimum the residuals add up to nothing, also weighted by each feature.
    sums = customers.agg(*[F.sum((F.col("Exited") - p) * x).alias(n) for n, x in (("one", F.lit(1.0)), ("age", F.col("Age")), ("balance", F.col("Balance")))]).first()
    assert max(abs(sums["one"]), abs(sums["age"]) / 100, abs(sums["balance"]) / 1e5) < 1e-6


def test_logistic_weights_and_limits(spark):
    rows = [(0.0, 1, 2.0), (0.0, 0, 1.0), (1.0, 1, 1.0), (1.0, 0, 3.0), (None, 0, 1.0), (1.0, None, 1.0), (1.0, 1, None)]
    df = spark.createDataFrame(rows, "x double, y int, w double").withColumn("same", F.lit(4.0))
    model = fit_logistic(df, ["x", "same"], "y", "w")
    # A saturated model gives the weighted shares of each value.
    got = {r["x"]: r["p"] for r in df.where("x is not null").select("x", model.probability().alias("p")).collect()}
    assert got[0.0] == pytest.approx(0.5) and got[1.0] == pytest.approx(0.25) and model.coefficients[1] == 0.0
    with pytest.raises(ValueError, match="both classes"):
        fit_logistic(df.where("y = 1"), ["x"], "y")
    with pytest.raises(ValueError, match="part the classes"):
        fit_logistic(spark.createDataFrame([(float(i), int(i > 3)) for i in range(8)], "x double, y int"), ["x"], "y")


def test_many_classes_and_categories(spark):
    rows = spark.range(30_000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 10_000).alias("c"), F.concat(F.lit("v"), F.lpad((F.col("id") % 10_001).cast("string"), 5, "0")).alias("v"))
    sizes = stratified_split(rows, "c", "k", 0.3, 0.3).groupBy("c").pivot("split", ["test", "val", "train"]).count().drop("c").distinct().collect()
    assert [tuple(r) for r in sizes] == [(1, 1, 1)]
    slots = category_slots(rows, "v")
    coded = one_hot_vectors(rows.union(spark.createDataFrame([("x", 1, "new"), ("y", 1, None)], rows.schema)), "v", slots, "vector")
    assert coded.where("vector is null").count() == 0
    some = {r["v"]: r["vector"] for r in coded.where("k in ('0', '10000', 'x', 'y')").collect()}
    assert some["v00000"].size == 10_001 and list(some["v00000"].indices) == [0] and list(some["v10000"].indices) == [10_000]
    assert some["new"].numNonzeros() == some[None].numNonzeros() == 0


def test_training_flow(customers):
    ready = customers.select(*[r.column for r in TRAINING_RULES])
    space = {"max_depth": (2, 3), "n_estimators": (2, 3)}
    done = train_churn_model(ready, n_trials=1, baseline_params=SMALL, space=space)
    items = {r["item"] for r in done.summary.collect()}
    assert {"baseline_pr_auc", "tuned_pr_auc", "improvement"} <= items and len(items) == 8
    with pytest.raises(ValueError):
        check_training_data(ready.where("Exited = 0"))
