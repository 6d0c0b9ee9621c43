import pytest
from pyspark.sql import functions as F

from lapsewise.operators.split import stratified_split
from lapsewise.operators.train import boosted_trees, fit, optimize
from lapsewise.plans import models
from lapsewise.sources.scratch import stored


@pytest.fixture(scope="module")
def split_rows(customers):
    return stored(stratified_split(customers.drop("probability", "prediction", "risk_level")), "split")


@pytest.fixture(scope="module")
def kept(split_rows, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("kept"))
    version = models.save_model(fit(split_rows, boosted_trees({"n_estimators": 3, "max_depth": 2})), base)
    return base, version


def test_stages_point_to_versions(spark, kept, split_rows):
    base, version = kept
    with pytest.raises(ValueError, match="no model"):
        models.staged_version(spark, base, "trial")
    models.promote(spark, base, version, "trial")
    second = models.save_model(fit(split_rows, boosted_trees({"n_estimators": 2, "max_depth": 2})), base)
    models.promote(spark, base, second, "trial")
    assert models.staged_version(spark, base, "trial") == second
    models.promote(spark, base, version, "trial")
    assert models.staged_version(spark, base, "trial") == version
    with pytest.raises(Exception):
        models.promote(spark, base, "unknown", "trial")


def test_train_once_score_twice(spark, kept, split_rows, tmp_path):
    base, version = kept
    models.promote(spark, base, version)
    source = str(tmp_path / "customers.parquet")
    split_rows.drop("split").write.parquet(source)
    name = "scores_" + version
    try:
        first = models.score_to_table(spark, source, base, name).first()
        one = stored(spark.read.table(name).drop("scored_at"), "one")
        models.score_to_table(spark, source, base, name)
        two = spark.read.table(name).drop("scored_at")
        assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0
        models.score_to_table(spark, source, base, name, "append")
        n = split_rows.count()
        assert spark.read.table(name).count() == 2 * n and first["total_scored"] == n and first["model_version"] == version
        with pytest.raises(ValueError, match="there is a table"):
            models.score_to_table(spark, source, base, name, "fail")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.read.parquet(source).limit(0).write.parquet(str(tmp_path / "none.parquet"))
    with pytest.raises(ValueError, match="no customers"):
        models.score_to_table(spark, str(tmp_path / "none.parquet"), base, name)


def test_sequential_search(split_rows):
    space = {"max_depth": (-1, 2), "n_estimators": (2, 3)}
    trials = optimize(split_rows, 4, space)
    assert [t.number for t in trials] == [0, 1, 2, 3]
    assert all((t.value is None) == (t.params["max_depth"] < 0) for t in trials)
