import pytest
from pyspark.sql import functions as F

from lapsewise.config import REQUEST_FEATURES
from lapsewise.functions.ids import with_customer_uuid
from lapsewise.operators.quality import (
    RAW_RULES,
    REQUEST_RULES,
    TRAINING_RULES,
    Rule,
    ValidationError,
    class_balance,
    clean,
    coerce,
    duplicate_count,
    keep_first,
    leakage_columns,
    missing_share,
    null_cells,
    require_columns,
    row_errors,
    split_target,
    validate,
    validation_report,
)


def test_valid_row_passes(one_row):
    assert validate(one_row(), RAW_RULES).count() == 1


@pytest.mark.parametrize(
    "column, value, check",
    [
        ("CreditScore", 250, "at_least"), ("CreditScore", 900, "at_most"), ("Geography", "Italy", "one_of"),
        ("Gender", "Other", "one_of"), ("CardType", "Bronze", "one_of"), ("Balance", -1000.0, "at_least"),
        ("Age", 5, "at_least"), ("Exited", 2, "one_of"),
    ],
)
def test_bad_values(one_row, column, value, check):
    with pytest.raises(ValidationError) as error:
        validate(one_row(**{column: value}), RAW_RULES)
    assert error.value.failures == [(column, check, 1)]


def test_all_failures_are_reported_and_rows_can_be_set_aside(one_row):
    bad = one_row(Age=5, Geography="Italy").unionByName(one_row(Balance=-1.0)).unionByName(one_row())
    with pytest.raises(ValidationError) as error:
        validate(bad, RAW_RULES)
    assert {f[0] for f in error.value.failures} == {"Age", "Geography", "Balance"}
    rows = row_errors(bad, RAW_RULES)
    assert rows.where(F.size("errors") == 0).count() == 1


def test_coercion_never_raises_or_truncates(spark):
    df = spark.createDataFrame([("12", "1.5"), ("x", "2"), (None, None)], "a string, b string")
    out = coerce(df, [Rule("a", "int"), Rule("b", "int")])
    assert [tuple(r) for r in out.collect()] == [(12, None), (None, 2), (None, None)]
    report = validation_report(df, [Rule("a", "int"), Rule("b", "int")]).where("failures > 0").collect()
    assert sorted(tuple(r) for r in report) == [
        ("a", "not_null", 1), ("a", "type", 1), ("b", "not_null", 1), ("b", "type", 1),
    ]


def test_training_schema_is_strict_and_unique(one_row):
    keyed = with_customer_uuid(one_row())
    ready = keyed.drop("RowNumber", "CustomerId", "Surname")
    assert validate(ready, TRAINING_RULES, strict=True).count() == 1
    with pytest.raises(ValidationError) as error:
        validate(keyed, TRAINING_RULES, strict=True)
    assert ("Surname", "expected", 1) in error.value.failures
    with pytest.raises(ValidationError) as error:
        validate(ready.unionByName(ready), TRAINING_RULES, strict=True)
    assert error.value.failures == [("customer_uuid", "unique", 1)]
    with pytest.raises(ValidationError) as error:
        validate(ready.drop("Age"), TRAINING_RULES)
    assert error.value.failures == [("Age", "present", 1)]


def test_request_rules_allow_younger_customers(one_row):
    assert validate(one_row(Age=12).select(*REQUEST_FEATURES), REQUEST_RULES).count() == 1


def test_leakage_columns():
    names = ["RowNumber", "CustomerId", "Surname", "Complain", "Satisfaction Score", "Point Earned", "CreditScore", "Exited"]
    assert leakage_columns(names) == ["Complain", "CustomerId", "RowNumber", "Satisfaction Score", "Surname"]
    assert leakage_columns(["pred_churn", "prediction_score", "shap_age", "Age", "customer_uuid"]) == [
        "pred_churn", "prediction_score", "shap_age",
    ]
    assert leakage_columns([]) == []


@pytest.mark.parametrize("ones, minimum, passed", [(20, 0.05, True), (1, 0.05, False), (20, 0.25, False)])
def test_class_balance(spark, ones, minimum, passed):
    df = spark.createDataFrame([(1,)] * ones + [(0,)] * (100 - ones), "Exited int")
    assert class_balance(df, minimum=minimum).first()["passed"] is passed


def test_missing_shares(spark):
    df = spark.createDataFrame([(None, 1)] * 20 + [(1, 1)] * 80, "A int, B int")
    out = {r["column"]: r for r in missing_share(df, 0.25).collect()}
    assert out["A"]["missing_share"] == 0.2 and out["A"]["passed"] and out["B"]["missing"] == 0
    assert not {r["column"]: r["passed"] for r in missing_share(df, 0.1).collect()}["A"]
    assert null_cells(df).first()[0] == 20


def test_duplicates_count_rows_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, 2), (1, None)], "a int, b int")
    assert duplicate_count(df).first()[0] == 2


def test_keep_first_with_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i}", i * 2) for i in range(1, 301)]
    df = spark.createDataFrame(rows, "RowNumber int, customer_uuid string, v int").repartition(4)
    out = {r["customer_uuid"]: r for r in keep_first(df).collect()}
    assert len(out) == 201 and out["hot"]["RowNumber"] == 3 and out["hot"]["v"] == 6


def test_keep_first_among_equal_numbers(spark):
    rows = [(1, "a", 5), (1, "a", 3), (None, "a", 1), (None, "b", 9)]
    out = keep_first(spark.createDataFrame(rows, "RowNumber int, customer_uuid string, v int").repartition(3))
    assert sorted((r["customer_uuid"], r["v"]) for r in out.collect()) == [("a", 3), ("b", 9)]


def test_clean(spark):
    rows = [(2, "a", 1.0, 0), (1, "a", None, 0), (3, "b", 2.0, 1), (4, "b", 3.0, 1)]
    df = spark.createDataFrame(rows, "RowNumber int, customer_uuid string, Balance double, Complain int")
    out = clean(df)
    assert set(out.columns) == {"customer_uuid", "Balance"}
    assert [tuple(r) for r in out.select("customer_uuid", "Balance").collect()] == [("b", 2.0)]


def test_required_columns_and_target(one_row):
    with pytest.raises(ValueError, match=r"\['Foo', 'Zed'\]"):
        require_columns(one_row(), ["Zed", "Age", "Foo"])
    with pytest.raises(ValueError):
        split_target(one_row(), "missing")
    x, y = split_target(one_row())
    assert "Exited" not in x.columns and y.columns == ["Exited"]
