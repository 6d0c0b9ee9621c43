import uuid

import pytest
from pyspark.sql import functions as F

from lapsewise.config import Settings
from lapsewise.functions.features import add_exploration_features, add_features, target_encode
from lapsewise.functions.ids import CUSTOMER_NAMESPACE, job_id, run_id, with_customer_uuid
from lapsewise.functions.scoring import add_predictions, risk_level, stamp
from lapsewise.functions.text import capitalized, display_name, first_present, mask_pii, normalize


def test_capitalized(spark):
    cases = {
        "GOLD": "Gold", "silver": "Silver", "DiAmOnD": "Diamond", "  gold  ": "Gold", "\tsilver\n": "Silver", "": "",
        "NEW YORK": "New york", None: None,
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want string")
    assert df.where(~capitalized("raw").eqNullSafe(F.col("want"))).count() == 0


def test_normalize_renames_and_leaves_the_input(spark):
    df = spark.createDataFrame([("  GOLD", "france", "MALE", "x")], ["Card Type", "Geography", "Gender", "Other"])
    out = normalize(df)
    assert out.columns == ["CardType", "Geography", "Gender", "Other"]
    assert tuple(out.first()) == ("Gold", "France", "Male", "x")
    assert df.columns[0] == "Card Type"
    assert normalize(df, columns=["Other"]).first()["Other"] == "X"


def test_first_present(spark):
    df = spark.createDataFrame([(None, "Gold"), ("Silver", "Gold")], "`Card Type` string, CardType string")
    out = first_present(df, ["Card Type", "CardType", "Card_Type"], "card")
    assert [r["card"] for r in out.collect()] == ["Gold", "Silver"]
    with pytest.raises(ValueError):
        first_present(df, ["absent"], "card")


def test_mask_pii_in_arrays_and_maps(spark):
    df = spark.sql(
        "SELECT array(named_struct('surname', 'Abernathy', 'v', 1)) AS list, map('surname', 'Abernathy', 'city', 'Rome') AS map, "
        "map('x', array(named_struct('surname', 'Bo'))) AS deep, array(1) AS plain"
    )
    row = mask_pii(df).first()
    assert row["list"][0]["surname"] == "***athy" and row["list"][0]["v"] == 1 and row["plain"] == [1]
    assert row["map"] == {"surname": "***athy", "city": "Rome"} and row["deep"]["x"][0]["surname"] == "***"


def test_mask_pii(spark):
    df = spark.sql(
        "SELECT 15634602 AS CustomerId, 'Li' AS surname, named_struct('Email', 'ann@x.org', 'in',"
        " named_struct('token', 'abcdef', 'age', 3)) AS d, CAST(NULL AS STRING) AS phone, 1 AS Age"
    )
    row = mask_pii(df).first()
    assert row["CustomerId"] == "***4602" and row["surname"] == "***" and row["phone"] is None
    assert row["d"]["Email"] == "***.org" and row["d"]["in"]["token"] == "***cdef" and row["d"]["in"]["age"] == 3
    assert row["Age"] == 1


@pytest.mark.parametrize(
    "raw, shown",
    [
        ("cat__Geography_Germany", "Geography Germany"),
        ("num__NumOfProducts", "Num Of Products"),
        ("m__balance_per_product", "Balance Per Product"),
        ("HasCrCard", "Has Cr Card"),
    ],
)
def test_display_name(spark, raw, shown):
    assert spark.range(1).select(display_name(F.lit(raw))).first()[0] == shown


def test_uuid5_equals_the_standard_library(spark):
    ids = [0, 7, 15634602, 2**40]
    rows = with_customer_uuid(spark.createDataFrame([(i,) for i in ids], "CustomerId long")).collect()
    space = uuid.UUID(CUSTOMER_NAMESPACE)
    assert [r["customer_uuid"] for r in rows] == [str(uuid.uuid5(space, str(i))) for i in ids]
    with pytest.raises(ValueError):
        with_customer_uuid(spark.range(1))


def test_run_and_job_ids(spark):
    at = F.lit("2025-12-20 20:10:26.847392").cast("timestamp")
    row = spark.range(1).select(run_id("ingestion", True, at), run_id("training", False, at), job_id()).first()
    assert row[0] == "ingestion_20251220_201026_847392"
    assert row[1] == "training_20251220_201026"
    assert uuid.UUID(row[2]).version == 4


def test_features(spark):
    rows = [
        (30, 3, 50000.0, 2, 75000.0), (45, 5, 100000.0, 1, 150000.0), (60, 8, 0.0, 0, 50000.0), (0, 1, 1.0, 1, 1.0),
        (35, 0, 150000.0, 3, 150000.0), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "Age int, Tenure int, Balance double, NumOfProducts int, EstimatedSalary double")
    out = add_features(df).collect()
    assert [r["balance_per_product"] for r in out] == [25000.0, 100000.0, 0.0, 1.0, 50000.0, 0.0]
    assert [round(r["tenure_age_ratio"], 4) for r in out] == [0.1, 0.1111, 0.1333, 0.0, 0.0, 0.0]
    assert [r["is_zero_balance"] for r in out] == [0, 0, 1, 0, 0, 0]
    assert [r["high_value_customer"] for r in out] == [0, 0, 0, 0, 1, 0]
    assert [r["age_group"] for r in out] == ["young", "middle", "senior", None, "young", None]


def test_exploration_bands(spark):
    df = spark.createDataFrame(
        [(a, 5, 0.0, 1, 0.0, 0, c) for a, c in ((29, 580), (30, 581), (99, 800), (100, 850))],
        "Age int, Tenure int, Balance double, NumOfProducts int, EstimatedSalary double, IsActiveMember int, CreditScore int",
    )
    out = add_exploration_features(df).collect()
    assert [r["AgeGroup"] for r in out] == ["<30", "30-40", "80+", None]
    assert [r["CreditScoreBand"] for r in out] == ["Poor", "Fair", "VeryGood", "Excellent"]
    assert all(r["BalanceToSalaryRatio"] is None and r["InactiveLongTenure"] for r in out)
    assert [r["SeniorSingleProduct"] for r in out] == [False, False, True, True]


def test_target_encode_fits_on_the_given_rows_only(spark):
    train = spark.createDataFrame([("France", 1), ("France", 0), ("Spain", 0)], "Geography string, Exited int")
    rows = spark.createDataFrame([("France",), ("Spain",), ("Germany",)], "Geography string")
    out = {r[0]: r[1] for r in target_encode(train, rows, "Geography").collect()}
    assert out == {"France": 0.5, "Spain": 0.0, "Germany": None}


def test_risk_levels_and_predictions(spark):
    ps = [0.1, 0.4, 0.69, 0.7, 0.95, 1.2, -0.1]
    df = spark.createDataFrame([(p,) for p in ps], "raw double")
    out = add_predictions(df, F.col("raw")).collect()
    assert [r["risk_level"] for r in out] == ["low", "medium", "medium", "high", "high", "high", "low"]
    assert [r["probability"] for r in out][-2:] == [1.0, 0.0]
    assert [r["prediction"] for r in out] == [0, 0, 1, 1, 1, 1, 0]
    assert df.select(risk_level("raw").alias("l")).first()["l"] == "low"
    assert stamp(df, "production", "3").first()["model_version"] == "3"


@pytest.mark.parametrize(
    "bad",
    [
        {"test_size": 0.6, "val_size": 0.5}, {"top_k_percent": 0.0}, {"prediction_threshold": 1.0},
        {"min_minority_share": 0.6}, {"max_missing_share": 1.5},
    ],
)
def test_settings_ranges(bad):
    with pytest.raises(ValueError):
        Settings(**bad)


def test_settings_defaults():
    s = Settings()
    assert (s.seed, s.test_size, s.val_size, s.top_k_percent) == (529, 0.2, 0.2, 0.15)


def test_missing_scores_stay_missing(spark):
    from pyspark.sql import functions as F

    from lapsewise.functions.scoring import add_predictions

    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, 1.5), (4, -1.0)], "k int, s double")
    rows = {r.k: r for r in add_predictions(df, F.col("s")).collect()}
    assert [(rows[k].probability, rows[k].prediction, rows[k].risk_level) for k in (1, 2)] == [(None, None, None)] * 2
    assert (rows[3].probability, rows[3].prediction, rows[4].probability) == (1.0, 1, 0.0)
