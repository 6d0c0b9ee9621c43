import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def customers(spark):
    """The snapshot of the smallest data set, scored, written once."""
    from lapsewise.functions.scoring import add_predictions
    from lapsewise.plans.snapshot import customer_snapshot
    from lapsewise.sources.scratch import stored
    from pyspark.sql import functions as F

    return stored(add_predictions(customer_snapshot(spark, SF_DIR), F.col("p")), "customers")


@pytest.fixture
def one_row(spark):
    """A valid raw customer row with replaceable fields."""

    def make(**changes):
        row = {
            "RowNumber": 418, "CustomerId": 15600417, "Surname": "Okafor", "CreditScore": 731, "Geography": "Spain",
            "Gender": "Female", "Age": 52, "Tenure": 9, "Balance": 120.25, "NumOfProducts": 3, "HasCrCard": 0,
            "IsActiveMember": 1, "EstimatedSalary": 33010.5, "PointEarned": 641, "CardType": "Silver", "Exited": 1,
        }
        row.update(changes)
        return spark.createDataFrame([tuple(row.values())], list(row))

    return make
