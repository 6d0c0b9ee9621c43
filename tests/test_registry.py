"""Registered queries against their SQL twins on the smallest data set."""

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

SAMPLE = [
    "snapshot", "features", "risk_rank", "all_metrics", "metrics_by_segment", "numeric_describe", "psi", "column_drift",
    "cleaned", "raw_validation_report", "upsert_customers", "stratified_split", "recommendations", "avg_rank",
]


def test_every_twin_has_a_query():
    from lapsewise.plans.oracles import ORACLES

    assert set(ORACLES) <= set(queries())
    assert len(oracle_sql()) > 100


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["customer_uuid", "probability", "risk_rank"] and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_twin(spark, name, sf_dir):
    assert check.compare(spark, check.tables(sf_dir), name, sf_dir).startswith("ok")
