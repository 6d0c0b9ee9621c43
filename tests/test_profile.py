import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapsewise.operators import profile as pr
from lapsewise.operators.lookup import held_if_small


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, "a", 1.0, 0), (2, "a", None, 1), (3, "b", 3.0, 1), (4, None, 3.0, 0), (5, "b", 10.0, 1), (6, "c", 0.5, 0)]
    return spark.createDataFrame(rows, "id int, g string, v double, Exited int")


def test_numeric_describe_like_pandas(small):
    want = small.toPandas()[["v", "Exited"]].describe().T
    for r in pr.numeric_describe(small, ["v", "Exited"]).collect():
        w = want.loc[r["column"]]
        got = [r[c] for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")]
        assert got == pytest.approx(w.tolist())


def test_string_describe_and_counts(small):
    r = pr.string_describe(small, ["g"]).first()
    assert tuple(r) == ("g", 5, 3, "a", 2)
    assert [tuple(x) for x in pr.value_counts(small, "g").collect()] == [("a", 2, 0.4), ("b", 2, 0.4), ("c", 1, 0.2)]
    assert {x["column"]: x["distinct"] for x in pr.distinct_counts(small).collect()} == {"id": 6, "g": 3, "v": 4, "Exited": 2}


def test_constant_columns(small):
    rows = small.withColumn("k", F.lit(1)).withColumn("n", F.lit(None).cast("string"))
    assert sorted(r["column"] for r in pr.constant_columns(rows).collect()) == ["k", "n"]


def test_correlations_like_pandas(small):
    want = small.toPandas()[["id", "v", "Exited"]].corr()
    for r in pr.corr_matrix(small, ["id", "v", "Exited"]).collect():
        assert r["correlation"] == pytest.approx(want.loc[r["row"], r["column"]])
    top = pr.target_correlation(small, n=1).collect()
    assert len(top) == 1 and abs(top[0]["correlation"]) == pytest.approx(want["Exited"].drop("Exited").abs().max())
    cov = small.toPandas()[["id", "v"]].cov()
    for r in pr.cov_matrix(small, ["id", "v"]).collect():
        assert r["covariance"] == pytest.approx(cov.loc[r["row"], r["column"]])


@pytest.mark.parametrize("limit", [100_000, 10])
def test_average_rank_with_a_frequent_value(spark, limit, monkeypatch):
    monkeypatch.setattr(pr, "held_if_small", lambda df: held_if_small(df, limit))
    values = [5.0] * 400 + [float(i) for i in range(800)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    got = {r["id"]: r["rank_share"] for r in pr.average_rank(df, "v").collect()}
    want = pd.Series(values).rank() / (len(values) + 1)
    assert len(got) == len(values) and [got[i] for i in range(len(values))] == pytest.approx(want.tolist())


def test_roles(spark):
    rows = [(i, f"u{i}", i % 2, i % 4, float(i), "x") for i in range(20)]
    df = spark.createDataFrame(rows, "CustomerId int, customer_uuid string, flag int, level int, amount double, kind string")
    roles = {r["column"]: r["role"] for r in pr.column_roles(df).collect()}
    assert roles == {
        "CustomerId": "id", "customer_uuid": "id", "flag": "binary", "level": "categorical", "amount": "numerical",
        "kind": "categorical",
    }


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 4, 5, 10)], "v double")
    assert {r["bin"]: r["n"] for r in pr.histogram(df, "v", 2).collect()} == {0: 3, 1: 2}
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [r["n"] for r in pr.histogram(same, "v", 5).collect()] == [2]


def test_crosstab_shares(small):
    out = {r["g"]: (r["Exited_0"], r["Exited_1"]) for r in pr.crosstab(small, F.col("g"), "g", normalize=True).collect()}
    assert out == {"a": (0.5, 0.5), "b": (0.0, 1.0), "c": (1.0, 0.0)}


def test_matrices_of_many_columns_with_gaps(spark):
    """200 columns, values far from 0, missing cells, groups; against numpy by pair."""
    rnd = np.random.default_rng(3)
    base = 1e6 + rnd.standard_normal((60, 200)).cumsum(axis=1)
    base[rnd.random(base.shape) < 0.1] = np.nan
    cols = [f"c{i}" for i in range(200)]
    rows = [("ab"[i % 2], *[None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(base)]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"{c} double" for c in cols)).repartition(3)
    got = {(r["g"], r["row"], r["column"]): r["covariance"] for r in pr.cov_matrix(df, cols, ["g"]).collect()}
    assert len(got) == 2 * 200 * 200
    for g, i, j in [("a", 0, 0), ("a", 3, 150), ("b", 199, 7), ("b", 20, 21)]:
        x, y = (base["ab".index(g) :: 2, k] for k in (i, j))
        both = ~np.isnan(x) & ~np.isnan(y)
        assert got[g, f"c{i}", f"c{j}"] == pytest.approx(np.cov(x[both], y[both])[0, 1], rel=1e-6)
    assert pr.corr_matrix(df.where("g = 'none'"), cols[:2]).collect() == []
    one = pr.cov_matrix(df.limit(1).select(F.lit(1.0).alias("a"), F.lit(None).cast("double").alias("b")), ["a", "b"]).collect()
    assert {(r["row"], r["column"]): r["covariance"] for r in one} == {(a, b): None for a in "ab" for b in "ab"}
