"""The order-statistics operators against brute force, with blocks forced small."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapsewise.operators import ordered
from lapsewise.operators.ordered import positions, quantiles, running, value_points
from lapsewise.operators.topk import run_summary, top_k


@pytest.fixture(scope="module")
def skewed():
    """3,000 rows of which a third share one value; two groups, one holding most rows."""
    rng = np.random.default_rng(7)
    v = np.round(rng.normal(50, 20, 3000), 1)
    v[:1000] = 42.0
    rng.shuffle(v)
    g = np.where(rng.random(3000) < 0.8, "a", "b")
    return [(int(i), str(g[i]), float(v[i])) for i in range(3000)]


@pytest.mark.parametrize("per_block", [1 << 18, 25])
def test_quantiles_are_exact(spark, skewed, per_block):
    df = spark.createDataFrame(skewed, "id long, g string, v double")
    probs = [0.0, 0.1, 0.25, 0.3333, 0.5, 0.9, 1.0]
    out = {(r["g"], r["prob"]): r["quantile"] for r in quantiles(df, ["v"], probs, ["g"], per_block).collect()}
    for g in "ab":
        values = [r[2] for r in skewed if r[1] == g]
        for p in probs:
            assert out[g, p] == pytest.approx(np.quantile(values, p), abs=1e-9)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_across_blocks(spark, skewed, descending):
    df = spark.createDataFrame(skewed, "id long, g string, v double")
    points = value_points(df, ["v"], {"n": F.lit(1)}, values_per_block=25)
    assert points.select("block").distinct().count() > 5
    run = running(points, ["column"], "value", ["n"], descending, following="next").collect()
    values = sorted({r[2] for r in skewed}, reverse=descending)
    after = dict(zip(values, [*values[1:], None]))
    for r in run:
        before = [x for x in skewed if (x[2] >= r["value"] if descending else x[2] <= r["value"])]
        assert r["cum_n"] == len(before) and r["total_n"] == 3000
        assert r["next"] == after[r["value"]]


@pytest.mark.parametrize("digits", [6, None])
@pytest.mark.parametrize("key", ["long", "string", "prefixed", "decimal", "double"])
def test_positions_with_a_third_of_rows_tied(spark, skewed, digits, key):
    df = spark.createDataFrame(skewed, "id long, g string, v double")
    # Ids far apart, so that a tie spreads over many key blocks.
    spread = {
        "long": F.col("id") * 40_000,
        "string": F.md5(F.col("id").cast("string")),
        "prefixed": F.concat(F.lit("KUNDE-é-"), F.col("id").cast("string")),
        "decimal": (2999 - F.col("id")).cast("decimal(10,0)"),
        "double": F.col("id") / 7000,
    }
    rows = df.withColumn("k", spread[key])
    out = positions(rows, "v", "k", ["g"], digits=digits).collect()
    for g in "ab":
        mine = sorted((r["position"], r["k"]) for r in out if r["g"] == g)
        want = sorted((r for r in rows.collect() if r["g"] == g), key=lambda r: (-r["v"], r["k"]))
        assert mine == [(i + 1, r["k"]) for i, r in enumerate(want)]


@pytest.mark.parametrize("per_block", [1 << 18, 100])
def test_top_k_cuts_inside_the_tie(spark, skewed, per_block, monkeypatch):
    monkeypatch.setattr(ordered, "VALUES_PER_BLOCK", per_block)
    df = spark.createDataFrame(skewed, "id long, g string, v double")
    want = sorted(skewed, key=lambda r: (-r[2], r[0]))
    for args in ({"pct": 0.5}, {"pct": 0.0}, {"k": 17}, {"k": 20_000}, {}):
        n = len(skewed)
        k = min(args["k"], n) if "k" in args else max(1, int(n * args.get("pct", 0.15)))
        out = sorted((r["risk_rank"], r["id"]) for r in top_k(df, "v", "id", **args).collect())
        assert out == [(i + 1, r[0]) for i, r in enumerate(want[:k])]
    for bad in ({"k": 0}, {"pct": 1.5}):
        with pytest.raises(ValueError):
            top_k(df, "v", "id", **bad)


def test_a_tie_is_split_whatever_its_keys(spark):
    """A third of the rows share a score, under keys with a long common start and a stray one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / 9000).alias("v"), F.concat(F.lit("CUSTOMER-2024-REGION-"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("k"))
        rows = rows.union(spark.createDataFrame([(0.5, "zz")], rows.schema))
        placed = ordered.numbered(rows, [F.desc("v"), "k"])
        sizes = [r["count"] for r in placed.where("v = 0.5").groupBy("_task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 0.8 * sum(sizes)


def test_bins_never_decrease_with_the_score(spark):
    inf = float("inf")
    values = sorted({s * m * 2.0**e for s in (-1, 1) for e in (-1074, -1022, -3, -1, 0, 1, 52, 1000) for m in (1.0, 1.0000001, 1.5, 1.9999999)} | {0.0, inf, -inf, 0.1, 0.3})
    got = [r["b"] for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", ordered.score_bin(F.col("v")).alias("b")).orderBy("v").collect()]
    assert got == sorted(got) and len(set(got)) > 40


def test_missing_scores_and_summary(spark):
    rows = [("a", 0.9), ("b", float("nan")), ("c", None), ("d", 0.2)]
    df = spark.createDataFrame(rows, "k string, p double")
    listed = top_k(df, "p", "k", pct=0.5).collect()
    summary = run_summary(df, "p", 0.5).first()
    assert [r["k"] for r in listed] == ["a"]
    assert (summary["total_scored"], summary["top_k"], summary["top_share"]) == (2, 1, 0.5)
    none = run_summary(df.where("p > 1"), "p", 0.5).first()
    assert (none["total_scored"], none["top_k"], none["top_share"]) == (0, 0, 0.0)


def test_no_single_task_over_rows(spark, customers, monkeypatch):
    """Ranking a large table gathers no row-level data in one partition."""
    monkeypatch.setattr(ordered, "VALUES_PER_BLOCK", 10)
    plan = top_k(customers, pct=0.3)._jdf.queryExecution().executedPlan().toString()
    gathered = plan.split("SinglePartition")[1:]
    # Only block totals: their partial aggregate comes right below.
    assert gathered and all("HashAggregate" in part.splitlines()[1] for part in gathered)
    assert "TakeOrdered" not in plan and "CartesianProduct" not in plan


def test_top_k_ranks_scores_as_they_are(spark):
    rows = [("a", 0.1234561), ("b", 0.1234564), ("c", None), ("d", 0.1)]
    df = spark.createDataFrame(rows, "k string, s double")
    assert [(r["k"], r["risk_rank"]) for r in top_k(df, "s", "k", k=2).orderBy("risk_rank").collect()] == [("b", 1), ("a", 2)]
    assert top_k(df.where("s > 1"), "s", "k", k=2).count() == 0
    assert top_k(df.where("s IS NULL"), "s", "k").count() == 0
