"""Customer snapshot derived from the ``customer`` and ``orders`` tables.

One row per customer as of a cut-off date: profile columns, behaviour read from
the orders before the cut-off, a rule-of-thumb score and a label drawn from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.functions.ids import with_customer_uuid
from lapsewise.functions.scoring import risk_score

CUTOFF = "2000-08-01"
ACTIVE_FROM = "2000-02-01"


def order_activity(orders: DataFrame) -> DataFrame:
    """Per customer, in one pass and one shuffle (no distinct aggregate:
    the five priorities are kept as bits)."""
    before = f"o_orderdate < timestamp '{CUTOFF}'"
    recent = f"{before} AND o_orderdate >= timestamp '{ACTIVE_FROM}'"
    bit = "shiftleft(1, CAST(substring(o_orderpriority, 1, 1) AS INT))"
    return orders.groupBy("o_custkey").agg(
        F.expr("min(year(o_orderdate)) AS first_year"),
        F.expr(f"bit_count(bit_or(IF({before}, {bit}, 0))) AS priorities"),
        F.expr(f"max(IF({recent}, 1, 0)) AS active"),
        F.expr(f"min(o_totalprice) FILTER (WHERE {before}) + max(o_totalprice) FILTER (WHERE {before}) AS spend"),
        F.expr(f"max(IF({before}, 0, 1)) AS returned"),
        F.expr(f"max(IF({before}, 1, 0)) AS known"),
    )


def customer_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    activity = order_activity(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    base = customer.join(activity, F.col("c_custkey") == F.col("o_custkey"), "left").selectExpr(
        "c_custkey + 1 AS RowNumber",
        "c_custkey + 15600000 AS CustomerId",
        "c_name AS Surname",
        "CAST(300 + (c_custkey * 7919) % 551 AS INT) AS CreditScore",
        "CASE c_nationkey % 3 WHEN 0 THEN 'France' WHEN 1 THEN 'Spain' ELSE 'Germany' END AS Geography",
        "IF(c_custkey % 2 = 0, 'Female', 'Male') AS Gender",
        "CAST(18 + (c_custkey * 37) % 75 AS INT) AS Age",
        "least(10, greatest(0, 2000 - coalesce(first_year, 2000))) AS Tenure",
        "round(greatest(c_acctbal, 0D) * 25, 2) AS Balance",
        "least(4, greatest(1, coalesce(CAST(priorities AS INT), 1) - 1)) AS NumOfProducts",
        "CAST(c_custkey % 10 < 7 AS INT) AS HasCrCard",
        "coalesce(active, 0) AS IsActiveMember",
        "round(least(200000D, coalesce(spend, 0D) * 0.2D), 2) AS EstimatedSalary",
        "CAST(100 + (c_custkey * 53) % 900 AS INT) AS PointEarned",
        "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Silver' WHEN 'BUILDING' THEN 'Gold'"
        " WHEN 'MACHINERY' THEN 'Diamond' ELSE 'Platinum' END AS CardType",
        "1 - coalesce(returned, 0) AS Lapsed",
        "coalesce(known, 0) AS known",
        "c_acctbal AS acctbal",
    )
    scored = base.withColumn("p", risk_score()).withColumn(
        "u", F.expr("CAST(conv(substring(md5(concat(CustomerId, ':label')), 1, 8), 16, 10) AS BIGINT) / 4294967296D")
    )
    return with_customer_uuid(scored.withColumn("Exited", F.expr("CAST(u < (p - 0.5D) * 0.85D AS INT)")))


FILE_COLUMNS = (
    "RowNumber",
    "CustomerId",
    "Surname",
    "CreditScore",
    "Geography",
    "Gender",
    "Age",
    "Tenure",
    "Balance",
    "NumOfProducts",
    "HasCrCard",
    "IsActiveMember",
    "EstimatedSalary",
    "Exited",
    "Complain",
    "Satisfaction Score",
    "Card Type",
    "Point Earned",
)


def raw_customers(snapshot: DataFrame) -> DataFrame:
    """The snapshot as the raw file delivers it: old headers, untidy categories."""
    return (
        snapshot.withColumns(
            {
                "Complain": F.col("Exited"),
                "Satisfaction Score": (1 + F.col("CustomerId") % 5).cast("int"),
                "Geography": F.when(
                    F.col("Gender") == "Female", F.concat(F.lit("  "), F.upper("Geography"), F.lit("\t"))
                ).otherwise(F.col("Geography")),
            }
        )
        .withColumnsRenamed({"CardType": "Card Type", "PointEarned": "Point Earned"})
        .select(*[f"`{c}`" for c in FILE_COLUMNS])
    )


def dirty_customers(snapshot: DataFrame) -> DataFrame:
    """The raw file with the faults ingestion has to catch.

    Overdrawn accounts lose their balance, the best scores run past the allowed
    range, Spanish Platinum customers are filed under Italy, and active Gold
    customers are delivered twice.
    """
    faulty = snapshot.withColumns(
        {
            "Balance": F.when(F.col("acctbal") >= 0, F.col("Balance")),
            "CreditScore": F.when(F.col("CreditScore") > 840, F.col("CreditScore") + 50).otherwise(F.col("CreditScore")),
            "Geography": F.when(
                (F.col("CardType") == "Platinum") & (F.col("Geography") == "Spain"), "Italy"
            ).otherwise(F.col("Geography")),
        }
    )
    copies = F.when(
        (F.col("IsActiveMember") == 1) & (F.col("CardType") == "Gold"), F.array(F.lit(0), F.lit(1000000000000))
    ).otherwise(F.array(F.lit(0).cast("long")))
    twice = faulty.withColumn("copy", F.explode(copies)).withColumn("RowNumber", F.col("RowNumber") + F.col("copy"))
    return raw_customers(twice)


def spoiled_customers(snapshot: DataFrame) -> DataFrame:
    """The raw file as text with cells that do not fit their column: ages of Diamond
    customers without a card, balances of women with three products, and half products of
    customers past 85."""
    rows = raw_customers(snapshot)
    text = rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns])
    no_card, woman = (F.col("HasCrCard") == "0") & (F.col("`Card Type`") == "Diamond"), (F.col("Gender") == "Female") & (F.col("NumOfProducts") == "3")
    return text.withColumns(
        {
            "NumOfProducts": F.when(F.col("Age").cast("int") > 85, "2.5").otherwise(F.col("NumOfProducts")),
            "Balance": F.when(woman, "12,5x").otherwise(F.col("Balance")),
            "Age": F.when(no_card, "abc").otherwise(F.col("Age")),
        }
    )


def shifted_customers(snapshot: DataFrame) -> DataFrame:
    """The same customers after a change of mix, scored again: the current side of
    a drift check. Labels stay as they were."""
    moved = snapshot.withColumns(
        {
            "Age": F.least(F.lit(102), F.col("Age") + 5),
            "Balance": F.least(F.lit(249999.75), F.round(F.col("Balance") * 1.35, 2)),
            "Geography": F.when(F.col("CardType") == "Gold", "Germany").otherwise(F.col("Geography")),
        }
    )
    return moved.withColumn("p", risk_score())
