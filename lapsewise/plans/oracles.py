"""SQL twins of the registered queries, for an independent engine on the same tables."""

from __future__ import annotations

from lapsewise.functions.ids import CUSTOMER_NAMESPACE
from lapsewise.functions.scoring import RISK_WEIGHTS
from lapsewise.operators.explain import ACTIONS, FALLBACKS, NO_ACTION

ORACLES: dict[str, str] = {}

NUMERIC = ["CreditScore", "Age", "Tenure", "Balance", "NumOfProducts", "EstimatedSalary", "PointEarned"]
TEXT = ["Geography", "Gender", "CardType"]
BASE = ["CreditScore", "Age", "Tenure", "Balance", "NumOfProducts", "EstimatedSalary", "HasCrCard", "IsActiveMember"]

_LOGIT = (
    "0.03::DOUBLE * Age + 0.000002::DOUBLE * Balance + (-1.2)::DOUBLE * IsActiveMember"
    " + 0.2::DOUBLE * CAST(NumOfProducts = 1 AS INTEGER)"
)
_P = f"round(1::DOUBLE / (1::DOUBLE + exp(-({_LOGIT}))), 6)"
_NS = CUSTOMER_NAMESPACE.replace("-", "")

SNAP = f"""
act AS (
  SELECT o_custkey,
    min(year(o_orderdate)) AS first_year,
    count(DISTINCT CASE WHEN o_orderdate < TIMESTAMP '2000-08-01' THEN o_orderpriority END) AS priorities,
    max(CASE WHEN o_orderdate >= TIMESTAMP '2000-02-01' AND o_orderdate < TIMESTAMP '2000-08-01' THEN 1 ELSE 0 END) AS active,
    min(CASE WHEN o_orderdate < TIMESTAMP '2000-08-01' THEN o_totalprice END)
      + max(CASE WHEN o_orderdate < TIMESTAMP '2000-08-01' THEN o_totalprice END) AS spend,
    max(CASE WHEN o_orderdate >= TIMESTAMP '2000-08-01' THEN 1 ELSE 0 END) AS returned,
    max(CASE WHEN o_orderdate < TIMESTAMP '2000-08-01' THEN 1 ELSE 0 END) AS known
  FROM orders GROUP BY o_custkey),
snap0 AS (
  SELECT c_custkey + 1 AS RowNumber, c_custkey + 15600000 AS CustomerId, c_name AS Surname,
    CAST(300 + (c_custkey * 7919) % 551 AS INTEGER) AS CreditScore,
    CASE c_nationkey % 3 WHEN 0 THEN 'France' WHEN 1 THEN 'Spain' ELSE 'Germany' END AS Geography,
    CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS Gender,
    CAST(18 + (c_custkey * 37) % 75 AS INTEGER) AS Age,
    CAST(least(10, greatest(0, 2000 - coalesce(first_year, 2000))) AS INTEGER) AS Tenure,
    round(greatest(c_acctbal, 0::DOUBLE) * 25, 2) AS Balance,
    CAST(least(4, greatest(1, coalesce(priorities, 1) - 1)) AS INTEGER) AS NumOfProducts,
    CAST(c_custkey % 10 < 7 AS INTEGER) AS HasCrCard,
    CAST(coalesce(active, 0) AS INTEGER) AS IsActiveMember,
    round(least(200000::DOUBLE, coalesce(spend, 0) * 0.2::DOUBLE), 2) AS EstimatedSalary,
    CAST(100 + (c_custkey * 53) % 900 AS INTEGER) AS PointEarned,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Silver' WHEN 'BUILDING' THEN 'Gold' WHEN 'MACHINERY' THEN 'Diamond'
      ELSE 'Platinum' END AS CardType,
    CAST(1 - coalesce(returned, 0) AS INTEGER) AS Lapsed, coalesce(known, 0) AS known, c_acctbal AS acctbal,
    sha1(unhex('{_NS}') || encode(CAST(c_custkey + 15600000 AS VARCHAR))) AS h
  FROM customer LEFT JOIN act ON c_custkey = o_custkey),
snap1 AS (
  SELECT *, {_P} AS p,
    CAST(CAST('0x' || substr(md5(CustomerId || ':label'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u
  FROM snap0),
snap AS (
  SELECT *, CAST(u < (p - 0.5::DOUBLE) * 0.85::DOUBLE AS INTEGER) AS Exited,
    substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
      || substr('89ab89ab89ab89ab', CAST('0x' || substr(h, 17, 1) AS INTEGER) + 1, 1) || substr(h, 18, 3) || '-'
      || substr(h, 21, 12) AS customer_uuid
  FROM snap1)"""

RAW = f"""{SNAP},
raw AS (
  SELECT RowNumber, CustomerId, Surname, CreditScore,
    CASE WHEN Gender = 'Female' THEN '  ' || upper(Geography) || chr(9) ELSE Geography END AS Geography,
    Gender, Age, Tenure, Balance, NumOfProducts, HasCrCard, IsActiveMember, EstimatedSalary, Exited,
    Exited AS Complain, CAST(1 + CustomerId % 5 AS INTEGER) AS "Satisfaction Score",
    CardType AS "Card Type", PointEarned AS "Point Earned"
  FROM snap)"""

DIRTY = f"""{SNAP},
faulty AS (
  SELECT * REPLACE (
    CASE WHEN acctbal >= 0 THEN Balance END AS Balance,
    CASE WHEN CreditScore > 840 THEN CreditScore + 50 ELSE CreditScore END AS CreditScore,
    CASE WHEN CardType = 'Platinum' AND Geography = 'Spain' THEN 'Italy' ELSE Geography END AS Geography)
  FROM snap),
dirty AS (
  SELECT RowNumber, CustomerId, Surname, CreditScore, Geography, Gender, Age, Tenure, Balance, NumOfProducts,
    HasCrCard, IsActiveMember, EstimatedSalary, Exited, Exited AS Complain,
    CAST(1 + CustomerId % 5 AS INTEGER) AS "Satisfaction Score", CardType, PointEarned, customer_uuid
  FROM (SELECT * FROM faulty
        UNION ALL
        SELECT * REPLACE (RowNumber + 1000000000000 AS RowNumber) FROM faulty
        WHERE IsActiveMember = 1 AND CardType = 'Gold'))"""

SHIFT = f"""{SNAP},
moved AS (
  SELECT * REPLACE (
    CAST(least(102, Age + 5) AS INTEGER) AS Age,
    least(249999.75::DOUBLE, round(Balance * 1.35::DOUBLE, 2)) AS Balance,
    CASE WHEN CardType = 'Gold' THEN 'Germany' ELSE Geography END AS Geography)
  FROM snap),
cur AS (SELECT * REPLACE ({_P} AS p) FROM moved)"""

LEVEL = "CASE WHEN p >= 0.7::DOUBLE THEN 'high' WHEN p >= 0.4::DOUBLE THEN 'medium' ELSE 'low' END"


def add(name: str, body: str, ctes: str = SNAP, doubles: str = "") -> None:
    """Register a twin; the named double columns are rounded to six places."""
    if doubles:
        cuts = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in doubles.split())
        body = f"SELECT * REPLACE ({cuts}) FROM ({body}) AS q"
    ORACLES[name] = f"WITH {ctes.strip()}\n{body}" if ctes else body


def stacked(columns: list[str], row: str, source: str, cast: str = "DOUBLE") -> str:
    """The columns of a source side by side as rows of text name and value."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS col, CAST({c} AS {cast}) AS v{row} FROM {source}" for c in columns
    )


# ---- sources and sinks
add(
    "snapshot",
    "SELECT RowNumber, CustomerId, Surname, CreditScore, Geography, Gender, Age, Tenure, Balance, NumOfProducts,"
    " HasCrCard, IsActiveMember, EstimatedSalary, PointEarned, CardType, Lapsed, p, u, Exited, customer_uuid FROM snap",
    doubles="Balance EstimatedSalary p u",
)
add("csv_round_trip", "SELECT * FROM raw", RAW, "Balance EstimatedSalary")
add("parquet_columns", "SELECT CustomerId, Balance, Exited FROM snap", doubles="Balance")
add(
    "sql_with_parameters",
    "SELECT CustomerId, Balance FROM snap WHERE Geography = 'Germany' AND Balance >= 100000",
    doubles="Balance",
)
add(
    "source_by_suffix",
    "SELECT CustomerId, Age, Balance, kind FROM snap, (VALUES ('csv'), ('parquet'), ('sql')) AS k(kind)",
    doubles="Balance",
)
add(
    "sql_over_files",
    "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS acctbal"
    " FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "",
)
_UPSERT = """
SELECT s.customer_uuid, CustomerId AS bank_customer_id, Surname AS surname,
  CASE WHEN Lapsed = 0 THEN 'ingestion_second' ELSE 'ingestion_first' END AS ingestion_run_id,
  CASE WHEN known = 1 THEN TIMESTAMP '2000-08-01' ELSE TIMESTAMP '2001-08-02' END AS created_at,
  CASE WHEN Lapsed = 0 THEN TIMESTAMP '2001-08-02' ELSE TIMESTAMP '2000-08-01' END AS updated_at
FROM snap s WHERE known = 1 OR Lapsed = 0"""
add("upsert_customers", _UPSERT)
add("stream_upserted", _UPSERT)
add(
    "ingestion_two_deliveries",
    "SELECT customer_uuid, CustomerId AS bank_customer_id, Surname AS surname, CASE WHEN Lapsed = 0 THEN 2 ELSE 1 END AS delivery,"
    " known = 1 AND Lapsed = 0 AS changed FROM snap WHERE known = 1 OR Lapsed = 0",
)
add(
    "ingestion_log",
    "SELECT 1 AS delivery, 'completed' AS status, count(*) AS rows_processed, CAST(NULL AS BOOLEAN) AS invalid FROM snap WHERE known = 1"
    " UNION ALL SELECT 2, 'completed', count(*), NULL FROM snap WHERE Lapsed = 0"
    " UNION ALL SELECT 3, 'failed', NULL, true",
)
# Cells that do not fit, and the text that stands in them.
_SPOILED = {
    "Age": ("HasCrCard = 0 AND CardType = 'Diamond'", "abc"),
    "Balance": ("Gender = 'Female' AND NumOfProducts = 3", "12,5x"),
    "NumOfProducts": ("Age > 85", "2.5"),
}
add(
    "rejected_cells_report",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", 'type' AS \"check\", count(*) FILTER ({bad}) AS failures FROM snap" for c, (bad, _) in _SPOILED.items()
    )
    + ") WHERE failures > 0",
)
add(
    "ingestion_quarantine",
    " UNION ALL ".join(
        f"SELECT CustomerId, '{c}' AS \"column\", '{text}' AS cell FROM snap WHERE {bad}" for c, (bad, text) in _SPOILED.items()
    ),
)
_BAD = " OR ".join(f"({bad})" for bad, _ in _SPOILED.values())
add(
    "stream_rejected",
    f"SELECT CustomerId, CASE WHEN {_BAD} THEN 'rejected' ELSE 'scored' END AS status, count(*) OVER () AS rows_seen,"
    f" count(*) FILTER ({_BAD}) OVER () AS rows_rejected FROM snap",
)
add(
    "job_latest_state",
    "SELECT job_id, event_ts, run_id, status FROM (SELECT o_custkey AS job_id, o_orderdate AS event_ts,"
    " o_orderkey AS run_id, o_orderstatus AS status,"
    " row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)"
    " WHERE rn = 1",
    "",
)
add(
    "table_write_modes",
    "SELECT customer_uuid, CAST(1 + known AS BIGINT) AS copies, false AS before, true AS during, false AS after, true AS refused FROM snap",
)
add("job_ids", "SELECT customer_uuid, true AS well_formed, count(*) OVER () AS distinct_ids FROM snap")
add("table_write", "SELECT customer_uuid, CAST(2 AS BIGINT) AS copies FROM snap")

add(
    "ingestion_job",
    "SELECT CreditScore, Geography, Gender, Age, Tenure, Balance, NumOfProducts, HasCrCard, IsActiveMember,"
    " EstimatedSalary, Exited, CardType, PointEarned, customer_uuid FROM snap",
    doubles="Balance EstimatedSalary",
)
add(
    "customer_documents",
    "SELECT customer_uuid, CAST(to_json({'RowNumber': RowNumber, 'CustomerId': CustomerId, 'Surname': Surname,"
    " 'CreditScore': CreditScore, 'Geography': Geography, 'Gender': Gender, 'Age': Age, 'Tenure': Tenure,"
    " 'Balance': Balance, 'NumOfProducts': NumOfProducts, 'HasCrCard': HasCrCard, 'IsActiveMember': IsActiveMember,"
    " 'EstimatedSalary': EstimatedSalary, 'Exited': Exited, 'Complain': Exited,"
    " 'Satisfaction Score': CAST(1 + CustomerId % 5 AS INTEGER), 'CardType': CardType, 'PointEarned': PointEarned})"
    " AS VARCHAR) AS raw_data FROM snap",
)

# ---- projections and filters
_NORM = (
    "SELECT * REPLACE (upper(substr(trim(Geography, chr(9) || ' '), 1, 1))"
    " || lower(substr(trim(Geography, chr(9) || ' '), 2)) AS Geography)"
    ' RENAME ("Card Type" AS CardType, "Point Earned" AS PointEarned) FROM raw'
)
add("normalized", _NORM, RAW, "Balance EstimatedSalary")
add("header_alias", 'SELECT CustomerId, "Card Type" AS card FROM raw', RAW)
add(
    "without_leakage",
    "SELECT CreditScore, Geography, Gender, Age, Tenure, Balance, NumOfProducts, HasCrCard, IsActiveMember,"
    " EstimatedSalary, Exited, CardType, PointEarned FROM snap",
    doubles="Balance EstimatedSalary",
)
add("customer_uuid", "SELECT CustomerId, customer_uuid FROM snap")
add(
    "pii_masked",
    "SELECT '***' || right(CAST(CustomerId AS VARCHAR), 4) AS CustomerId, '***' || right(Surname, 4) AS Surname, Age,"
    " '***' || right(Surname, 4) AS inner_surname, Geography FROM snap",
)
add(
    "request_features",
    "SELECT CreditScore, Geography, Gender, Age, Tenure, Balance, NumOfProducts, HasCrCard, IsActiveMember,"
    " EstimatedSalary, CardType FROM snap",
    doubles="Balance EstimatedSalary",
)
add(
    "features_and_target",
    "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS features, CAST(sum(Exited) AS BIGINT) AS positives FROM snap",
)
add(
    "columns_by_type",
    "SELECT count(*) AS rows, 'Age,Balance,CreditScore,CustomerId,EstimatedSalary,Exited,HasCrCard,IsActiveMember,"
    "Lapsed,NumOfProducts,PointEarned,RowNumber,Tenure,acctbal,known,p,u' AS numeric,"
    " 'CardType,Gender,Geography,Surname,customer_uuid' AS text FROM snap",
)
add(
    "coerced_values",
    "SELECT CustomerId, CASE WHEN Balance <> 0 THEN Balance END AS Balance,"
    " CASE WHEN Age % 2 = 0 THEN CAST(Age / 2 AS INTEGER) END AS Age FROM snap",
    doubles="Balance",
)
add(
    "stamped_scores",
    f"SELECT customer_uuid, p AS probability, CAST(p >= 0.5::DOUBLE AS INTEGER) AS prediction, {LEVEL} AS risk_level,"
    " 'production' AS model_stage, '7' AS model_version, 'scoring_20010802_063000' AS run_id FROM snap",
)
add("low_credit_count", "SELECT count(*) AS customers FROM snap WHERE CreditScore <= 400")
add(
    "selected_customers",
    "SELECT customer_uuid, Age, Geography, Balance, p FROM snap WHERE Age BETWEEN 30 AND 50"
    " AND Geography IN ('France', 'Spain') AND NOT Balance = 0 AND (p >= 0.7::DOUBLE OR NumOfProducts >= 3)",
    doubles="Balance",
)
add(
    "complete_rows",
    "SELECT RowNumber, customer_uuid, Balance FROM dirty WHERE Balance IS NOT NULL",
    DIRTY,
    "Balance",
)

# ---- features
_AGE_GROUP = "CASE WHEN Age <= 0 THEN NULL WHEN Age <= 35 THEN 'young' WHEN Age <= 55 THEN 'middle' WHEN Age <= 100 THEN 'senior' END"
add(
    "features",
    "SELECT customer_uuid, CASE WHEN NumOfProducts > 0 THEN Balance / NumOfProducts ELSE 0 END AS balance_per_product,"
    " CASE WHEN Age > 0 THEN Tenure / Age ELSE 0 END AS tenure_age_ratio,"
    " CAST(Balance = 0 AS INTEGER) AS is_zero_balance,"
    " CAST(Balance > 100000 AND EstimatedSalary > 100000 AS INTEGER) AS high_value_customer,"
    f" {_AGE_GROUP} AS age_group FROM snap",
    doubles="balance_per_product tenure_age_ratio",
)
add(
    "notebook_features",
    "SELECT customer_uuid, CASE WHEN Age < 30 THEN '<30' WHEN Age < 40 THEN '30-40' WHEN Age < 50 THEN '40-50'"
    " WHEN Age < 60 THEN '50-60' WHEN Age < 70 THEN '60-70' WHEN Age < 80 THEN '70-80' WHEN Age < 100 THEN '80+' END AS AgeGroup,"
    " Balance > 100000 AND EstimatedSalary > 100000 AS HighValueCustomer,"
    " CASE WHEN NumOfProducts > 0 THEN Balance / NumOfProducts ELSE 0 END AS BalancePerProduct,"
    " CASE WHEN EstimatedSalary > 0 THEN Balance / EstimatedSalary END AS BalanceToSalaryRatio,"
    " NumOfProducts = 1 AS IsSingleProduct, NumOfProducts >= 2 AS IsMultiProduct,"
    " IsActiveMember = 0 AND Tenure >= 5 AS InactiveLongTenure,"
    " CASE WHEN CreditScore <= 580 THEN 'Poor' WHEN CreditScore <= 670 THEN 'Fair' WHEN CreditScore <= 740 THEN 'Good'"
    " WHEN CreditScore <= 800 THEN 'VeryGood' WHEN CreditScore <= 1000 THEN 'Excellent' END AS CreditScoreBand,"
    " Balance = 0 AS ZeroBalance, Age >= 60 AND NumOfProducts = 1 AS SeniorSingleProduct FROM snap",
    doubles="BalancePerProduct BalanceToSalaryRatio",
)
SPLIT = f"""{SNAP},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY Exited ORDER BY md5(customer_uuid || '529')) AS rn,
    count(*) OVER (PARTITION BY Exited) AS n FROM snap),
sized AS (SELECT *, CAST(ceil(n * 0.2::DOUBLE) AS BIGINT) AS n_test FROM ranked),
split AS (
  SELECT *, CASE WHEN rn <= n_test THEN 'test'
    WHEN rn <= n_test + CAST(ceil((n - n_test) * 0.2::DOUBLE) AS BIGINT) THEN 'val' ELSE 'train' END AS split
  FROM sized)"""
add(
    "geo_target_encoding",
    "SELECT customer_uuid, split, rate AS GeoChurnRate FROM split LEFT JOIN"
    " (SELECT Geography, avg(Exited) AS rate FROM split WHERE split = 'train' GROUP BY Geography) USING (Geography)",
    SPLIT,
    "GeoChurnRate",
)
add(
    "filled_and_clipped",
    "SELECT RowNumber, coalesce(Balance, 0) AS Balance,"
    " greatest(1000::DOUBLE, least(200000::DOUBLE, coalesce(Balance, 0))) AS clipped FROM dirty",
    DIRTY,
    "Balance clipped",
)
add(
    "feature_display_names",
    "SELECT name, count(*) AS n, shown FROM ("
    " SELECT 'cat__Geography_' || Geography AS name, 'Geography ' || Geography AS shown FROM snap UNION ALL"
    " SELECT 'cat__CardType_' || CardType, 'Card Type ' || CardType FROM snap UNION ALL"
    " SELECT 'num__NumOfProducts', 'Num Of Products' FROM snap UNION ALL"
    f" SELECT 'age_group_' || g, 'Age Group ' || upper(substr(g, 1, 1)) || substr(g, 2) FROM (SELECT {_AGE_GROUP} AS g FROM snap)"
    ") GROUP BY name, shown",
)

# ---- scores and top-K
_SCORED = f"SELECT customer_uuid, p AS probability, CAST(p >= 0.5::DOUBLE AS INTEGER) AS prediction, {LEVEL} AS risk_level FROM snap"
add("scored", _SCORED)
add(
    "risk_summary",
    "SELECT count(*) AS total_customers, count(*) FILTER (p >= 0.7::DOUBLE) AS high_risk,"
    " count(*) FILTER (p >= 0.4::DOUBLE AND p < 0.7::DOUBLE) AS medium_risk, count(*) FILTER (p < 0.4::DOUBLE) AS low_risk,"
    " avg(CAST(p >= 0.7::DOUBLE AS INTEGER)) AS high_share, avg(CAST(p >= 0.4::DOUBLE AND p < 0.7::DOUBLE AS INTEGER)) AS medium_share,"
    " avg(CAST(p < 0.4::DOUBLE AS INTEGER)) AS low_share, avg(p) AS mean_probability FROM snap",
    doubles="high_share medium_share low_share mean_probability",
)
add(
    "scoring_run_summary",
    "SELECT count(*) AS total_scored, CAST(greatest(1, floor(count(*) * 0.15::DOUBLE)) AS BIGINT) AS top_k,"
    " greatest(1, floor(count(*) * 0.15::DOUBLE)) / count(*) AS top_share,"
    " avg(p) AS mean_probability, count(*) FILTER (p >= 0.7::DOUBLE) AS high_risk_count FROM snap",
    doubles="top_share mean_probability",
)
_ORDER = "row_number() OVER (ORDER BY p DESC, customer_uuid) AS r, count(*) OVER () AS n"
add(
    "scoring_job",
    f"SELECT customer_uuid, p AS probability, {LEVEL} AS risk_level, 'production' AS model_stage,"
    " CASE WHEN r <= greatest(1, floor(n * 0.15::DOUBLE)) THEN r END AS risk_rank"
    f" FROM (SELECT *, {_ORDER} FROM snap)",
)
add(
    "top_k",
    f"SELECT customer_uuid, p AS probability, {LEVEL} AS risk_level FROM (SELECT *, {_ORDER} FROM snap)"
    " WHERE r <= greatest(1, floor(n * 0.15::DOUBLE))",
)
add(
    "risk_rank",
    f"SELECT customer_uuid, p AS probability, r AS risk_rank FROM (SELECT *, {_ORDER} FROM snap)"
    " WHERE r <= greatest(1, floor(n * 0.3::DOUBLE))",
)
add(
    "top_five",
    f"SELECT customer_uuid, p AS probability, r AS risk_rank FROM (SELECT *, {_ORDER} FROM snap) WHERE r <= 5",
)


# ---- evaluation
def metrics_ctes(source: str, by: str, y: str, p: str, k: str, threshold: str = "0.5::DOUBLE") -> str:
    """CTEs ending in ``m``: every metric per group, by row-level ranks and window sums."""
    return f"""
rows_ AS (SELECT {by} AS g, {y} AS y, {p} AS s, customer_uuid FROM {source}),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, customer_uuid) AS rn, count(*) OVER (PARTITION BY g) AS n
  FROM rows_ WHERE g IS NOT NULL),
kept AS (SELECT *, CAST({k} AS BIGINT) AS k FROM ordered),
base AS (
  SELECT g, count(*) AS n_samples, CAST(sum(y) AS BIGINT) AS n_positives, max(k) AS k,
    CAST(sum(CASE WHEN rn <= k THEN y ELSE 0 END) AS BIGINT) AS tp_at_k,
    count(*) FILTER (s >= {threshold}) AS hit, count(*) FILTER (s >= {threshold} AND y = 1) AS tp
  FROM kept GROUP BY g),
points AS (SELECT g, s, count(*) AS n, sum(y) AS pos FROM ordered GROUP BY g, s),
walk AS (
  SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp,
    sum(n) OVER (PARTITION BY g) AS tn, sum(pos) OVER (PARTITION BY g) AS tp
  FROM points WINDOW w AS (PARTITION BY g ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
areas AS (
  SELECT g,
    sum(CASE WHEN tp > 0 THEN pos::DOUBLE / tp END
      * (cp::DOUBLE / cn + CASE WHEN cn > n THEN (cp - pos)::DOUBLE / (cn - n) ELSE 1 END) / 2) AS pr_auc,
    sum(CASE WHEN tp > 0 THEN pos::DOUBLE / tp END * cp::DOUBLE / cn) AS average_precision,
    CASE WHEN max(tp) > 0 AND max(tn) > max(tp)
      THEN sum(pos * ((tn - tp) - (cn - cp) + (n - pos) / 2.0::DOUBLE)) / (max(tp)::DOUBLE * (max(tn) - max(tp)))
      ELSE 0 END AS roc_auc
  FROM walk GROUP BY g),
m0 AS (
  SELECT b.*, pr_auc, average_precision, roc_auc,
    tp_at_k::DOUBLE / k AS precision_at_k,
    CASE WHEN n_positives > 0 THEN tp_at_k::DOUBLE / n_positives ELSE 0 END AS recall_at_k,
    n_positives::DOUBLE / n_samples AS churn_rate
  FROM base b JOIN areas a ON a.g = b.g),
m AS (
  SELECT *, CASE WHEN churn_rate > 0 THEN precision_at_k / churn_rate ELSE 0 END AS lift_at_k,
    CASE WHEN precision_at_k + recall_at_k > 0
      THEN 2 * precision_at_k * recall_at_k / (precision_at_k + recall_at_k) ELSE 0 END AS f1_at_k,
    k - tp_at_k AS fp_at_k, k::DOUBLE / n_samples AS k_percent
  FROM m0)"""


_K15 = "greatest(1, floor(n * 0.15::DOUBLE))"
ALL = f"{SNAP}, {metrics_ctes('snap', '1', 'Exited', 'p', _K15)}"
_AT_K = "precision_at_k, recall_at_k, lift_at_k, f1_at_k, tp_at_k, fp_at_k, k, k_percent"
_AT_K_D = "precision_at_k recall_at_k lift_at_k f1_at_k k_percent"
add("topk_metrics", f"SELECT {_AT_K} FROM m", ALL, _AT_K_D)
add(
    "topk_metrics_fixed_k",
    f"SELECT {_AT_K} FROM m",
    f"{SNAP}, {metrics_ctes('snap', '1', 'Exited', 'p', 'greatest(1, least(100, n))')}",
    _AT_K_D,
)
add(
    "topk_metrics_tied",
    f"SELECT {_AT_K} FROM m",
    f"{SNAP}, {metrics_ctes('snap', '1', 'Exited', 'round(p, 1)', 'greatest(1, floor(n * 0.1::DOUBLE))')}",
    _AT_K_D,
)
add(
    "confusion",
    "SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM ("
    " SELECT tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp AS true_positives,"
    " CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS pr,"
    " CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS re FROM ("
    " SELECT count(*) FILTER (p < 0.7::DOUBLE AND Exited = 0) AS tn, count(*) FILTER (p >= 0.7::DOUBLE AND Exited = 0) AS fp,"
    " count(*) FILTER (p < 0.7::DOUBLE AND Exited = 1) AS fn, count(*) FILTER (p >= 0.7::DOUBLE AND Exited = 1) AS tp FROM snap))",
    doubles="pr re f1",
)
ORACLES["confusion"] = f"SELECT * RENAME (pr AS precision, re AS recall) FROM ({ORACLES['confusion']}) AS named"
add("roc_auc", "SELECT roc_auc FROM m", ALL, "roc_auc")
add("pr_auc", "SELECT pr_auc FROM m", ALL, "pr_auc")
add("average_precision", "SELECT average_precision FROM m", ALL, "average_precision")
_ALL_ROW = """
SELECT CASE WHEN hit > 0 THEN tp::DOUBLE / hit ELSE 0 END AS precision,
  CASE WHEN n_positives > 0 THEN tp::DOUBLE / n_positives ELSE 0 END AS recall,
  CASE WHEN tp > 0 THEN 2 * (tp::DOUBLE / hit) * (tp::DOUBLE / n_positives)
    / (tp::DOUBLE / hit + tp::DOUBLE / n_positives) ELSE 0 END AS f1,
  pr_auc, average_precision, roc_auc, n_samples - n_positives - (hit - tp) AS true_negatives,
  hit - tp AS false_positives, n_positives - tp AS false_negatives, tp AS true_positives,
  0.5::DOUBLE AS threshold, n_samples, n_positives, churn_rate, precision_at_k AS top_precision_at_k,
  recall_at_k AS top_recall_at_k, lift_at_k AS top_lift_at_k, f1_at_k AS top_f1_at_k, tp_at_k AS top_tp_at_k,
  fp_at_k AS top_fp_at_k, k AS top_k, k_percent AS top_k_percent
FROM m"""
add(
    "all_metrics",
    _ALL_ROW,
    ALL,
    "precision recall f1 pr_auc average_precision roc_auc churn_rate top_precision_at_k top_recall_at_k"
    " top_lift_at_k top_f1_at_k top_k_percent",
)
add(
    "joint_objective",
    "SELECT pr_auc, recall_at_k AS top_recall_at_k, 0.5::DOUBLE * pr_auc + 0.5::DOUBLE * recall_at_k AS objective FROM m",
    ALL,
    "pr_auc top_recall_at_k objective",
)
add(
    "metrics_by_segment",
    "SELECT g AS segment, n_samples, churn_rate, pr_auc, precision_at_k, recall_at_k, lift_at_k FROM m",
    f"{SNAP}, {metrics_ctes('snap', 'Geography', 'Exited', 'p', _K15)}",
    "churn_rate pr_auc precision_at_k recall_at_k lift_at_k",
)
add(
    "model_comparison",
    "SELECT g AS model, pr_auc, average_precision, roc_auc, precision_at_k, recall_at_k, lift_at_k, k, n_samples, n_positives FROM m",
    f"""{SNAP},
long AS (
  SELECT 'risk' AS model, p AS score, Exited, customer_uuid FROM snap UNION ALL
  SELECT 'credit', round(1 - CreditScore / 1000::DOUBLE, 6), Exited, customer_uuid FROM snap),
{metrics_ctes('long', 'model', 'Exited', 'score', 'greatest(1, floor(n * 0.1::DOUBLE))')}""",
    "pr_auc average_precision roc_auc precision_at_k recall_at_k lift_at_k",
)

# ---- named analytics and profile
add("total_customers", "SELECT count(*) AS total_customers FROM snap")
add(
    "average_balance_by_geography",
    "SELECT Geography, avg(Balance) AS average_balance FROM snap GROUP BY Geography",
    doubles="average_balance",
)
add(
    "churn_rate_by_age_group",
    "SELECT CASE WHEN Age < 30 THEN 'Under 30' WHEN Age BETWEEN 30 AND 50 THEN '30-50' ELSE 'Over 50' END AS age_group,"
    " avg(Exited) AS churn_rate FROM snap GROUP BY 1",
    doubles="churn_rate",
)
add("min_max_tenure", "SELECT min(Tenure) AS min_tenure, max(Tenure) AS max_tenure FROM snap")
add(
    "churn_rate_by_products",
    "SELECT NumOfProducts AS products, avg(Exited) AS rate, count(*) AS n FROM snap GROUP BY 1",
    doubles="rate",
)
add("churn_rate_by_card", "SELECT CardType AS card, avg(Exited) AS rate, count(*) AS n FROM snap GROUP BY 1", doubles="rate")
_PROFILE = stacked([*BASE, "PointEarned", "Exited"], "", "snap")
add(
    "numeric_describe",
    'SELECT col AS "column", count(v) AS count, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min,'
    " quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75, max(v) AS max"
    f" FROM ({_PROFILE}) GROUP BY col",
    doubles="mean std min q25 q50 q75 max",
)
add(
    "string_describe",
    'SELECT col AS "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique", first(v ORDER BY n DESC, v) AS top,'
    f" max(n) AS freq FROM (SELECT col, v, count(*) AS n FROM ({stacked(['Surname', *TEXT], '', 'snap', 'VARCHAR')})"
    " GROUP BY col, v) GROUP BY col",
)
add(
    "group_describe",
    "SELECT Exited, avg(Age) AS mean, median(Age::DOUBLE) AS median, count(Age) AS count FROM snap GROUP BY Exited",
    doubles="mean median",
)
add(
    "median_by_two_keys",
    "SELECT Geography, Exited, median(Age::DOUBLE) AS median FROM snap GROUP BY Geography, Exited",
    doubles="median",
)
add(
    "value_counts",
    "SELECT CardType, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM snap) AS share FROM snap GROUP BY CardType",
    doubles="share",
)
add(
    "target_distribution",
    "SELECT z AS retained, o AS churned, z::DOUBLE / n AS retained_share, o::DOUBLE / n AS churned_share,"
    " greatest(z, o)::DOUBLE / least(z, o) AS imbalance_ratio FROM (SELECT count(*) FILTER (Exited = 0) AS z,"
    " count(*) FILTER (Exited = 1) AS o, count(*) AS n FROM snap)",
    doubles="retained_share churned_share imbalance_ratio",
)
_CROSS = 'count(*) FILTER (Exited = 0) AS "Exited_0", count(*) FILTER (Exited = 1) AS "Exited_1"'
add("crosstab", f"SELECT Geography, {_CROSS} FROM snap GROUP BY Geography")
add(
    "binned_crosstab",
    'SELECT band, z::DOUBLE / (z + o) AS "Exited_0", o::DOUBLE / (z + o) AS "Exited_1" FROM ('
    "SELECT CASE WHEN CreditScore <= 400 THEN '0-400' WHEN CreditScore <= 500 THEN '400-500'"
    " WHEN CreditScore <= 600 THEN '500-600' WHEN CreditScore <= 700 THEN '600-700'"
    " WHEN CreditScore <= 800 THEN '700-800' WHEN CreditScore <= 900 THEN '800-900' END AS band,"
    " count(*) FILTER (Exited = 0) AS z, count(*) FILTER (Exited = 1) AS o FROM snap GROUP BY 1) WHERE band IS NOT NULL",
    doubles="Exited_0 Exited_1",
)
add(
    "target_correlation",
    'SELECT col AS "column", r AS correlation FROM ('
    + " UNION ALL ".join(f"SELECT '{c}' AS col, corr({c}, Exited) AS r FROM snap" for c in [*BASE, "PointEarned"])
    + ") WHERE r IS NOT NULL ORDER BY round(abs(r), 9) DESC, col LIMIT 5",
    doubles="correlation",
)


def _pair_rows(columns: list[str], f: str, out: str, source: str = "snap") -> str:
    cells = ", ".join(f"{f}({a}::DOUBLE, {b}::DOUBLE) AS \"{a}|{b}\"" for i, a in enumerate(columns) for b in columns[i:])
    rows = [(a, b, f"{a}|{b}" if i <= j else f"{b}|{a}") for i, a in enumerate(columns) for j, b in enumerate(columns)]
    body = " UNION ALL ".join(f"SELECT '{a}' AS \"row\", '{b}' AS \"column\", \"{c}\" AS {out} FROM pairs" for a, b, c in rows)
    return f"SELECT * FROM (WITH pairs AS (SELECT {cells} FROM {source}) {body})"


add("corr_matrix", _pair_rows(NUMERIC, "corr", "correlation"), doubles="correlation")
# Money in thousands, so that six places are within the digits of a double.
add(
    "cov_matrix",
    _pair_rows(NUMERIC, "covar_samp", "covariance", "(SELECT * REPLACE (Balance / 1000 AS Balance, EstimatedSalary / 1000 AS EstimatedSalary) FROM snap)"),
    doubles="covariance",
)
_SNAP_COLS = (
    "RowNumber CustomerId Surname CreditScore Geography Gender Age Tenure Balance NumOfProducts HasCrCard"
    " IsActiveMember EstimatedSalary PointEarned CardType Lapsed Exited customer_uuid"
).split()
add(
    "distinct_counts",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\" FROM snap" for c in _SNAP_COLS),
)
add(
    "constant_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", min(CAST({v} AS VARCHAR)) AS value FROM snap HAVING count(DISTINCT {v}) <= 1"
        for c, v in (("Age", "Age"), ("Gender", "Gender"), ("Exited", "Exited"), ("currency", "'EUR'"), ("branch", "NULL"))
    ),
)
add(
    "column_stats",
    'SELECT Geography, col AS "column", count(v) AS count, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max'
    f" FROM ({stacked([*BASE, 'PointEarned', 'Exited'], ', Geography', 'snap')}) GROUP BY Geography, col",
    doubles="mean std min max",
)
_ROLE_NUM = [*BASE, "PointEarned", "Exited"]
add(
    "column_roles",
    'SELECT col AS "column", role, CASE WHEN role = \'numerical\' THEN lo END AS min,'
    " CASE WHEN role = 'numerical' THEN hi END AS max, CASE WHEN role = 'numerical' THEN mean END AS mean,"
    " CASE WHEN role = 'numerical' THEN std END AS std FROM ("
    " SELECT *, CASE WHEN d > 5 THEN 'numerical' WHEN zo THEN 'binary' ELSE 'categorical' END AS role FROM ("
    " SELECT col, count(DISTINCT v) AS d, bool_and(v IN (0, 1)) AS zo, min(v) AS lo, max(v) AS hi, avg(v) AS mean,"
    f" stddev_samp(v) AS std FROM ({stacked(_ROLE_NUM, '', 'snap')}) GROUP BY col))"
    " UNION ALL SELECT col, CASE WHEN col IN ('RowNumber', 'CustomerId', 'customer_uuid') THEN 'id' ELSE 'categorical' END,"
    " NULL, NULL, NULL, NULL FROM (VALUES ('RowNumber'), ('CustomerId'), ('customer_uuid'), ('Surname'), ('Geography'),"
    " ('Gender'), ('CardType')) AS t(col)",
    doubles="min max mean std",
)
add(
    "avg_rank",
    "SELECT customer_uuid, Balance, (rank() OVER (ORDER BY Balance) + (count(*) OVER (PARTITION BY Balance) - 1) / 2.0::DOUBLE)"
    " / (count(*) OVER () + 1) AS rank_share FROM snap",
    doubles="Balance rank_share",
)
add(
    "five_number",
    'SELECT Exited, col AS "column", min(v) AS min, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS median,'
    f" quantile_cont(v, 0.75) AS q75, max(v) AS max FROM ({stacked(['Age', 'Balance', 'CreditScore'], ', Exited', 'snap')})"
    " GROUP BY Exited, col",
    doubles="min q25 median q75 max",
)
add(
    "histogram",
    "SELECT CAST(b AS INTEGER) AS bin, lo + b * w AS low, lo + (b + 1) * w AS high, count(*) AS n FROM ("
    " SELECT lo, w, least(floor((v - lo) / w), 9) AS b FROM (SELECT Age::DOUBLE AS v FROM snap),"
    " (SELECT min(Age)::DOUBLE AS lo, (max(Age) - min(Age))::DOUBLE / 10 AS w FROM snap)) GROUP BY b, lo, w",
    doubles="low high",
)
add(
    "salary_quantiles",
    "SELECT 'EstimatedSalary' AS \"column\", q AS prob, quantile AS quantile FROM ("
    " SELECT unnest([0.01::DOUBLE, 0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE]) AS q,"
    " unnest(quantile_cont(EstimatedSalary, [0.01, 0.1, 0.5, 0.9, 0.99])) AS quantile FROM snap)",
    doubles="quantile",
)


# ---- quality
# What breaks each column besides a null, written out here apart from the operator's rules.
_BREAKS = {
    "CreditScore": {"at_least": "CreditScore < 300", "at_most": "CreditScore > 850"},
    "Geography": {"one_of": "Geography NOT IN ('France', 'Spain', 'Germany')"},
    "Gender": {"one_of": "Gender NOT IN ('Male', 'Female')"},
    "Age": {"at_least": "Age < 18", "at_most": "Age > 100"},
    "Tenure": {"at_least": "Tenure < 0", "at_most": "Tenure > 10"},
    "Balance": {"at_least": "Balance < 0"},
    "NumOfProducts": {"at_least": "NumOfProducts < 1", "at_most": "NumOfProducts > 4"},
    "HasCrCard": {"one_of": "HasCrCard NOT IN (0, 1)"},
    "IsActiveMember": {"one_of": "IsActiveMember NOT IN (0, 1)"},
    "EstimatedSalary": {"at_least": "EstimatedSalary < 0", "at_most": "EstimatedSalary > 200000"},
    "PointEarned": {"at_least": "PointEarned < 0"},
    "CardType": {"one_of": "CardType NOT IN ('Silver', 'Gold', 'Diamond', 'Platinum')"},
    "Exited": {"one_of": "Exited NOT IN (0, 1)"},
}


def _rule_rows(more: list[str], source: str) -> str:
    """One row per check, counted by filters on columns of the right type."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{name}' AS \"check\", count(*) FILTER ({cond}) AS failures FROM {source}"
        for c, breaks in ({c: {} for c in more} | _BREAKS).items()
        for name, cond in {"not_null": f"{c} IS NULL", "type": "false", **breaks}.items()
    )


add("raw_validation_report", _rule_rows(["RowNumber", "CustomerId", "Surname"], "dirty"), DIRTY)
add(
    "training_validation_report",
    _rule_rows(["customer_uuid"], "dirty")
    + " UNION ALL SELECT 'customer_uuid', 'unique', count(*) - count(DISTINCT customer_uuid) FROM dirty",
    DIRTY,
)
add(
    "row_errors",
    "SELECT RowNumber, errors FROM (SELECT RowNumber, concat_ws(',',"
    " CASE WHEN Balance IS NULL THEN 'Balance:not_null' END,"
    " CASE WHEN CreditScore > 850 THEN 'CreditScore:at_most' END,"
    " CASE WHEN Geography = 'Italy' THEN 'Geography:one_of' END) AS errors FROM dirty) WHERE errors <> ''",
    DIRTY,
)
add(
    "class_balance",
    "SELECT count(*) FILTER (Exited = 0) AS retained, count(*) FILTER (Exited = 1) AS churned,"
    " least(avg(Exited), 1 - avg(Exited)) AS minority_share, 0.05::DOUBLE AS minimum,"
    " least(avg(Exited), 1 - avg(Exited)) >= 0.05::DOUBLE AS passed FROM snap",
    doubles="minority_share",
)
_DIRTY_COLS = (
    "RowNumber CustomerId Surname CreditScore Geography Gender Age Tenure Balance NumOfProducts HasCrCard IsActiveMember"
    " EstimatedSalary Exited Complain CardType PointEarned customer_uuid"
).split()
_Q = [*_DIRTY_COLS, "Satisfaction Score"]
add(
    "missing_share",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (\"{c}\" IS NULL) AS missing,"
        f" round(count(*) FILTER (\"{c}\" IS NULL)::DOUBLE / count(*), 6) AS missing_share,"
        f" count(*) FILTER (\"{c}\" IS NULL)::DOUBLE / count(*) <= 0.05::DOUBLE AS passed FROM dirty"
        for c in _Q
    ),
    DIRTY,
)
add(
    "null_cells",
    "SELECT CAST(" + " + ".join(f'count(*) FILTER ("{c}" IS NULL)' for c in _Q) + " AS BIGINT) AS null_cells FROM dirty",
    DIRTY,
)
add(
    "duplicate_count",
    "SELECT CAST((SELECT count(*) FROM dirty) - count(*) AS BIGINT) AS duplicates FROM"
    " (SELECT DISTINCT * EXCLUDE (RowNumber) FROM dirty)",
    DIRTY,
)
add("distinct_rows", "SELECT DISTINCT * EXCLUDE (RowNumber) FROM dirty", DIRTY, "Balance EstimatedSalary")
_FIRST = "(SELECT *, row_number() OVER (PARTITION BY customer_uuid ORDER BY RowNumber) AS rn FROM dirty) WHERE rn = 1"
add("first_per_customer", f"SELECT customer_uuid, RowNumber, Balance FROM {_FIRST}", DIRTY, "Balance")
add(
    "cleaned",
    "SELECT CreditScore, Geography, Gender, Age, Tenure, Balance, NumOfProducts, HasCrCard, IsActiveMember,"
    f" EstimatedSalary, Exited, CardType, PointEarned, customer_uuid FROM {_FIRST} AND Balance IS NOT NULL",
    DIRTY,
    "Balance EstimatedSalary",
)
add(
    "clean_report",
    "SELECT count(*) AS rows_in, count(*) - count(DISTINCT customer_uuid) AS duplicates_removed,"
    f" (SELECT count(*) FROM {_FIRST} AND Balance IS NULL) AS null_rows_removed,"
    f" (SELECT count(*) FROM {_FIRST} AND Balance IS NOT NULL) AS rows_out, CAST(5 AS INTEGER) AS columns_removed FROM dirty",
    DIRTY,
)
add(
    "correlated_leakage",
    'SELECT col AS "column", r AS correlation FROM ('
    + " UNION ALL ".join(
        f"SELECT '{c}' AS col, corr(\"{c}\", Exited) AS r FROM raw" for c in ("Complain", "Age", "Balance", "CreditScore")
    )
    + ") WHERE abs(r) >= 0.99::DOUBLE",
    RAW,
    "correlation",
)


# ---- drift and alerts
def _sides(columns: list[str], cast: str = "DOUBLE") -> str:
    return (
        f"{SHIFT},\ncells AS ({stacked(columns, ', 1 AS ref', 'snap', cast)} UNION ALL"
        f" {stacked(columns, ', 0 AS ref', 'cur', cast)})"
    )


_STEPS = """,
counts AS (SELECT col, v, sum(ref) AS r, sum(1 - ref) AS c FROM cells GROUP BY col, v),
walk AS (
  SELECT col, v, abs(sum(r) OVER w / sum(r) OVER a - sum(c) OVER w / sum(c) OVER a) AS gap, lead(v) OVER w AS nxt
  FROM counts
  WINDOW w AS (PARTITION BY col ORDER BY v ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY col))"""


def _psi_ctes(columns: list[str]) -> str:
    probs = ", ".join(f"{i / 10}::DOUBLE" for i in range(11))
    edges = " UNION ALL ".join(
        f"SELECT '{c}' AS col, list_sort(list_distinct(quantile_cont({c}::DOUBLE, [{probs}]))) AS e FROM snap" for c in columns
    )
    return f""",
edges AS ({edges}),
bounds AS (
  SELECT col, edge AS lo, lead(edge) OVER w AS hi, row_number() OVER w AS slot, max(edge) OVER (PARTITION BY col) AS top
  FROM (SELECT col, unnest(e) AS edge FROM edges) WINDOW w AS (PARTITION BY col ORDER BY edge)),
slots AS (
  SELECT c.col, ref, slot FROM cells c JOIN bounds b
    ON b.col = c.col AND v >= lo AND (v < hi OR (v = hi AND hi = top))),
sizes AS (SELECT col, sum(ref) AS er, sum(1 - ref) AS ac FROM cells GROUP BY col),
shares AS (
  SELECT col, slot, sum(ref) / (max(er) + 1e-8::DOUBLE) AS e, sum(1 - ref) / (max(ac) + 1e-8::DOUBLE) AS a
  FROM slots JOIN sizes USING (col) GROUP BY col, slot),
psi AS (
  SELECT col, sum((e - a) * ln((e + 1e-8::DOUBLE) / (a + 1e-8::DOUBLE))) AS psi FROM shares GROUP BY col)"""


add(
    "psi",
    'SELECT col AS "column", CASE WHEN len(e) < 2 THEN 0 ELSE psi END AS psi FROM psi JOIN edges USING (col)',
    _sides(NUMERIC) + _psi_ctes(NUMERIC),
    "psi",
)
add(
    "ks",
    'SELECT col AS "column", max(gap) AS ks FROM walk GROUP BY col UNION ALL SELECT \'Surname\', NULL',
    _sides(NUMERIC) + _STEPS,
    "ks",
)


def _corr_diff(columns: list[str]) -> str:
    pairs = [(a, b) for a in columns for b in columns]

    def row(source: str) -> str:
        return "SELECT [" + ", ".join(f"coalesce(corr({a}::DOUBLE, {b}::DOUBLE), 0)" for a, b in pairs) + f"] AS m FROM {source}"

    return f"SELECT avg(abs(x - y)) AS d FROM (SELECT unnest(r.m) AS x, unnest(c.m) AS y FROM ({row('snap')}) r, ({row('cur')}) c)"


add("corr_diff", f"SELECT d AS corr_matrix_mean_abs_diff FROM ({_corr_diff(NUMERIC)})", SHIFT, "corr_matrix_mean_abs_diff")
add(
    "quality_report_file",
    "SELECT col AS \"column\", 'ks' AS statistic, max(gap) AS value FROM walk GROUP BY col"
    " UNION ALL SELECT col, 'psi', psi FROM psi"
    f" UNION ALL SELECT '*', 'corr_matrix_mean_abs_diff', d FROM ({_corr_diff(NUMERIC)})",
    _sides(NUMERIC) + _STEPS + _psi_ctes(NUMERIC),
    "value",
)


def _column_drift(numeric: list[str], text: list[str]) -> str:
    spread = " UNION ALL ".join(f"SELECT '{c}' AS col, stddev_pop({c}) AS sd FROM snap" for c in numeric)
    return f"""{_sides(numeric)}{_STEPS},
texts AS ({stacked(text, ', 1 AS ref', 'snap', 'VARCHAR')} UNION ALL {stacked(text, ', 0 AS ref', 'cur', 'VARCHAR')}),
shares AS (
  SELECT col, v, sum(ref) / sum(sum(ref)) OVER a AS p, sum(1 - ref) / sum(sum(1 - ref)) OVER a AS q
  FROM texts GROUP BY col, v WINDOW a AS (PARTITION BY col)),
drift AS (
  SELECT col, 'wasserstein_normed' AS method, area / greatest(sd, 0.001::DOUBLE) AS value
  FROM (SELECT col, sum(gap * coalesce(nxt - v, 0)) AS area FROM walk GROUP BY col) JOIN ({spread}) USING (col)
  UNION ALL
  SELECT col, 'jensen_shannon', sqrt(greatest(0, sum(
    CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2))
  FROM shares GROUP BY col)"""


_DRIFT = _column_drift(NUMERIC, TEXT)
add(
    "column_drift",
    'SELECT col AS "column", method, value, value > 0.1::DOUBLE AS drifted FROM drift',
    _DRIFT,
    "value",
)
add(
    "data_drift",
    "SELECT bool_or(value > 0.1::DOUBLE) AS drift_detected, count(*) FILTER (value > 0.1::DOUBLE)::DOUBLE / count(*) AS drift_share,"
    " count(*) FILTER (value > 0.1::DOUBLE)::DOUBLE / count(*) >= 0.5::DOUBLE AS share_exceeded,"
    " count(*) FILTER (value > 0.1::DOUBLE) AS n_drifted_columns, count(*) AS n_total_columns,"
    " string_agg(CASE WHEN value > 0.1::DOUBLE THEN col END, ',' ORDER BY col) AS drifted_columns FROM drift",
    _DRIFT,
    "drift_share",
)
_PRED = "(SELECT avg(p) AS r FROM snap), (SELECT avg(p) AS c FROM cur)"
add(
    "prediction_drift",
    "SELECT abs(c - r) > 0.6::DOUBLE AS prediction_drift_detected, r AS reference_mean, c AS current_mean, c - r AS mean_shift"
    f" FROM {_PRED}",
    SHIFT,
    "reference_mean current_mean mean_shift",
)
PERF = f"""{SHIFT},
both_sides AS (
  SELECT 'reference' AS side, Exited, p, customer_uuid FROM snap UNION ALL
  SELECT 'current', Exited, p, customer_uuid FROM cur),
{metrics_ctes('both_sides', 'side', 'Exited', 'p', _K15)},
perf AS (
  SELECT max(CASE WHEN g = 'reference' THEN pr_auc END) - max(CASE WHEN g = 'current' THEN pr_auc END) AS pr_auc_drop,
    max(CASE WHEN g = 'reference' THEN precision_at_k END) - max(CASE WHEN g = 'current' THEN precision_at_k END) AS precision_at_k_drop,
    max(CASE WHEN g = 'reference' THEN recall_at_k END) - max(CASE WHEN g = 'current' THEN recall_at_k END) AS recall_at_k_drop
  FROM m)"""
_DEGRADED = "greatest(pr_auc_drop, precision_at_k_drop, recall_at_k_drop) > 0.05::DOUBLE"
add(
    "performance_drift",
    f"SELECT *, {_DEGRADED} AS performance_degraded FROM perf",
    PERF,
    "pr_auc_drop precision_at_k_drop recall_at_k_drop",
)


# The three results on all feature columns, one row each.
def _monitor() -> str:
    drift = _column_drift(NUMERIC, TEXT).removeprefix(SHIFT)
    drift = drift.replace("walk AS", "steps AS").replace("FROM walk", "FROM steps")
    return f"""{PERF}{drift},
data AS (
  SELECT count(*) FILTER (value > 0.1::DOUBLE) AS k, count(*) FILTER (value > 0.1::DOUBLE)::DOUBLE / count(*) AS share FROM drift),
pred AS (SELECT c - r AS shift FROM {_PRED}),
perf2 AS (SELECT *, {_DEGRADED} AS degraded FROM perf),
alert AS (
  SELECT 1 AS position, 'data_drift' AS alert_type,
    CASE WHEN share >= 0.7::DOUBLE THEN 'critical' WHEN share >= 0.5::DOUBLE THEN 'warning' ELSE 'info' END AS severity,
    printf('Data drift detected: %.1f%% of features drifted', share * 100) AS message FROM data WHERE k > 0
  UNION ALL
  SELECT 2, 'prediction_drift',
    CASE WHEN abs(shift) >= 0.15::DOUBLE THEN 'critical' WHEN abs(shift) >= 0.1::DOUBLE THEN 'warning' ELSE 'info' END,
    printf('Prediction mean shift detected: %.3f', abs(shift)) FROM pred WHERE abs(shift) > 0.6::DOUBLE
  UNION ALL
  SELECT 3, 'performance_degradation',
    CASE WHEN pr_auc_drop >= 0.1::DOUBLE THEN 'critical' WHEN pr_auc_drop >= 0.05::DOUBLE THEN 'warning' ELSE 'info' END,
    printf('Model PR_AUC dropped by %.3f', pr_auc_drop) FROM perf2 WHERE degraded),
crit AS (SELECT count(*) AS n FROM alert WHERE severity = 'critical')"""


MONITOR = _monitor()
add("alerts", "SELECT * FROM alert", MONITOR)
add(
    "retrain_decision",
    "SELECT (k > 0 AND share >= 0.5::DOUBLE) OR (degraded AND pr_auc_drop >= 0.05::DOUBLE) OR n > 0 AS should_retrain,"
    " concat_ws(' | ', CASE WHEN k > 0 AND share >= 0.5::DOUBLE THEN"
    " printf('Significant data drift detected: %.1f%% of features', share * 100) END,"
    " CASE WHEN degraded AND pr_auc_drop >= 0.05::DOUBLE THEN printf('Performance degradation: PR-AUC dropped by %.3f', pr_auc_drop) END,"
    " CASE WHEN n > 0 THEN printf('%d critical alerts triggered', n) END) AS reasons,"
    " share AS drift_share, pr_auc_drop AS performance_drop, n AS critical_alerts, false AS approved FROM data, perf2, crit",
    MONITOR,
    "drift_share performance_drop",
)
add(
    "monitoring_report",
    "SELECT 'data_drift' AS section, 'drift_detected' AS item, CAST(k > 0 AS VARCHAR) AS value FROM data"
    " UNION ALL SELECT 'data_drift', 'drift_share', printf('%.4f', share) FROM data"
    " UNION ALL SELECT 'data_drift', 'n_drifted_columns', CAST(k AS VARCHAR) FROM data"
    " UNION ALL SELECT 'drifted_features', col, printf('%.4f', value) FROM drift WHERE value > 0.1::DOUBLE"
    " UNION ALL SELECT 'prediction_drift', 'prediction_drift_detected', CAST(abs(shift) > 0.6::DOUBLE AS VARCHAR) FROM pred"
    " UNION ALL SELECT 'prediction_drift', 'mean_shift', printf('%.4f', shift) FROM pred"
    " UNION ALL SELECT 'performance_drift', 'performance_degraded', CAST(degraded AS VARCHAR) FROM perf2"
    " UNION ALL SELECT 'performance_drift', 'pr_auc_drop', printf('%.4f', pr_auc_drop) FROM perf2"
    " UNION ALL SELECT 'alerts', alert_type, severity || ': ' || message FROM alert",
    MONITOR,
)

add(
    "retraining_report",
    "SELECT 'decision' AS section, 'recommendation' AS item, CASE WHEN go THEN 'RETRAIN' ELSE 'NO RETRAIN' END AS value FROM choice"
    " UNION ALL SELECT 'decision', 'approval', 'PENDING OR DENIED' FROM choice"
    " UNION ALL SELECT 'reasons', CAST(row_number() OVER (ORDER BY position) AS VARCHAR), reason FROM why"
    " UNION ALL SELECT 'reasons', '1', 'All metrics within acceptable ranges' FROM choice WHERE (SELECT count(*) FROM why) = 0"
    " UNION ALL SELECT 'metrics', 'drift_share', printf('%.1f%%', share * 100) FROM data"
    " UNION ALL SELECT 'metrics', 'pr_auc_drop', printf('%.4f', pr_auc_drop) FROM perf2"
    " UNION ALL SELECT 'metrics', 'critical_alerts', CAST(n AS VARCHAR) FROM crit"
    " UNION ALL SELECT 'results', 'status', CASE WHEN go THEN 'Awaiting Approval' ELSE 'Skipped' END FROM choice",
    f"""{MONITOR},
why AS (
  SELECT 1 AS position, printf('Significant data drift detected: %.1f%% of features', share * 100) AS reason FROM data
  WHERE k > 0 AND share >= 0.5::DOUBLE
  UNION ALL SELECT 2, printf('Performance degradation: PR-AUC dropped by %.3f', pr_auc_drop) FROM perf2
  WHERE degraded AND pr_auc_drop >= 0.05::DOUBLE
  UNION ALL SELECT 3, printf('%d critical alerts triggered', n) FROM crit WHERE n > 0),
choice AS (SELECT (SELECT count(*) FROM why) > 0 AS go)""",
)
add(
    "drift_report_file",
    'SELECT col AS "column", method, value, value > 0.1::DOUBLE AS drifted FROM drift',
    _DRIFT,
    "value",
)

# ---- split, preprocessing, models
add("stratified_split", "SELECT customer_uuid, Exited, split FROM split", SPLIT)
_SCALED = ", ".join(
    f"(s.{c} - (SELECT avg({c}) FROM split WHERE split = 'train')) / (SELECT stddev_pop({c}) FROM split WHERE split = 'train') AS {c}"
    for c in ("CreditScore", "Age", "Balance")
)
add("scaled_features", f"SELECT customer_uuid, split, {_SCALED} FROM split s", SPLIT, "CreditScore Age Balance")
_CARDS = ", ".join(f"CAST(CardType = '{v}' AS INTEGER) AS \"CardType_{v}\"" for v in ("Diamond", "Gold", "Platinum", "Silver"))
_GEOS = [f"CAST(Geography = '{v}' AS INTEGER) AS \"Geography_{v}\"" for v in ("France", "Germany", "Spain")]
add("one_hot", f"SELECT customer_uuid, Geography, CardType, {', '.join(_GEOS)}, {_CARDS} FROM snap")
add("one_hot_drop_first", f"SELECT customer_uuid, Geography, {', '.join(_GEOS[1:])} FROM snap")
add(
    "class_weights",
    "SELECT customer_uuid, Exited, (SELECT count(*) FROM snap)::DOUBLE / ((SELECT count(DISTINCT Exited) FROM snap)"
    " * count(*) OVER (PARTITION BY Exited)) AS weight FROM snap",
    doubles="weight",
)
add(
    "positive_weight",
    "SELECT count(*) FILTER (Exited = 0)::DOUBLE / count(*) FILTER (Exited = 1) AS scale_pos_weight FROM snap",
    doubles="scale_pos_weight",
)
_NAMES = {"Age": "Age", "Balance": "Balance", "IsActiveMember": "Is Active Member", "IsSingleProduct": "Is Single Product"}
_PARTS = " UNION ALL ".join(
    f"SELECT customer_uuid, lvl, '{_NAMES[c]}' AS feature, {c} AS x, avg({c}) OVER () AS mean, ({w})::DOUBLE AS w FROM single"
    for c, w in RISK_WEIGHTS.items()
)
PARTS = f"""{SNAP},
single AS (SELECT *, {LEVEL} AS lvl, CAST(NumOfProducts = 1 AS INTEGER) AS IsSingleProduct FROM snap),
cells AS ({_PARTS}),
parts AS (SELECT *, round(w * (x - mean), 6) AS contribution FROM cells),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY customer_uuid ORDER BY abs(contribution) DESC, feature) AS position FROM parts)"""
add(
    "linear_contributions",
    "SELECT customer_uuid, CAST(position AS INTEGER) AS position, feature, contribution,"
    " CASE WHEN contribution > 0 THEN 'increase' ELSE 'decrease' END AS impact,"
    " contribution / sum(abs(contribution)) OVER (PARTITION BY customer_uuid) * 100 AS percentage"
    " FROM placed WHERE position <= 3",
    PARTS,
    "percentage",
)
add(
    "prediction_values",
    "SELECT customer_uuid, round(sum(w * mean), 8) AS base_value, round(sum(w * x), 8) AS prediction_value"
    " FROM cells GROUP BY customer_uuid",
    PARTS,
)
_ADVICE = ", ".join(
    f"('{f}', '{impact}', '{text}')" for f, pair in ACTIONS.items() for impact, text in zip(("increase", "decrease"), pair)
)
add(
    "recommendations",
    "SELECT customer_uuid, lvl AS risk_level, CASE WHEN lvl = 'low' THEN"
    f" '{NO_ACTION}' WHEN texts IS NOT NULL THEN texts WHEN lvl = 'high' THEN '{FALLBACKS['high']}'"
    f" ELSE '{FALLBACKS['medium']}' END AS recommendations FROM ("
    " SELECT customer_uuid, lvl, string_agg(advice, ' | ' ORDER BY position) AS texts FROM placed LEFT JOIN"
    f" (VALUES {_ADVICE}) AS a(f, impact, advice) ON f = feature"
    " AND impact = CASE WHEN contribution > 0 THEN 'increase' ELSE 'decrease' END WHERE position <= 3"
    " GROUP BY customer_uuid, lvl)",
    PARTS,
)

# ---- streaming: the batch twin
add(
    "stream_scored",
    f"SELECT CustomerId, Geography, CardType, p AS probability, CAST(p >= 0.5::DOUBLE AS INTEGER) AS prediction, {LEVEL} AS risk_level FROM snap",
)
add("stream_deduplicated", "SELECT DISTINCT customer_uuid, CustomerId FROM dirty", DIRTY)
_DAYS = (
    "SELECT strftime(ts, '%Y-%m-%d') AS start, count(*) AS n, avg(greatest(0::DOUBLE, least(1::DOUBLE, value / 100))) AS mean"
    " FROM events GROUP BY 1"
)
_GRADED = (
    "SELECT start, n, mean, mean - base AS mean_shift, CASE WHEN abs(mean - base) >= 0.15::DOUBLE THEN 'critical'"
    " WHEN abs(mean - base) >= 0.1::DOUBLE THEN 'warning' ELSE 'info' END AS severity"
    f" FROM ({_DAYS}), (SELECT avg(greatest(0::DOUBLE, least(1::DOUBLE, value / 100))) AS base FROM events)"
)
add("prediction_mean_by_day", _GRADED, "", "mean mean_shift")
add(
    "stream_mean_by_day",
    f"SELECT *, (SELECT count(*) FROM events WHERE ts < (SELECT date_trunc('day', min(ts)) + INTERVAL 1 DAY FROM events)) AS late_rows,"
    f" 0 AS open_buckets FROM ({_GRADED})",
    "",
    "mean mean_shift",
)


# ---- models
def _newton(source: str, key: str, y: str, a: str, b: str, steps: int = 9) -> str:
    """Logistic regression on two standardised features: Newton steps, each one aggregate
    and a 3 x 3 system solved by its cofactors."""
    ctes = [
        f"raw_xy AS (SELECT {key}, {y} AS y, coalesce({a}, 0)::DOUBLE AS a, coalesce({b}, 0)::DOUBLE AS b FROM {source})",
        "z AS MATERIALIZED (SELECT * REPLACE ((a - ma) / sa AS a, (b - mb) / sb AS b) FROM raw_xy,"
        " (SELECT avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM raw_xy))",
        "b0 AS (SELECT 0::DOUBLE AS c0, 0::DOUBLE AS c1, 0::DOUBLE AS c2)",
    ]
    for i in range(1, steps + 1):
        ctes.append(
            f"s{i} AS (SELECT any_value(c0) AS c0, any_value(c1) AS c1, any_value(c2) AS c2, sum(y - p) AS g0, sum((y - p) * a) AS g1,"
            " sum((y - p) * b) AS g2, sum(w) AS h00, sum(w * a) AS h01, sum(w * b) AS h02, sum(w * a * a) AS h11, sum(w * a * b) AS h12,"
            f" sum(w * b * b) AS h22 FROM (SELECT *, p * (1 - p) AS w FROM (SELECT *, 1 / (1 + exp(-(c0 + c1 * a + c2 * b))) AS p FROM z, b{i - 1})))"
        )
        ctes.append(
            f"b{i} AS MATERIALIZED (SELECT c0 + (k00 * g0 + k01 * g1 + k02 * g2) / d AS c0, c1 + (k01 * g0 + k11 * g1 + k12 * g2) / d AS c1,"
            " c2 + (k02 * g0 + k12 * g1 + k22 * g2) / d AS c2 FROM (SELECT *, h00 * k00 + h01 * k01 + h02 * k02 AS d FROM (SELECT *,"
            " h11 * h22 - h12 * h12 AS k00, h02 * h12 - h01 * h22 AS k01, h01 * h12 - h02 * h11 AS k02, h00 * h22 - h02 * h02 AS k11,"
            f" h01 * h02 - h00 * h12 AS k12, h00 * h11 - h01 * h01 AS k22 FROM s{i})))"
        )
    return ",\n".join(ctes)


add(
    "conditional_churn",
    "SELECT RowNumber, 1 / (1 + exp(-(c0 + c1 * a + c2 * b))) AS probability FROM z, b9",
    f"{DIRTY},\n{_newton('dirty', 'RowNumber', 'Exited', 'Age', 'Balance')}",
    "probability",
)
add(
    "stratified_split_by_score",
    "SELECT customer_uuid, CreditScore, split FROM split",
    SPLIT.replace("PARTITION BY Exited", "PARTITION BY CreditScore"),
)
add(
    "one_hot_surnames",
    "SELECT customer_uuid, CASE WHEN known = 1 THEN s.slot END AS slot, n.size AS size FROM snap LEFT JOIN"
    " (SELECT Surname, row_number() OVER (ORDER BY Surname) - 1 AS slot FROM (SELECT DISTINCT Surname FROM snap WHERE known = 1)) s USING (Surname),"
    " (SELECT count(DISTINCT Surname) AS size FROM snap WHERE known = 1) n",
)
add("saved_model_scores", "SELECT customer_uuid, CAST(2 AS BIGINT) AS copies, true AS same FROM snap")
_TEST = "(SELECT * FROM split WHERE split = 'test')"
_TWO_SCORES = f"(SELECT 'b' AS side, Exited, customer_uuid, 1 - CreditScore / 1000 AS s FROM {_TEST} UNION ALL SELECT 't', Exited, customer_uuid, p FROM {_TEST})"
add(
    "training_report",
    "SELECT 'performance' AS section, 'baseline_pr_auc' AS item, max(pr_auc) FILTER (g = 'b') AS value FROM m"
    " UNION ALL SELECT 'performance', 'tuned_pr_auc', max(pr_auc) FILTER (g = 't') FROM m"
    " UNION ALL SELECT 'performance', 'improvement', max(pr_auc) FILTER (g = 't') - max(pr_auc) FILTER (g = 'b') FROM m"
    " UNION ALL SELECT * FROM (SELECT 'top_features', item, value FROM (SELECT 'Age' AS item, avg(Age) * 0.03 AS value FROM split UNION ALL"
    " SELECT 'Balance', avg(Balance) * 0.000002 FROM split UNION ALL SELECT 'IsActiveMember', avg(IsActiveMember) * 1.2 FROM split)"
    " ORDER BY value DESC, item LIMIT 2)",
    f"{SPLIT}, {metrics_ctes(_TWO_SCORES, 'side', 'Exited', 's', _K15)}",
    "value",
)

# ---- alerts by nation
NATIONS = """
x AS (
  SELECT nation, (row_number() OVER (ORDER BY n, nation) - 1)::DOUBLE / (count(*) OVER () - 1) AS x
  FROM (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1)),
cases AS (SELECT nation, x AS share, (x - 0.5::DOUBLE) * 0.5713::DOUBLE AS shift, (1 - x) * 0.2137::DOUBLE AS fall FROM x),
alert AS (
  SELECT nation, 1 AS position, 'data_drift' AS alert_type,
    CASE WHEN share >= 0.7::DOUBLE THEN 'critical' WHEN share >= 0.5::DOUBLE THEN 'warning' ELSE 'info' END AS severity,
    printf('Data drift detected: %.1f%% of features drifted', share * 100) AS message FROM cases WHERE share > 0.1::DOUBLE
  UNION ALL
  SELECT nation, 2, 'prediction_drift',
    CASE WHEN abs(shift) >= 0.15::DOUBLE THEN 'critical' WHEN abs(shift) >= 0.1::DOUBLE THEN 'warning' ELSE 'info' END,
    printf('Prediction mean shift detected: %.3f', abs(shift)) FROM cases WHERE abs(shift) > 0.03::DOUBLE
  UNION ALL
  SELECT nation, 3, 'performance_degradation',
    CASE WHEN fall >= 0.1::DOUBLE THEN 'critical' WHEN fall >= 0.05::DOUBLE THEN 'warning' ELSE 'info' END,
    printf('Model PR_AUC dropped by %.3f', fall) FROM cases WHERE fall > 0.02::DOUBLE)"""
add("alerts_by_nation", "SELECT * FROM alert", NATIONS)
add(
    "decisions_by_nation",
    "SELECT nation, reasons <> '' AS should_retrain, reasons, share AS drift_share, fall AS performance_drop, k AS critical_alerts,"
    " CASE WHEN NOT asked THEN true WHEN reasons = '' THEN false ELSE auto END AS approved, asked, auto FROM ("
    "SELECT nation, share, fall, k, concat_ws(' | ',"
    " CASE WHEN share > 0.1::DOUBLE AND share >= 0.5::DOUBLE THEN printf('Significant data drift detected: %.1f%% of features', share * 100) END,"
    " CASE WHEN fall > 0.02::DOUBLE AND fall >= 0.05::DOUBLE THEN printf('Performance degradation: PR-AUC dropped by %.3f', fall) END,"
    " CASE WHEN k > 0 THEN printf('%d critical alerts triggered', k) END) AS reasons FROM"
    " (SELECT *, (SELECT count(*) FROM alert a WHERE a.nation = c.nation AND severity = 'critical') AS k FROM cases c)),"
    " (VALUES (true), (false)) AS q(asked), (VALUES (true), (false)) AS r(auto)",
    NATIONS,
    "drift_share performance_drop",
)
add(
    "column_drift_of_all",
    'SELECT col AS "column", method, value, value > 0.1::DOUBLE AS drifted FROM drift',
    _column_drift(["IsActiveMember", *NUMERIC], TEXT),
    "value",
)
