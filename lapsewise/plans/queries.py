"""The registered queries: every operator over the whole tables of one folder.

Each takes ``(spark, sf_dir)`` and returns a frame whose floating columns are
rounded to six places, so that engines adding in another order agree.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapsewise.config import NUMERIC_FEATURES, REQUEST_FEATURES
from lapsewise.functions import features as fx
from lapsewise.functions.ids import job_id, run_id
from lapsewise.functions.scoring import RISK_WEIGHTS, add_predictions, stamp
from lapsewise.functions.text import display_name, first_present, mask_pii, normalize
from lapsewise.operators import alerts as al
from lapsewise.operators import drift as dr
from lapsewise.operators import evaluate as ev
from lapsewise.operators import explain as ex
from lapsewise.operators import preprocess as pp
from lapsewise.operators import profile as pr
from lapsewise.operators import quality as qu
from lapsewise.operators import split as sp
from lapsewise.operators import topk as tk
from lapsewise.operators import train as tr
from lapsewise.operators.ordered import quantiles
from lapsewise.operators.search import trials_table
from lapsewise.plans.batch_scoring import rule_scorer, score_customers
from lapsewise.plans.ingestion import ingest, keyed
from lapsewise.plans.models import promote, save_model, score_to_table
from lapsewise.plans.monitoring import monitor
from lapsewise.plans.snapshot import (
    CUTOFF,
    customer_snapshot,
    dirty_customers,
    raw_customers,
    shifted_customers,
    spoiled_customers,
)
from lapsewise.sources.readers import RAW_CUSTOMER_SCHEMA, load, query_files, read_csv, read_parquet, read_query, table_exists
from lapsewise.sources.rejects import REJECT_SCHEMA, text_cells
from lapsewise.sources.scratch import scratch_dir, stored
from lapsewise.sources.versions import create_version, read_version
from lapsewise.sources.writers import (
    UPSERT_COLUMNS,
    as_document,
    customer_records,
    execute,
    latest_state,
    upsert,
    write_csv,
    write_json,
    write_parquet,
    write_table,
)
from lapsewise.streaming.monitor import graded_shift, late_rows, mean_by_window, monitor_stream, open_buckets
from lapsewise.streaming.scoring import (
    deduplicated,
    observed,
    quarantine_stream,
    read_customer_stream,
    score_stream,
    upsert_stream,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DRIFT_NUMERIC = ["CreditScore", "Age", "Tenure", "Balance", "NumOfProducts", "EstimatedSalary", "PointEarned"]
DRIFT_TEXT = ["Geography", "Gender", "CardType"]
PROFILE_NUMERIC = [*NUMERIC_FEATURES, "PointEarned", "Exited"]
SNAPSHOT_COLUMNS = [
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
    "PointEarned",
    "CardType",
    "Lapsed",
    "p",
    "u",
    "Exited",
    "customer_uuid",
]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in wide})


# Places kept where six would cut a value of exactly six and a half.
MORE_DIGITS = {"prediction_values": 8}


def query(f: Query) -> Query:
    digits = MORE_DIGITS.get(f.__name__, 6)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(f(spark, sf_dir), digits)

    run.__doc__ = f.__doc__
    QUERIES[f.__name__] = run
    return f


def snap(spark: SparkSession, d: str) -> DataFrame:
    return customer_snapshot(spark, d)


def scored_snap(spark: SparkSession, d: str) -> DataFrame:
    return add_predictions(snap(spark, d), F.col("p"))


def held(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The snapshot columns an operator of several passes reads, written once, so
    that the join of customers and orders is not run again for every pass."""
    return stored(scored_snap(spark, d).select("customer_uuid", *columns), "held")


def dirty(spark: SparkSession, d: str) -> DataFrame:
    return keyed(dirty_customers(snap(spark, d)))


# ---- sources and sinks -------------------------------------------------------


@query
def snapshot(spark, d):
    return snap(spark, d).select(*SNAPSHOT_COLUMNS)


@query
def csv_round_trip(spark, d):
    path = scratch_dir(spark, "raw") + ".csv"
    write_csv(raw_customers(snap(spark, d)), path)
    return read_csv(spark, path, RAW_CUSTOMER_SCHEMA)


@query
def parquet_columns(spark, d):
    path = scratch_dir(spark, "snapshot") + ".parquet"
    write_parquet(snap(spark, d), path, "zstd")
    return read_parquet(spark, path, ["CustomerId", "Balance", "Exited"])


@query
def sql_with_parameters(spark, d):
    snap(spark, d).createOrReplaceTempView("customers")
    return read_query(
        spark,
        "SELECT CustomerId, Balance FROM customers WHERE Geography = :geo AND Balance >= :floor",
        {"geo": "Germany", "floor": 100000.0},
    )


@query
def source_by_suffix(spark, d):
    path = scratch_dir(spark, "by-suffix")
    rows = snap(spark, d).select("CustomerId", "Age", "Balance")
    write_csv(rows, path + ".csv")
    write_parquet(rows, path + ".parquet")
    text = f"SELECT CustomerId, Age, Balance FROM parquet.`{path}.parquet`"
    spark.range(1).select(F.lit(text)).coalesce(1).write.text(path + ".sql")
    found = {
        "csv": load(spark, path + ".csv", schema=rows.schema),
        "parquet": load(spark, path + ".parquet", columns=["CustomerId", "Age", "Balance"]),
        "sql": load(spark, path + ".sql"),
    }
    return reduce(DataFrame.unionByName, [df.withColumn("kind", F.lit(kind)) for kind, df in found.items()])


@query
def sql_over_files(spark, d):
    return query_files(
        spark,
        "SELECT n.n_name, count(*) AS customers, round(sum(c.c_acctbal), 2) AS acctbal"
        " FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
        {"customer": f"{d}/customer.parquet", "nation": f"{d}/nation.parquet"},
    )


@query
def customer_documents(spark, d):
    """Row to JSON text."""
    rows = keyed(raw_customers(snap(spark, d)))
    return rows.select("customer_uuid", as_document(rows).alias("raw_data"))


def _known_and_batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers known at the cut-off, and those seen from then on (known or new)."""
    s = snap(spark, d)
    loaded, later = F.lit(CUTOFF).cast("timestamp"), F.lit("2001-08-02").cast("timestamp")
    known = customer_records(s.where("known = 1"), "ingestion_first", loaded)
    batch = customer_records(s.where("Lapsed = 0"), "ingestion_second", later)
    return known, batch


@query
def upsert_customers(spark, d):
    known, batch = _known_and_batch(spark, d)
    return upsert(known, batch, "customer_uuid", UPSERT_COLUMNS).drop("raw_data")


@query
def job_latest_state(spark, d):
    """The order log read as a job log: one job per customer, one run per order."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_custkey").alias("job_id"),
        F.struct(F.col("o_orderdate"), F.col("o_orderkey")).alias("at"),
        F.col("o_orderdate").alias("event_ts"),
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderstatus").alias("status"),
    )
    return latest_state(orders, "job_id", "at").select("job_id", "event_ts", "run_id", "status")


@query
def quality_report_file(spark, d):
    path = scratch_dir(spark, "report")
    write_json(dr.compare(*_sides(spark, d), DRIFT_NUMERIC), path)
    return spark.read.schema("column string, statistic string, value double").json(path)


@query
def table_write(spark, d):
    """Two appends to a catalog table kept in the shared folder: each customer is there twice."""
    path = scratch_dir(spark, "table")
    name = "customers_" + path.rsplit("-", 1)[-1]
    rows = snap(spark, d).select("customer_uuid", "Age")
    execute(spark, f"CREATE TABLE {name} (customer_uuid STRING, Age INT) USING parquet LOCATION '{path}'")
    write_table(rows, name, "append")
    write_table(rows, name, "append")
    return spark.read.table(name).groupBy("customer_uuid").agg(F.count("*").alias("copies"))


@query
def table_write_modes(spark, d):
    """A catalog table replaced, appended to, and refused; whether it was there before and
    after. The rows are copied before the table is dropped."""
    path = scratch_dir(spark, "table")
    name = "customers_" + path.rsplit("-", 1)[-1]
    rows = stored(snap(spark, d).select("customer_uuid", "known"), "held")
    there = [table_exists(spark, name)]
    try:
        write_table(rows, name, "fail")
        write_table(rows.where("known = 1"), name, "replace")
        write_table(rows, name, "append")
        try:
            write_table(rows, name, "fail")
            refused = False
        except AnalysisException:
            refused = True
        there.append(table_exists(spark, name))
        copies = stored(spark.read.table(name).groupBy("customer_uuid").agg(F.count("*").alias("copies")), "copies")
    finally:
        execute(spark, f"DROP TABLE IF EXISTS {name}")
    there.append(table_exists(spark, name))
    flags = dict(zip(("before", "during", "after"), there)) | {"refused": refused}
    return copies.withColumns({k: F.lit(v) for k, v in flags.items()})


@query
def job_ids(spark, d):
    """A random id for every customer: its form, and how many differ."""
    rows = stored(snap(spark, d).select("customer_uuid", job_id().alias("job_id")), "ids")
    form = F.col("job_id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return rows.select("customer_uuid", form.alias("well_formed"), rows.agg(F.count_distinct("job_id")).scalar().alias("distinct_ids"))


@query
def ingestion_job(spark, d):
    """The whole ingestion job from a CSV delivery to the clean table."""
    source, base = scratch_dir(spark, "delivery") + ".csv", scratch_dir(spark, "ingested")
    write_csv(raw_customers(snap(spark, d)), source)
    done = ingest(spark, source, f"{base}/clean", f"{base}/customers", f"{base}/jobs", schema=RAW_CUSTOMER_SCHEMA)
    return spark.read.parquet(done.clean_path)


def _three_deliveries(spark: SparkSession, d: str) -> tuple[str, str, str]:
    """Customers known at the cut-off, those seen later, and a delivery with faults."""
    base = scratch_dir(spark, "ingested")
    raw = [raw_customers(snap(spark, d).where(c)) for c in ("known = 1", "Lapsed = 0")]
    for i, rows in enumerate([*raw, dirty_customers(snap(spark, d))], 1):
        write_csv(rows, f"{base}/delivery-{i}.csv")
        try:
            ingest(spark, f"{base}/delivery-{i}.csv", f"{base}/clean-{i}", f"{base}/customers", f"{base}/jobs", schema=RAW_CUSTOMER_SCHEMA)
        except qu.ValidationError:
            if i < 3:
                raise
    return base, f"{base}/customers", f"{base}/jobs"


@query
def ingestion_two_deliveries(spark, d):
    """The customers table after two deliveries and a failed one: who came with which."""
    _, customers, jobs = _three_deliveries(spark, d)
    runs = latest_state(spark.read.parquet(jobs)).select(F.col("run_id").alias("ingestion_run_id"), F.regexp_extract("input_path", r"delivery-(\d)", 1).cast("int").alias("delivery"))
    rows = read_version(spark, customers).join(F.broadcast(runs), "ingestion_run_id")
    changed = (F.col("updated_at") > F.col("created_at")).alias("changed")
    return rows.select("customer_uuid", "bank_customer_id", "surname", "delivery", changed)


@query
def ingestion_log(spark, d):
    """What the log says of each job after it ended."""
    _, _, jobs = _three_deliveries(spark, d)
    return latest_state(spark.read.parquet(jobs)).select(
        F.regexp_extract("input_path", r"delivery-(\d)", 1).cast("int").alias("delivery"),
        "status",
        "rows_processed",
        F.col("error_message").startswith("validation failed").alias("invalid"),
    )


def _spoiled_file(spark: SparkSession, d: str) -> str:
    path = scratch_dir(spark, "spoiled") + ".csv"
    write_csv(spoiled_customers(snap(spark, d)), path)
    return path


@query
def rejected_cells_report(spark, d):
    """Failed checks of a delivery with cells that do not fit, counted from its text."""
    cells = normalize(text_cells(spark, _spoiled_file(spark, d), RAW_CUSTOMER_SCHEMA))
    return qu.validation_report(cells, qu.RAW_RULES).where("failures > 0")


@query
def ingestion_quarantine(spark, d):
    """The cells that the ingestion job set aside."""
    base = scratch_dir(spark, "ingested")
    paths = [f"{base}/{n}" for n in ("clean", "customers", "jobs")]
    ingest(spark, _spoiled_file(spark, d), *paths, schema=RAW_CUSTOMER_SCHEMA, quarantine_path=f"{base}/quarantine")
    aside = spark.read.parquet(f"{base}/quarantine").select(
        F.get_json_object("cells", "$.CustomerId").cast("long").alias("CustomerId"), F.explode("rejected").alias("r")
    )
    return aside.select("CustomerId", "r.column", "r.cell")


# ---- projections and filters -------------------------------------------------


@query
def normalized(spark, d):
    return normalize(raw_customers(snap(spark, d)))


@query
def header_alias(spark, d):
    raw = raw_customers(snap(spark, d))
    return first_present(raw, ["Card Type", "CardType", "Card_Type"], "card").select("CustomerId", "card")


@query
def without_leakage(spark, d):
    rows = normalize(raw_customers(snap(spark, d)))
    return rows.drop(*qu.leakage_columns(rows.columns))


@query
def customer_uuid(spark, d):
    return snap(spark, d).select("CustomerId", "customer_uuid")


@query
def pii_masked(spark, d):
    rows = snap(spark, d).select("CustomerId", "Surname", "Age", F.struct("Surname", "Geography").alias("profile"))
    return mask_pii(rows).select("CustomerId", "Surname", "Age", F.col("profile.Surname").alias("inner_surname"), "profile.Geography")


@query
def request_features(spark, d):
    return qu.require_columns(snap(spark, d), REQUEST_FEATURES)


@query
def features_and_target(spark, d):
    rows = snap(spark, d).select(*REQUEST_FEATURES, "Exited")
    x, y = qu.split_target(rows)
    return x.agg(F.count("*").alias("rows"), F.lit(len(x.columns)).cast("long").alias("features")).withColumn(
        "positives", y.agg(F.sum(F.col("Exited").cast("long"))).scalar()
    )


@query
def columns_by_type(spark, d):
    s = snap(spark, d)
    shown = qu.columns_of_type(s, "numeric"), qu.columns_of_type(s, "string")
    return s.agg(
        F.count("*").alias("rows"),
        F.lit(",".join(sorted(shown[0]))).alias("numeric"),
        F.lit(",".join(sorted(shown[1]))).alias("text"),
    )


@query
def coerced_values(spark, d):
    """Text cells to numbers: what does not fit becomes null, fractions are not cut."""
    raw = snap(spark, d).select(
        "CustomerId",
        F.when(F.col("Balance") == 0, F.lit("none")).otherwise(F.col("Balance").cast("string")).alias("Balance"),
        (F.col("Age") / 2).alias("Age"),
    )
    return qu.coerce(raw, [qu.Rule("Balance", "double"), qu.Rule("Age", "int")])


@query
def stamped_scores(spark, d):
    at = F.lit("2001-08-02 06:30:00").cast("timestamp")
    rows = stamp(scored_snap(spark, d), "production", "7", at)
    return rows.select(
        "customer_uuid", "probability", "prediction", "risk_level", "model_stage", "model_version",
        run_id("scoring", False, F.col("scored_at")).alias("run_id"),
    )


@query
def low_credit_count(spark, d):
    return snap(spark, d).where("CreditScore <= 400").agg(F.count("*").alias("customers"))


@query
def selected_customers(spark, d):
    """Range, membership, conjunction and negation in one pushed-down predicate."""
    c = F.col
    return (
        snap(spark, d)
        .where(c("Age").between(30, 50) & c("Geography").isin("France", "Spain") & ~(c("Balance") == 0))
        .where((c("p") >= 0.7) | (c("NumOfProducts") >= 3))
        .select("customer_uuid", "Age", "Geography", "Balance", "p")
    )


@query
def complete_rows(spark, d):
    return dirty(spark, d).dropna("any").select("RowNumber", "customer_uuid", "Balance")


# ---- features ----------------------------------------------------------------


@query
def features(spark, d):
    return fx.add_features(snap(spark, d)).select(
        "customer_uuid", "balance_per_product", "tenure_age_ratio", "is_zero_balance", "high_value_customer", "age_group"
    )


@query
def notebook_features(spark, d):
    return fx.add_exploration_features(snap(spark, d)).select(
        "customer_uuid", "AgeGroup", "HighValueCustomer", "BalancePerProduct", "BalanceToSalaryRatio",
        "IsSingleProduct", "IsMultiProduct", "InactiveLongTenure", "CreditScoreBand", "ZeroBalance",
        "SeniorSingleProduct",
    )


@query
def geo_target_encoding(spark, d):
    rows = sp.stratified_split(held(spark, d, "Exited", "Geography"))
    train = rows.where("split = 'train'")
    return fx.target_encode(train, rows, "Geography", out="GeoChurnRate").select("customer_uuid", "split", "GeoChurnRate")


@query
def filled_and_clipped(spark, d):
    rows = dirty(spark, d).fillna(0.0, subset=["Balance"])
    cut = F.greatest(F.lit(1000.0), F.least(F.lit(200000.0), F.col("Balance")))
    return rows.select("RowNumber", "Balance", cut.alias("clipped"))


@query
def feature_display_names(spark, d):
    c = F.concat
    names = F.array(
        c(F.lit("cat__Geography_"), "Geography"), c(F.lit("cat__CardType_"), "CardType"), F.lit("num__NumOfProducts"),
        c(F.lit("age_group_"), fx.banded(F.col("Age"), fx.AGE_GROUPS, 0, True)),
    )
    names = snap(spark, d).select(F.explode(names).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n")).withColumn("shown", display_name("name"))


# ---- scores and top-K --------------------------------------------------------


@query
def scored(spark, d):
    return scored_snap(spark, d).select("customer_uuid", "probability", "prediction", "risk_level")


@query
def risk_summary(spark, d):
    return tk.score_summary(scored_snap(spark, d))


@query
def scoring_run_summary(spark, d):
    return tk.run_summary(scored_snap(spark, d))


@query
def scoring_job(spark, d):
    """The whole scoring job, with its files read back as rows."""
    out = scratch_dir(spark, "scoring")
    score_customers(snap(spark, d), rule_scorer, out)
    rows = spark.read.parquet(f"{out}/scored").select("customer_uuid", "probability", "risk_level", "model_stage")
    listed = spark.read.option("header", True).csv(f"{out}/top_k").select(
        "customer_uuid", F.col("risk_rank").cast("bigint").alias("risk_rank")
    )
    return rows.join(listed, "customer_uuid", "left")


@query
def top_k(spark, d):
    rows = held(spark, d, "probability", "risk_level")
    return tk.top_k(rows).select("customer_uuid", "probability", "risk_level")


@query
def risk_rank(spark, d):
    return tk.top_k(held(spark, d, "probability"), pct=0.3).select("customer_uuid", "probability", "risk_rank")


@query
def top_five(spark, d):
    return tk.top_k(scored_snap(spark, d), k=5).select("customer_uuid", "probability", "risk_rank")


# ---- evaluation --------------------------------------------------------------


@query
def topk_metrics(spark, d):
    return ev.topk_metrics(held(spark, d, "Exited", "probability"))


@query
def topk_metrics_fixed_k(spark, d):
    return ev.topk_metrics(held(spark, d, "Exited", "probability"), k=100)


@query
def topk_metrics_tied(spark, d):
    """Scores of one decimal: nearly every row is tied, the key decides."""
    rows = held(spark, d, "Exited", "p").withColumn("probability", F.round("p", 1))
    return ev.topk_metrics(rows, pct=0.1, on_zero="nan")


@query
def confusion(spark, d):
    return ev.confusion(scored_snap(spark, d), threshold=0.7)


@query
def roc_auc(spark, d):
    return ev.roc_auc(scored_snap(spark, d))


@query
def pr_auc(spark, d):
    return ev.pr_auc(scored_snap(spark, d))


@query
def average_precision(spark, d):
    return ev.average_precision(scored_snap(spark, d))


@query
def all_metrics(spark, d):
    return ev.all_metrics(held(spark, d, "Exited", "probability"))


@query
def joint_objective(spark, d):
    return ev.joint_objective(ev.all_metrics(held(spark, d, "Exited", "probability"))).select("pr_auc", "top_recall_at_k", "objective")


@query
def metrics_by_segment(spark, d):
    return ev.metrics_by_segment(held(spark, d, "Exited", "probability", "Geography"), "Geography")


@query
def model_comparison(spark, d):
    models = F.array(
        F.struct(F.lit("risk").alias("model"), F.col("p").alias("score")),
        F.struct(F.lit("credit").alias("model"), F.round(1 - F.col("CreditScore") / 1000, 6).alias("score")),
    )
    long = snap(spark, d).select("customer_uuid", F.col("Exited").alias("y"), F.explode(models).alias("m"))
    return ev.model_comparison(stored(long.select("customer_uuid", "y", "m.*"), "long"))


# ---- named analytics and profile ---------------------------------------------


@query
def total_customers(spark, d):
    return snap(spark, d).agg(F.count("*").alias("total_customers"))


@query
def average_balance_by_geography(spark, d):
    return snap(spark, d).groupBy("Geography").agg(F.avg("Balance").alias("average_balance"))


@query
def churn_rate_by_age_group(spark, d):
    age = F.col("Age")
    group = F.when(age < 30, "Under 30").when(age.between(30, 50), "30-50").otherwise("Over 50")
    return pr.group_rate(snap(spark, d), group, "age_group").select("age_group", F.col("rate").alias("churn_rate"))


@query
def min_max_tenure(spark, d):
    return snap(spark, d).agg(F.min("Tenure").alias("min_tenure"), F.max("Tenure").alias("max_tenure"))


@query
def churn_rate_by_products(spark, d):
    return pr.group_rate(snap(spark, d), "NumOfProducts", "products")


@query
def churn_rate_by_card(spark, d):
    return pr.group_rate(snap(spark, d), "CardType", "card")


@query
def numeric_describe(spark, d):
    return pr.numeric_describe(held(spark, d, *PROFILE_NUMERIC), PROFILE_NUMERIC)


@query
def string_describe(spark, d):
    return pr.string_describe(snap(spark, d), ["Surname", *DRIFT_TEXT])


@query
def group_describe(spark, d):
    return pr.group_describe(held(spark, d, "Exited", "Age"), ["Exited"], "Age")


@query
def median_by_two_keys(spark, d):
    return pr.group_median(held(spark, d, "Geography", "Exited", "Age"), ["Geography", "Exited"], "Age")


@query
def value_counts(spark, d):
    return pr.value_counts(snap(spark, d), "CardType")


@query
def target_distribution(spark, d):
    return pr.target_distribution(snap(spark, d))


@query
def crosstab(spark, d):
    return pr.crosstab(snap(spark, d), F.col("Geography"), "Geography")


@query
def binned_crosstab(spark, d):
    bands = [(e, f"{e - 100 if e > 400 else 0}-{e}") for e in (400, 500, 600, 700, 800, 900)]
    band = fx.banded(F.col("CreditScore"), bands, 0, right_closed=True)
    return pr.crosstab(snap(spark, d), band, "band", normalize=True)


@query
def target_correlation(spark, d):
    return pr.target_correlation(snap(spark, d), columns=[*NUMERIC_FEATURES, "PointEarned"], n=5)


@query
def corr_matrix(spark, d):
    return pr.corr_matrix(snap(spark, d), DRIFT_NUMERIC)


@query
def cov_matrix(spark, d):
    rows = snap(spark, d)
    return pr.cov_matrix(rows.withColumns({c: F.col(c) / 1000 for c in ("Balance", "EstimatedSalary")}), DRIFT_NUMERIC)


@query
def distinct_counts(spark, d):
    return pr.distinct_counts(snap(spark, d), [c for c in SNAPSHOT_COLUMNS if c not in ("p", "u")])


@query
def constant_columns(spark, d):
    rows = snap(spark, d).select("Age", "Gender", "Exited", F.lit("EUR").alias("currency"), F.lit(None).cast("int").alias("branch"))
    return pr.constant_columns(rows)


@query
def column_stats(spark, d):
    return pr.column_stats(snap(spark, d), PROFILE_NUMERIC, ["Geography"])


@query
def column_roles(spark, d):
    shown = [c for c in SNAPSHOT_COLUMNS if c not in ("p", "u", "Lapsed", "customer_uuid")]
    return pr.column_roles(held(spark, d, *shown))


@query
def avg_rank(spark, d):
    return pr.average_rank(held(spark, d, "Balance"), "Balance")


@query
def five_number(spark, d):
    return pr.five_number(held(spark, d, "Exited", "Age", "Balance", "CreditScore"), ["Exited"], ["Age", "Balance", "CreditScore"])


@query
def histogram(spark, d):
    return pr.histogram(snap(spark, d), "Age", 10)


@query
def salary_quantiles(spark, d):
    return quantiles(held(spark, d, "EstimatedSalary"), ["EstimatedSalary"], [0.01, 0.1, 0.5, 0.9, 0.99])


# ---- quality -----------------------------------------------------------------


@query
def raw_validation_report(spark, d):
    return qu.validation_report(dirty(spark, d), qu.RAW_RULES)


@query
def training_validation_report(spark, d):
    rows = stored(dirty(spark, d), "dirty")
    return qu.validation_report(rows.drop(*qu.leakage_columns(rows.columns)), qu.TRAINING_RULES, strict=True)


@query
def row_errors(spark, d):
    rows = qu.row_errors(dirty(spark, d), qu.RAW_RULES)
    return rows.where(F.size("errors") > 0).select("RowNumber", F.concat_ws(",", F.sort_array("errors")).alias("errors"))


@query
def class_balance(spark, d):
    return qu.class_balance(snap(spark, d))


@query
def missing_share(spark, d):
    return qu.missing_share(dirty(spark, d))


@query
def null_cells(spark, d):
    return qu.null_cells(dirty(spark, d))


@query
def duplicate_count(spark, d):
    return qu.duplicate_count(dirty(spark, d).drop("RowNumber"))


@query
def distinct_rows(spark, d):
    return dirty(spark, d).drop("RowNumber").distinct()


@query
def first_per_customer(spark, d):
    return qu.keep_first(dirty(spark, d)).select("customer_uuid", "RowNumber", "Balance")


@query
def cleaned(spark, d):
    return qu.clean(dirty(spark, d))


@query
def clean_report(spark, d):
    return qu.clean_report(stored(dirty(spark, d), "dirty"))


@query
def correlated_leakage(spark, d):
    rows = normalize(raw_customers(snap(spark, d)))
    return qu.correlated_leakage(rows, ["Complain", "Age", "Balance", "CreditScore"])


# ---- drift and alerts --------------------------------------------------------


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ref = stored(snap(spark, d).select("customer_uuid", "Exited", "p", "IsActiveMember", "Surname", *DRIFT_NUMERIC, *DRIFT_TEXT), "held")
    return ref, shifted_customers(ref)


@query
def psi(spark, d):
    return dr.psi(*_sides(spark, d), DRIFT_NUMERIC)


@query
def ks(spark, d):
    return dr.ks(*_sides(spark, d), [*DRIFT_NUMERIC, "Surname"])


@query
def corr_diff(spark, d):
    return dr.corr_diff(*_sides(spark, d), DRIFT_NUMERIC)


@query
def column_drift(spark, d):
    return dr.column_drift(*_sides(spark, d), [*DRIFT_NUMERIC, *DRIFT_TEXT])


@query
def data_drift(spark, d):
    rows = dr.data_drift(dr.column_drift(*_sides(spark, d), [*DRIFT_NUMERIC, *DRIFT_TEXT]))
    names = F.concat_ws(",", F.array_sort(F.map_keys("drifted_columns")))
    return rows.withColumn("drifted_columns", names)


@query
def prediction_drift(spark, d):
    return dr.prediction_drift(*_sides(spark, d), p="p")


@query
def performance_drift(spark, d):
    return dr.performance_drift(*_sides(spark, d), p="p")


def _monitored(spark: SparkSession, d: str):
    return monitor(*_sides(spark, d), [*DRIFT_NUMERIC, *DRIFT_TEXT], p="p")


@query
def alerts(spark, d):
    return _monitored(spark, d).alerts.select("position", "alert_type", "severity", "message")


@query
def retrain_decision(spark, d):
    return _monitored(spark, d).decision.withColumn("reasons", F.concat_ws(" | ", "reasons"))


def _nation_results(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drift results by nation: the place of a nation by its number of customers, from 0 to
    1, stands for the share of drifted columns, a shift of the mean and a drop."""
    sizes = spark.read.parquet(f"{d}/customer.parquet").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    # As many rows as there are nations.
    place = (F.row_number().over(Window.orderBy("n", "nation")) - 1) / (F.count("*").over(Window.partitionBy()) - 1)
    rows = stored(sizes.select("nation", place.alias("x")), "nations")
    data = rows.select("nation", (F.col("x") > 0.1).alias("drift_detected"), F.col("x").alias("drift_share"))
    shift = (F.col("x") - 0.5) * 0.571313
    prediction = rows.select("nation", (F.abs(shift) > 0.03).alias("prediction_drift_detected"), shift.alias("mean_shift"))
    drop = (1 - F.col("x")) * 0.2137
    performance = rows.select("nation", (drop > 0.02).alias("performance_degraded"), drop.alias("pr_auc_drop"))
    return data, prediction, performance


@query
def alerts_by_nation(spark, d):
    """Every alert at every severity, and none."""
    rows = al.alerts(*_nation_results(spark, d), by=["nation"])
    return rows.select("nation", "position", "alert_type", "severity", "message")


@query
def decisions_by_nation(spark, d):
    """Decisions with all reasons and none, through each of the four approval settings."""
    data, prediction, performance = _nation_results(spark, d)
    rows = al.alerts(data, prediction, performance, by=["nation"])
    decision = al.retrain_decision(data, performance, rows, by=["nation"])
    gates = [
        al.approval(decision, asked, auto).withColumns({"asked": F.lit(asked), "auto": F.lit(auto)})
        for asked in (True, False)
        for auto in (True, False)
    ]
    return reduce(DataFrame.unionByName, gates).withColumn("reasons", F.concat_ws(" | ", "reasons"))


@query
def column_drift_of_all(spark, d):
    """The feature columns chosen by the operator: no label, score or identifier."""
    ref, cur = (side.withColumnRenamed("p", "probability") for side in _sides(spark, d))
    return dr.column_drift(ref, cur)


@query
def monitoring_report(spark, d):
    return _monitored(spark, d).report()


@query
def retraining_report(spark, d):
    return al.retraining_report(_monitored(spark, d).decision)


@query
def drift_report_file(spark, d):
    path = scratch_dir(spark, "drift")
    write_json(dr.column_drift(*_sides(spark, d), [*DRIFT_NUMERIC, *DRIFT_TEXT]), path)
    return spark.read.schema("column string, method string, value double, drifted boolean").json(path)


# ---- split, preprocessing, models --------------------------------------------


@query
def stratified_split(spark, d):
    return sp.stratified_split(held(spark, d, "Exited")).select("customer_uuid", "Exited", "split")


@query
def stratified_split_by_score(spark, d):
    """Hundreds of classes: one for each credit score."""
    return sp.stratified_split(held(spark, d, "CreditScore"), label="CreditScore").select("customer_uuid", "CreditScore", "split")


@query
def one_hot_surnames(spark, d):
    """As many categories as known customers have names, as sparse vectors: the slot of each
    customer's name (null where it is unknown) and the size of the vector."""
    rows = stored(snap(spark, d).select("customer_uuid", "Surname", "known"), "held")
    coded = pp.one_hot_vectors(rows, "Surname", pp.category_slots(rows.where("known = 1"), "Surname"), "vector")
    text = F.col("vector").cast("string")
    slot = F.regexp_extract(text, r"^\((\d+),\[(\d+)\]", 2)
    size = F.regexp_extract(text, r"^\((\d+),", 1).cast("long")
    return coded.select("customer_uuid", F.when(slot != "", slot.cast("long")).alias("slot"), size.alias("size"))


@query
def scaled_features(spark, d):
    cols = ["CreditScore", "Age", "Balance"]
    rows = sp.stratified_split(held(spark, d, "Exited", *cols)).select("customer_uuid", "split", *cols)
    return pp.scale(rows, cols, pp.scale_stats(rows.where("split = 'train'"), cols))


@query
def one_hot(spark, d):
    rows = held(spark, d, "Geography", "CardType")
    return pp.one_hot(rows, pp.fitted_categories(rows, ["Geography", "CardType"]))


@query
def one_hot_drop_first(spark, d):
    rows = held(spark, d, "Geography")
    return pp.one_hot(rows, pp.fitted_categories(rows, ["Geography"]), drop_first=True)


@query
def class_weights(spark, d):
    return sp.class_weights(held(spark, d, "Exited"))


@query
def positive_weight(spark, d):
    return sp.positive_weight(snap(spark, d))


def _explained(spark: SparkSession, d: str, n: int) -> DataFrame:
    rows = held(spark, d, "risk_level", "Age", "Balance", "IsActiveMember", "NumOfProducts").withColumn(
        "IsSingleProduct", (F.col("NumOfProducts") == 1).cast("int")
    )
    means = rows.agg(*[F.avg(c).alias(c) for c in RISK_WEIGHTS])
    return ex.linear_contributions(rows, RISK_WEIGHTS, means, n)


@query
def linear_contributions(spark, d):
    return ex.contribution_rows(_explained(spark, d, 3))


@query
def prediction_values(spark, d):
    return _explained(spark, d, 3).select("customer_uuid", "base_value", "prediction_value")


@query
def recommendations(spark, d):
    rows = ex.recommend(_explained(spark, d, 10))
    return rows.select("customer_uuid", "risk_level", F.concat_ws(" | ", "recommendations").alias("recommendations"))


def _split_rows(spark: SparkSession, d: str) -> DataFrame:
    return stored(sp.stratified_split(stored(snap(spark, d), "held")), "split")


@query
def gbt_scored(spark, d):
    rows = _split_rows(spark, d)
    return tr.predict(tr.fit(rows, tr.boosted_trees()), rows).select("customer_uuid", "probability", "prediction", "risk_level")


@query
def model_metrics_by_split(spark, d):
    rows = _split_rows(spark, d)
    return tr.evaluate_splits(tr.fit(rows, tr.candidates()["logistic_regression"]), rows)


@query
def feature_importance(spark, d):
    rows = _split_rows(spark, d)
    return tr.feature_importance(tr.fit(rows, tr.boosted_trees()), spark)


@query
def tuned_params(spark, d):
    """The trials of a short sequential search, with those pruned."""
    return trials_table(spark, tr.optimize(_split_rows(spark, d), 6))


@query
def tree_contributions(spark, d):
    rows = _split_rows(spark, d)
    model = tr.fit(rows, tr.boosted_trees())
    return ex.contribution_rows(ex.tree_contributions(rows, model, pp.feature_names(model), n=3))


@query
def training_report(spark, d):
    """Test PR-AUC of two scores of the same split, the credit score and the risk score, as
    baseline and tuned model, with the weights of the risk score as importances."""
    rows = _split_rows(spark, d)
    before, after = (
        stored(ev.all_metrics(rows.withColumn("s", s), "Exited", "s", "customer_uuid", by=["split"]), "metrics")
        for s in (1 - F.col("CreditScore") / 1000, F.col("p"))
    )
    means = rows.agg(*[(F.avg(c) * abs(w)).alias(c) for c, w in RISK_WEIGHTS.items() if c in rows.columns])
    importance = means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in means.columns])).alias("r")).select("r.*")
    return tr.training_summary(before, after, importance, n=2)


@query
def saved_model_scores(spark, d):
    """A model trained and saved once that scores the customers into a table twice: copies of
    each customer, and whether both runs gave the same."""
    base, rows = scratch_dir(spark, "models"), _split_rows(spark, d)
    promote(spark, base, save_model(tr.fit(rows, tr.candidates()["logistic_regression"]), base))
    source, name = scratch_dir(spark, "source") + ".parquet", "scores_" + base.rsplit("-", 1)[-1]
    write_parquet(rows.drop("split"), source)
    try:
        for mode in ("replace", "append"):
            score_to_table(spark, source, base, name, mode)
        scores = spark.read.table(name).groupBy("customer_uuid").agg(F.count("*").alias("copies"), (F.count_distinct("probability") == 1).alias("same"))
        return stored(scores, "copies")
    finally:
        execute(spark, f"DROP TABLE IF EXISTS {name}")


@query
def conditional_churn(spark, d):
    rows = stored(dirty(spark, d).select("RowNumber", "Age", "Balance", "Exited"), "held")
    return rows.select("RowNumber", tr.conditional_model(rows).probability().alias("probability"))


# ---- streaming ---------------------------------------------------------------


def _raw_files(spark: SparkSession, d: str, rows: DataFrame) -> str:
    path = scratch_dir(spark, "incoming")
    write_csv(rows.repartition(4, "CustomerId"), path)
    return path


def _by_id_scorer(rows: DataFrame) -> DataFrame:
    return rule_scorer(rows).select("CustomerId", "Geography", "CardType", "probability", "prediction", "risk_level")


@query
def stream_scored(spark, d):
    incoming = _raw_files(spark, d, raw_customers(snap(spark, d)))
    out, mark = scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-mark")
    score_stream(spark, incoming, _by_id_scorer, out, mark, files_per_trigger=2).awaitTermination()
    return spark.read.parquet(out)


@query
def stream_rejected(spark, d):
    """Files with cells that do not fit: who is scored, who is set aside, and how many rows
    the quarantine stream counted."""
    incoming = _raw_files(spark, d, spoiled_customers(snap(spark, d)))
    out, aside = scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-aside")
    score_stream(spark, incoming, _by_id_scorer, out, scratch_dir(spark, "stream-mark")).awaitTermination()
    query = quarantine_stream(spark, incoming, aside, scratch_dir(spark, "stream-mark"))
    query.awaitTermination()
    seen = observed([query], "cells")
    rejected = spark.read.schema(REJECT_SCHEMA).parquet(aside).select(F.get_json_object("cells", "$.CustomerId").cast("long").alias("CustomerId"), F.lit("rejected").alias("status"))
    scored = spark.read.parquet(out).select("CustomerId", F.lit("scored").alias("status"))
    counts = {"rows_seen": F.lit(seen.get("rows", 0)), "rows_rejected": F.lit(seen.get("rejected", 0))}
    return scored.union(rejected).withColumns({k: v.cast("long") for k, v in counts.items()})


@query
def stream_upserted(spark, d):
    """Customers seen later, in two streams: the second has a checkpoint of its own and goes
    on from the version that the first one left."""
    known, batch = _known_and_batch(spark, d)
    base = scratch_dir(spark, "versions")
    create_version(known, base, "customer_uuid")
    for name, half in (("first", "bank_customer_id % 2 = 0"), ("second", "bank_customer_id % 2 = 1")):
        incoming = scratch_dir(spark, f"upserts-{name}")
        batch.where(half).repartition(2, "customer_uuid").write.parquet(incoming)
        arriving = spark.readStream.schema(batch.schema).parquet(incoming)
        upsert_stream(arriving, base, scratch_dir(spark, "stream-mark"), UPSERT_COLUMNS).awaitTermination()
    return read_version(spark, base).drop("raw_data")


@query
def stream_deduplicated(spark, d):
    incoming = _raw_files(spark, d, dirty_customers(snap(spark, d)))
    rows = keyed(read_customer_stream(spark, incoming)).withColumn("delivered_at", F.lit("2001-08-02").cast("timestamp"))
    out, mark = scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-mark")
    once = deduplicated(rows, "delivered_at").select("customer_uuid", "CustomerId")
    once.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.parquet(out)


def _event_scores(events: DataFrame) -> DataFrame:
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100))
    return events.select(F.col("ts").cast("timestamp").alias("ts"), p.alias("p"))


@query
def prediction_mean_by_day(spark, d):
    rows = _event_scores(spark.read.parquet(f"{d}/events.parquet"))
    graded = graded_shift(mean_by_window(rows, "ts", "p"), rows.agg(F.avg("p")).scalar())
    return graded.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query
def stream_mean_by_day(spark, d):
    """Graded buckets from a stream in append mode. Events come in two deliveries, then those
    of the first day once more, too late, and at last one that closes the open buckets."""
    events = _event_scores(spark.read.parquet(f"{d}/events.parquet"))
    ends = events.agg(F.min("ts"), F.max("ts"), F.avg("p")).first()
    first_day, middle = ends[0].date() + timedelta(days=1), ends[0] + (ends[1] - ends[0]) / 2
    until = ends[1] + timedelta(days=2)
    closing = spark.range(1).select(F.lit(until + timedelta(days=2)).alias("ts"), F.lit(0.0).alias("p"))
    deliveries = [events.where(F.col("ts") < middle), events.where(F.col("ts") >= middle), events.where(F.col("ts") < F.lit(first_day)), closing]
    incoming, out, mark = (scratch_dir(spark, f"stream-{n}") for n in ("in", "out", "mark"))
    queries = []
    for rows in deliveries:
        rows.write.mode("append").parquet(incoming)
        source = spark.readStream.schema(events.schema).parquet(incoming)
        queries.append(monitor_stream(source, "ts", "p", ends[2], out, mark, until=until))
        queries[-1].awaitTermination()
    closed = spark.read.parquet(out)
    late = late_rows(closed, observed(queries, "arrivals")["rows"])
    closed = closed.crossJoin(late).withColumn("open_buckets", F.lit(open_buckets(queries[-1])))
    return closed.withColumn("start", F.date_format("start", "yyyy-MM-dd"))
