import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lapsewise.config import KEY
from lapsewise.operators.quality import ValidationError
from lapsewise.plans.batch_scoring import rule_scorer, score_customers
from lapsewise.plans.ingestion import ingest
from lapsewise.plans.snapshot import customer_snapshot, dirty_customers, raw_customers
from lapsewise.sources.readers import RAW_CUSTOMER_SCHEMA, load, query_files, read_csv, read_parquet, read_query, table_exists
from lapsewise.sources.scratch import scratch_dir, settled, stored
from lapsewise.sources.versions import read_version
from lapsewise.sources.writers import UPSERT_COLUMNS, execute, latest_state, upsert, write_csv, write_parquet, write_table



@pytest.fixture
def small(spark):
    return spark.createDataFrame([(1, 1.5, "a", True), (2, 2.5, "b", False), (3, 3.5, " c ", True)], "i int, f double, s string, b boolean")


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("compression", ["snappy", "gzip", "zstd"])
def test_parquet_round_trip_and_overwrite(spark, small, tmp_path, compression):
    path = str(tmp_path / "deep" / "t.parquet")
    write_parquet(small, path, compression)
    write_parquet(small.limit(2), path, compression)
    assert read_parquet(spark, path).count() == 2
    assert read_parquet(spark, path, ["s"]).columns == ["s"]
    with pytest.raises(ValueError):
        write_parquet(small, path, "lzw")


def test_csv_round_trip(spark, small, tmp_path):
    path = str(tmp_path / "t.csv")
    write_csv(small, path)
    assert same(read_csv(spark, path, small.schema), small)
    assert same(load(spark, path), small)
    with pytest.raises(AnalysisException):
        read_csv(spark, str(tmp_path / "absent.csv")).count()


def test_csv_quotes(spark, tmp_path):
    odd = spark.createDataFrame([('say "hi", x', 1), ('back\\slash', 2), ('"', 3), ("a,b", 4)], "a string, b int")
    path = str(tmp_path / "q.csv")
    write_csv(odd, path)
    assert same(read_csv(spark, path, odd.schema), odd)
    (tmp_path / "other.csv").write_text('a,b\n"say ""hi"", x",1\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "other.csv"), odd.schema).collect()] == [('say "hi", x', 1)]


def test_two_deliveries(spark, tmp_path, sf_dir):
    raw = raw_customers(customer_snapshot(spark, sf_dir))
    paths = [str(tmp_path / n) for n in ("clean", "customers", "jobs")]
    for i, rows in enumerate((raw.where("CustomerId % 2 = 0"), raw.where("CustomerId % 3 = 0"))):
        write_csv(rows, str(tmp_path / f"in{i}.csv"))
        ingest(spark, str(tmp_path / f"in{i}.csv"), *paths, schema=RAW_CUSTOMER_SCHEMA)
    customers = read_version(spark, paths[1])
    assert customers.count() == customers.select("bank_customer_id").distinct().count() == raw.where("CustomerId % 2 = 0 or CustomerId % 3 = 0").count()


def test_load_dispatch(spark, small, tmp_path):
    write_parquet(small, str(tmp_path / "t.parquet"))
    small.createOrReplaceTempView("small_view")
    (tmp_path / "q.sql").write_text("SELECT i FROM small_view WHERE i > :low")
    assert load(spark, str(tmp_path / "q.sql"), params={"low": 1}).count() == 2
    assert load(spark, "SELECT s FROM small_view", kind="sql").columns == ["s"]
    assert load(spark, str(tmp_path / "t.parquet"), columns=["f"]).columns == ["f"]
    for bad in ({"source": "x.txt"}, {"source": "x", "kind": "xml"}):
        with pytest.raises(ValueError):
            load(spark, **bad)
    with pytest.raises(ValueError):
        read_query(spark, "SELECT 1", {"a": 1}, jdbc={"url": "jdbc:none"})


def test_query_files(spark, small, tmp_path):
    write_parquet(small, str(tmp_path / "part1.parquet"))
    write_parquet(small, str(tmp_path / "part2.parquet"))
    out = query_files(spark, "SELECT count(*) AS n FROM t", {"t": str(tmp_path / "part*.parquet")})
    assert out.first()["n"] == 6
    with pytest.raises(ValueError):
        query_files(spark, "SELECT 1", {"bad name": "x.parquet"})
    with pytest.raises(ValueError):
        query_files(spark, "SELECT 1", {"t": "x.sql"})


def test_tables(spark, small):
    name = "io_test_table"
    assert not table_exists(spark, name) and not table_exists(spark, "not a table name")
    write_table(small, name)
    write_table(small, name, "append")
    assert table_exists(spark, name) and spark.read.table(name).count() == 6
    with pytest.raises(AnalysisException):
        write_table(small, name, "fail")
    write_table(small, name, "replace")
    assert spark.read.table(name).count() == 3
    execute(spark, f"INSERT INTO {name} VALUES (:i, 0.5, 'z', true)", {"i": 9})
    assert spark.read.table(name).where("i = 9").count() == 1
    with pytest.raises(ValueError):
        write_table(small, name, "merge")
    execute(spark, f"DROP TABLE {name}")


def test_upsert_keeps_first_seen_values(spark):
    cols = "customer_uuid string, surname string, raw_data string, ingestion_run_id string, created_at int, updated_at int"
    old = spark.createDataFrame([("a", "Old", "{}", "r1", 1, 1), ("b", "Bee", "{}", "r1", 1, 1)], cols)
    new = spark.createDataFrame([("a", "New", "{n}", "r2", 2, 2), ("c", "Cee", "{c}", "r2", 2, 2)], cols)
    out = {r[0]: tuple(r)[1:] for r in upsert(old, new, KEY, UPSERT_COLUMNS).collect()}
    assert out == {"a": ("Old", "{n}", "r2", 1, 2), "b": ("Bee", "{}", "r1", 1, 1), "c": ("Cee", "{c}", "r2", 2, 2)}
    again = upsert(upsert(old, new, KEY, UPSERT_COLUMNS), new, KEY, UPSERT_COLUMNS)
    assert {r[0]: tuple(r)[1:] for r in again.collect()} == out
    assert same(upsert(old, new.limit(0), KEY, UPSERT_COLUMNS), old)


def test_intermediate_tables_go_to_the_shared_folder(spark, small):
    assert scratch_dir(spark, "t").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert same(stored(small, "t"), small)
    assert settled(small.limit(1)).count() == 1
    with pytest.raises(ValueError):
        settled(small)


def test_ingestion_flow(spark, tmp_path, sf_dir):
    snap = customer_snapshot(spark, sf_dir)
    source, paths = str(tmp_path / "in.csv"), {n: str(tmp_path / n) for n in ("clean", "customers", "jobs")}
    write_csv(raw_customers(snap), source)
    done = ingest(spark, source, paths["clean"], paths["customers"], paths["jobs"], schema=RAW_CUSTOMER_SCHEMA)
    clean = spark.read.parquet(paths["clean"])
    assert done.rows == clean.count() == snap.count()
    assert not {"CustomerId", "Surname", "Complain", "Satisfaction Score"} & set(clean.columns)
    customers = read_version(spark, paths["customers"])
    assert customers.columns[:3] == ["customer_uuid", "bank_customer_id", "surname"]
    assert '"CreditScore":' in customers.first()["raw_data"]
    jobs = spark.read.parquet(paths["jobs"])
    state = latest_state(jobs).first()
    assert jobs.count() == 2 and state["status"] == "completed" and state["rows_processed"] == done.rows

    bad = str(tmp_path / "bad.csv")
    write_csv(dirty_customers(snap), bad)
    with pytest.raises(ValidationError):
        ingest(spark, bad, paths["clean"] + "2", paths["customers"] + "2", paths["jobs"], schema=RAW_CUSTOMER_SCHEMA)
    failed = latest_state(spark.read.parquet(paths["jobs"])).where("status = 'failed'").first()
    assert "validation failed" in failed["error_message"]


def test_scoring_flow(spark, customers, tmp_path):
    out = str(tmp_path / "scores")
    summary = score_customers(customers.drop("probability", "prediction", "risk_level"), rule_scorer, out).first()
    n = customers.count()
    assert summary["total_scored"] == n and summary["top_k"] == int(n * 0.15)
    listed = spark.read.option("header", True).csv(f"{out}/top_k")
    ranks = sorted(int(r["risk_rank"]) for r in listed.collect())
    assert ranks == list(range(1, summary["top_k"] + 1))
    assert spark.read.parquet(f"{out}/scored").where(F.col("scored_at").isNull()).count() == 0
