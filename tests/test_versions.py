import pytest
from pyspark.errors import PySparkException

from lapsewise.sources import versions
from lapsewise.sources.versions import create_version, current_version, merge_version, read_version, version_at

COLS = "k string, v long, first long, at long"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def base(tmp_path):
    return str(tmp_path / "table")


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS)


def test_merge_reads_and_writes_the_touched_buckets_only(spark, base):
    create_version(frame(spark, [(f"k{i}", i, 0, 0) for i in range(400)]), base, "k", buckets=16)
    merge_version(frame(spark, [("k7", 70, 1, 1), ("new", 1, 1, 1)]), base, ["v", "at"])
    old, new = version_at(spark, base, 0), version_at(spark, base)
    assert (old.number, new.number) == (0, 1)
    moved = [k for k in range(16) if old.folders[k] != new.folders[k]]
    assert 1 <= len(moved) <= 2
    want = {f"k{i}": (i, 0, 0) for i in range(400)} | {"k7": (70, 0, 1), "new": (1, 1, 1)}
    assert rows_of(read_version(spark, base)) == sorted((k, *v) for k, v in want.items())
    assert read_version(spark, base, 0).count() == 400


def test_a_job_that_dies_leaves_the_table_as_it_was(spark, base, monkeypatch):
    create_version(frame(spark, [("a", 1, 0, 0)]), base, "k")
    monkeypatch.setattr(versions, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        merge_version(frame(spark, [("a", 2, 1, 1)]), base, ["v"])
    monkeypatch.undo()
    assert rows_of(read_version(spark, base)) == [("a", 1, 0, 0)]
    # Dying while the manifest itself is written leaves no file that can be seen.
    broken = spark.range(1).selectExpr("raise_error('lost') as writer", "'x' as kind", "0L as number", "'' as text")
    with pytest.raises(PySparkException):
        broken.write.mode("append").parquet(f"{base}/manifest/version=1")
    assert current_version(spark, base) == 0
    assert merge_version(frame(spark, [("a", 2, 1, 1)]), base, ["v"]) == 1
    assert rows_of(read_version(spark, base)) == [("a", 2, 0, 0)]


def test_batches_of_a_stream_count_once(spark, base):
    create_version(frame(spark, []), base, "k")
    assert rows_of(read_version(spark, base)) == []
    assert merge_version(frame(spark, [("a", 1, 1, 1), ("a", 2, 2, 2)]), base, ["v"], ("s", 0), order="at") == 1
    assert merge_version(frame(spark, [("a", 9, 9, 9)]), base, ["v"], ("s", 0), order="at") == 1
    assert merge_version(frame(spark, [("a", 3, 3, 3)]), base, ["v"], ("s", 1), order="at") == 2
    assert merge_version(frame(spark, [("b", 3, 3, 3)]), base, ["v"], ("other", 0), order="at") == 3
    assert merge_version(frame(spark, []), base, ["v"], ("other", 1), order="at") == 4
    assert rows_of(read_version(spark, base)) == [("a", 3, 2, 2), ("b", 3, 3, 3)]
    assert version_at(spark, base).sources == {"s": 1, "other": 1}


def test_misuse(spark, base):
    with pytest.raises(ValueError, match="no version"):
        read_version(spark, base)
    create_version(frame(spark, [("a", 1, 0, 0)]), base, "k")
    with pytest.raises(ValueError, match="there is a table"):
        create_version(frame(spark, []), base, "k")
    versions._publish(spark, base, versions.Version(1, version_at(spark, base).schema, "k", 32, {}))
    with pytest.raises(RuntimeError, match="two writers"):
        versions._publish(spark, base, versions.Version(1, version_at(spark, base).schema, "k", 32, {}))
