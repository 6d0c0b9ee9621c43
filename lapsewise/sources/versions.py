"""A keyed Parquet table in versions: what is written is never changed.

Rows lie in hash buckets of their key. A merge reads and rewrites only the buckets that the
batch touches, into a new folder; a manifest then lists the folder of every bucket. The
manifest is a single small file that is written last and appears at once, so a job that
dies before leaves the version before it as it was, and readers of older versions keep
their files.

    base/data/<run>/_bucket=<k>/...      rows
    base/manifest/version=<n>/...        which folder holds which bucket

One writer at a time: two that publish the same version are found out and refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapsewise.sources.scratch import stored
from lapsewise.sources.writers import upsert

BUCKET = "_bucket"
BUCKETS = 32
MANIFEST = "writer string, kind string, number long, text string"


@dataclass(frozen=True)
class Version:
    """One manifest: the columns, where each bucket lies, the last batch of each source."""

    number: int
    schema: T.StructType
    key: str
    buckets: int
    folders: dict[int, str]
    sources: dict[str, int] = field(default_factory=dict)

    def rows(self) -> list[tuple[str, int, str]]:
        return [
            ("table", self.buckets, self.schema.json()),
            ("key", 0, self.key),
            *(("bucket", k, folder) for k, folder in sorted(self.folders.items())),
            *(("source", batch, name) for name, batch in sorted(self.sources.items())),
        ]


def _manifests(spark: SparkSession, base: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{MANIFEST}, version long").parquet(f"{base}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current_version(spark: SparkSession, base: str) -> int | None:
    """Number of the newest complete version; None where there is no table yet."""
    manifests = _manifests(spark, base)
    return None if manifests is None else manifests.agg(F.max("version")).first()[0]


def version_at(spark: SparkSession, base: str, number: int | None = None) -> Version:
    """A version by number, by default the newest."""
    number = current_version(spark, base) if number is None else number
    manifests = _manifests(spark, base)
    rows = manifests.where(F.col("version") == number).collect() if manifests is not None and number is not None else []
    if not rows:
        raise ValueError(f"no version {number} of the table at {base}")
    if len({r["writer"] for r in rows}) > 1:
        raise RuntimeError(f"two writers published version {number} of {base}")
    of = {kind: {r["number"]: r["text"] for r in rows if r["kind"] == kind} for kind in ("table", "key", "bucket")}
    (buckets, schema), *_ = of["table"].items()
    sources = {r["text"]: r["number"] for r in rows if r["kind"] == "source"}
    return Version(number, T.StructType.fromJson(json.loads(schema)), of["key"][0], buckets, of["bucket"], sources)


def _publish(spark: SparkSession, base: str, version: Version) -> int:
    """Write the manifest, which makes the version exist."""
    writer = uuid.uuid4().hex
    rows = spark.createDataFrame([(writer, *r) for r in version.rows()], MANIFEST)
    # A write that died here before has left no file, and does not stand in the way.
    rows.coalesce(1).write.mode("append").parquet(f"{base}/manifest/version={version.number}")
    return version_at(spark, base, version.number).number


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(buckets)).cast("int")


def _write(df: DataFrame, base: str, key: str, buckets: int) -> str:
    """Rows by bucket in a new folder, the buckets spread over tasks of a good size."""
    folder = f"data/{uuid.uuid4().hex}"
    dealt = df.withColumn(BUCKET, _bucket(key, buckets)).hint("rebalance", BUCKET)
    dealt.write.partitionBy(BUCKET).parquet(f"{base}/{folder}")
    return folder


def _read(spark: SparkSession, base: str, version: Version, buckets: Sequence[int]) -> DataFrame:
    paths = [f"{base}/{version.folders[k]}" for k in buckets if k in version.folders]
    return spark.read.schema(version.schema).parquet(*paths) if paths else spark.createDataFrame([], version.schema)


def read_version(spark: SparkSession, base: str, number: int | None = None) -> DataFrame:
    """All rows of a version, by default the newest."""
    version = version_at(spark, base, number)
    return _read(spark, base, version, sorted(version.folders))


def create_version(df: DataFrame, base: str, key: str, buckets: int = BUCKETS) -> int:
    """Version 0 of a table, of rows that hold each key once."""
    spark = df.sparkSession
    if current_version(spark, base) is not None:
        raise ValueError(f"there is a table at {base}")
    folder = _write(df, base, key, buckets)
    found = spark.read.schema(T.StructType([*df.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(f"{base}/{folder}")
    held = {r[0]: f"{folder}/{BUCKET}={r[0]}" for r in found.select(BUCKET).distinct().collect()}
    return _publish(spark, base, Version(0, df.schema, key, buckets, held))


def merge_version(
    batch: DataFrame, base: str, update_cols: Sequence[str], source: tuple[str, int] | None = None, order: str | None = None
) -> int:
    """Merge a batch into the newest version and publish the next one.

    Matched keys take ``update_cols`` from the batch and keep the rest, new ones are
    inserted. ``order`` names the column whose greatest value decides between rows of one
    key; without it the batch holds each key once. ``source`` is the name of a stream and
    the number of its batch: one that the table holds already changes nothing.
    """
    spark = batch.sparkSession
    before = version_at(spark, base)
    if source and before.sources.get(source[0], -1) >= source[1]:
        return before.number
    columns = [f.name for f in before.schema.fields]
    if order:
        rest = [c for c in batch.columns if c != before.key]
        last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col(f"`{order}`"))
        batch = batch.groupBy(before.key).agg(last.alias("_last")).select(before.key, "_last.*")
    once = stored(batch.select(*[f"`{c}`" for c in columns]).withColumn(BUCKET, _bucket(before.key, before.buckets)), "batch")
    touched = sorted(r[0] for r in once.select(BUCKET).distinct().collect())
    merged = upsert(_read(spark, base, before, touched), once.drop(BUCKET), before.key, update_cols)
    folder = _write(merged, base, before.key, before.buckets)
    folders = before.folders | {k: f"{folder}/{BUCKET}={k}" for k in touched}
    sources = before.sources | ({source[0]: source[1]} if source else {})
    return _publish(spark, base, Version(before.number + 1, before.schema, before.key, before.buckets, folders, sources))
