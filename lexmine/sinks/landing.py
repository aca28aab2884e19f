"""Landed records: a fixed number of hash buckets of the root, and a manifest that says what is where.

``<path>/data/<id>/bucket=<n>`` holds rows of bucket n; the manifest names for each bucket the one folder that counts.
Landing some roots rewrites only their buckets, into a new folder, and then publishes the next manifest by a rename.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lexmine.sinks import versions

BUCKETS = 256
ROOT = "root_keyword"
MANIFEST = "bucket int, root_keyword string, files long, rows long, folder string, buckets int"


def bucket_of(root: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a root: its first 32 digest bits modulo the number of buckets."""
    return (F.conv(F.substring(F.md5(root), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)).cast("int")


def bucket_number(root: str, buckets: int = BUCKETS) -> int:
    """The same for a string of the driver."""
    return int(hashlib.md5(root.encode()).hexdigest()[:8], 16) % buckets


def by_bucket(df: DataFrame, buckets: int = BUCKETS, *order: str) -> DataFrame:
    """Rows with their ``bucket``, each bucket in as few tasks as its size allows, roots together inside a task.

    Adaptive rebalancing splits a bucket that a hot root fills.
    """
    dealt = df.withColumn("bucket", bucket_of(F.col(ROOT), buckets)).hint("rebalance", "bucket")
    return dealt.sortWithinPartitions("bucket", ROOT, *order)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed root: bucket, root_keyword, files, rows, the folder of its bucket, the number of buckets."""
    return versions.read(spark, f"{path}/manifest", MANIFEST)


def _places(entries: DataFrame) -> dict[int, str]:
    """The folder of each bucket: at most one row per bucket reaches the driver."""
    return {r["bucket"]: r["folder"] for r in entries.select("bucket", "folder").distinct().collect()}


def read(spark: SparkSession, path: str, schema: StructType, roots: list[str] | None = None) -> DataFrame:
    """All landed rows, or those of some roots: then only their buckets are listed and read."""
    entries = manifest(spark, path)
    if roots is not None:
        entries = entries.where(F.col(ROOT).isin(roots))
    places = _places(entries)
    if not places:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{path}/{folder}/bucket={n}" for n, folder in sorted(places.items())])
    return rows if roots is None else rows.where(F.col(ROOT).isin(roots))


def _entries(spark: SparkSession, target: str, folder: str, buckets: int) -> DataFrame:
    """Manifest rows of a folder, from its root column alone."""
    written = spark.read.schema(f"{ROOT} string, bucket int").parquet(target)
    entries = written.withColumn("file", F.input_file_name()).groupBy("bucket", ROOT).agg(
        F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("rows"))
    return entries.select("bucket", ROOT, "files", "rows", F.lit(folder).alias("folder"), F.lit(buckets).alias("buckets"))


def _begin(spark: SparkSession, path: str, buckets: int) -> tuple[int, DataFrame, str]:
    """The latest manifest's number, the manifest, and a new folder's name."""
    number, before = versions.latest(spark, f"{path}/manifest"), manifest(spark, path)
    other = before.where(F.col("buckets") != buckets).first()
    if other is not None:
        raise ValueError(f"{path} has {other['buckets']} buckets")
    return number, before, f"data/{uuid.uuid4().hex}"


def rewrite(incoming: DataFrame, path: str, merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> list[int]:
    """Merge rows into the table: ``merge(incoming, old)`` replaces the buckets of the incoming rows' roots.

    ``incoming`` is read twice and should be written already. Other buckets are neither read nor written.
    """
    spark = incoming.sparkSession
    number, before, folder = _begin(spark, path, buckets)
    bucket = bucket_of(F.col(ROOT), buckets)
    touched = sorted(r[0] for r in incoming.select(bucket).distinct().collect())  # at most one number per bucket
    if not touched:
        return []
    places = _places(before.where(F.col("bucket").isin(touched)))
    old = spark.createDataFrame([], incoming.schema)
    if places:
        old = spark.read.schema(incoming.schema).parquet(*[f"{path}/{at}/bucket={n}" for n, at in sorted(places.items())])
    by_bucket(merge(incoming, old), buckets).write.partitionBy("bucket").parquet(f"{path}/{folder}")
    untouched = before.where(~F.col("bucket").isin(touched))
    versions.publish(untouched.unionByName(_entries(spark, f"{path}/{folder}", folder, buckets)), f"{path}/manifest", number)
    return touched


def land(records: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Replace the landed rows of the roots in ``records``; return the new manifest.

    The records are written once. Rows of other roots in the same buckets are copied beside them; buckets without a
    root of ``records`` are not touched. Nothing changes for readers before the manifest is published, so a run that
    dies on the way can simply be repeated. Roots without a record have no entry.
    """
    spark = records.sparkSession
    number, before, folder = _begin(spark, path, buckets)
    target = f"{path}/{folder}"
    by_bucket(records, buckets).write.partitionBy("bucket").parquet(target)
    touched = [int(name.split("=")[1]) for name in versions.children(spark, target) if name.startswith("bucket=")]
    if not touched:
        versions.remove(spark, target)
        return before
    fresh = spark.read.schema(f"{ROOT} string, bucket int").parquet(target)
    places = {n: at for n, at in _places(before.where(F.col("bucket").isin(touched))).items()}
    if places:
        schema = records.schema
        kept = spark.read.schema(schema).parquet(*[f"{path}/{at}/bucket={n}" for n, at in sorted(places.items())])
        kept = kept.join(fresh.select(ROOT).distinct(), ROOT, "left_anti").select(*schema.names)
        by_bucket(kept, buckets).write.mode("append").partitionBy("bucket").parquet(target)
    untouched = before.where(~F.col("bucket").isin(touched))
    versions.publish(untouched.unionByName(_entries(spark, target, folder, buckets)), f"{path}/manifest", number)
    return manifest(spark, path)


def prune(spark: SparkSession, path: str) -> None:
    """Remove the folders that the manifest no longer names; call it when nothing reads an older manifest."""
    versions.prune(spark, f"{path}/manifest")
    named = {folder.split("/")[1] for folder in _places(manifest(spark, path)).values()}
    for name in versions.children(spark, f"{path}/data"):
        if name not in named:
            versions.remove(spark, f"{path}/data/{name}")
