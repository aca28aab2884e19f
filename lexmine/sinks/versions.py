"""Tables that move on by whole versions: each is written aside and becomes the latest by one rename.

A run that dies before the rename leaves the latest version as it was; what it wrote aside is never read. The rename
must be atomic, as it is on HDFS and local disks; where it is not (most object stores), give the folder of a file
system that has it. One writer at a time: a second one that publishes the same number gets an error.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

VERSION = re.compile(r"v(\d{8})$")


def _folder(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it is missing."""
    fs, at = _folder(spark, path)
    return sorted(status.getPath().getName() for status in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _folder(spark, path)
    fs.delete(at, True)


def latest(spark: SparkSession, path: str) -> int:
    """The number of the latest version, 0 before the first."""
    return max((int(m[1]) for m in map(VERSION.match, children(spark, path)) if m), default=0)


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The latest version; an empty frame before the first."""
    number = latest(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v{number:08d}") if number else spark.createDataFrame([], schema)


def publish(df: DataFrame, path: str, after: int) -> None:
    """Make the frame the version that follows number ``after``, which it was derived from."""
    spark = df.sparkSession
    aside, target = f"{path}/_aside-{uuid.uuid4().hex}", f"{path}/v{after + 1:08d}"
    df.write.parquet(aside)
    fs, to = _folder(spark, target)
    if fs.exists(to) or not fs.rename(_folder(spark, aside)[1], to):
        remove(spark, aside)
        raise RuntimeError(f"{target} was published by another run")


def prune(spark: SparkSession, path: str) -> None:
    """Remove all but the latest version, and what dead runs wrote aside."""
    keep = f"v{latest(spark, path):08d}"
    for name in children(spark, path):
        if name != keep:
            remove(spark, f"{path}/{name}")
