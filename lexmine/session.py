"""Session settings for a cluster run, and the shared folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution sizes the shuffles, splits skewed ones, and hashes where every build side is small.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.execution.arrow.maxBytesPerBatch": "32m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def builder(app_name: str = "lexmine") -> SparkSession.Builder:
    made = SparkSession.builder.appName(app_name)
    for key, value in CLUSTER_CONF.items():
        made = made.config(key, value)
    return made


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors share.

    A cluster must set it. A local run, where the driver is the only executor, may leave it unset and then uses the
    machine's temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/lexmine"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame as a table below the shared folder and read it back.

    Later steps read only the columns they need. ``clear_intermediate`` removes the tables of a session.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_intermediate(spark: SparkSession) -> None:
    """Remove the tables that ``cut_lineage`` wrote in this session; results that still read them are lost."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{context.applicationId}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
