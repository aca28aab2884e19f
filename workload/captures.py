"""Keyword records and captured responses derived from the given tables with Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmine import rules
from workload.templates import COLLECTED_AT, SUGGESTIONS, TITLES


# What labels, counts, clusters and reports need of a record. Cleaning merges rows by all their columns, so those that a
# query does not need are left out before it.
NARROW = ["root_keyword", "seq", "keyword", "source"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where the source has fewer splits than that; a large table keeps its own splits."""
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= parallelism else df.repartition(parallelism)


def literal_rows(rows: list[tuple], *names: str) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all roots: every part row contributes its suggestions and titles; the root is the part name."""
    columns = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]
    part = spread(table(spark, sf_dir, "part").select(*columns))
    templates = [(i, *t) for i, t in enumerate(SUGGESTIONS)]
    suggested = part.select(
        F.lower("p_name").alias("root_keyword"), "p_name", "p_partkey",
        F.inline(literal_rows(templates, "ord", "channel", "source", "before", "after")),
    ).select(
        "root_keyword",
        (F.col("ord") * F.lit(1 << 40) + F.col("p_partkey")).alias("seq"),
        F.lower(F.trim(F.concat_ws(" ", "before", "p_name", "after"))).alias("keyword"),
        "source", "channel",
        F.lit("").alias("title"), F.lit("").alias("url"),
    )
    made = F.array(*[
        F.struct(
            F.lit(len(SUGGESTIONS) + i).alias("ord"), F.lit(channel).alias("channel"),
            F.lit(source).alias("source"), F.expr(text.format(str="string")).alias("title"),
        )
        for i, (channel, source, text) in enumerate(TITLES)
    ])
    titled = part.select(
        F.lower("p_name").alias("root_keyword"), "p_partkey", F.inline(made)
    ).select(
        "root_keyword",
        (F.col("ord") * F.lit(1 << 40) + F.col("p_partkey")).alias("seq"),
        F.lower("title").alias("keyword"),
        "source", "channel", "title",
        F.concat(F.lit("https://example.com/p/"), F.col("p_partkey").cast("string")).alias("url"),
    )
    return suggested.unionByName(titled).select(
        "root_keyword", "seq", "keyword", "source", "channel", "title",
        F.lit("").alias("description"), "url",
        F.lit(rules.LANGUAGE).alias("language"), F.lit(rules.COUNTRY).alias("country"),
        F.lit(COLLECTED_AT).cast("timestamp_ntz").alias("collected_at"),
    )
