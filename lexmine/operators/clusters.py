"""Cluster labels and summaries, and the guard for roots too small to cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmine import rules
from lexmine.functions.text import word_count
from lexmine.operators.joins import salted_filter, salted_join
from lexmine.operators.reports import ranked

ROOT = "root_keyword"
MIN_ROWS = 3
SMALL_LABEL = "cluster_0"
LABEL_MAX_WORDS = 3


def cluster_count(n: int, wanted: int = rules.N_CLUSTERS) -> int:
    return min(wanted, n - 1, rules.MAX_CLUSTERS)


def component_count(n: int, clusters: int, wanted: int = rules.N_COMPONENTS) -> int:
    return min(wanted, n - 1, clusters)


def limits(labelled: DataFrame, wanted: int = rules.N_CLUSTERS, wanted_components: int = rules.N_COMPONENTS) -> DataFrame:
    """root_keyword, rows, clusters, components of every root; a small root has one cluster and no components."""
    n = F.col("rows")
    clusters = F.when(is_small(n), 1).otherwise(F.least(F.lit(wanted), n - 1, F.lit(rules.MAX_CLUSTERS)))
    components = F.when(is_small(n), 0).otherwise(F.least(F.lit(wanted_components), n - 1, F.col("clusters")))
    sizes = labelled.groupBy(ROOT).agg(F.count(F.lit(1)).alias("rows"))
    return sizes.withColumn("clusters", clusters.cast("int")).withColumn("components", components.cast("int"))


def is_small(rows: Column) -> Column:
    return rows < MIN_ROWS


def small_clusters(df: DataFrame) -> DataFrame:
    """Keywords of roots below the minimum: one cluster with a fixed label."""
    sizes = df.groupBy(ROOT).agg(F.count(F.lit(1)).alias("_n")).where(is_small(F.col("_n"))).select(ROOT)
    # The dropped side can hold a root with most rows, so its keys are split too.
    return salted_filter(df, sizes, [ROOT], "keyword").select(
        *df.columns, F.lit(0).alias("cluster_id"), F.lit(SMALL_LABEL).alias("cluster_label")
    )


def labels(clustered: DataFrame) -> DataFrame:
    """One label per cluster: its shortest keyword of at most three words, the first on ties, else its first."""
    short = F.when(word_count(F.col("keyword")) <= LABEL_MAX_WORDS, F.struct(F.length("keyword"), F.col("seq")))
    found = clustered.groupBy(ROOT, "cluster_id").agg(
        F.min_by("keyword", short).alias("_short"), F.min_by("keyword", "seq").alias("_first")
    )
    text = F.concat(F.lit("["), F.col("cluster_id").cast("string"), F.lit("] "), F.coalesce("_short", "_first"))
    return found.select(ROOT, "cluster_id", text.alias("cluster_label"))


def with_labels(clustered: DataFrame) -> DataFrame:
    return salted_join(clustered, labels(clustered), [ROOT, "cluster_id"], "keyword").select(
        *clustered.columns, "cluster_label"
    )


def summary(clustered: DataFrame, k: int = rules.SAMPLE_KEYWORDS) -> DataFrame:
    """Size, first k keywords and keyword types, in order of appearance, of each cluster.

    Counts combine map-side, samples are cut to k per task, and the lists hold at most k keywords and 13 types.
    """
    by = [ROOT, "cluster_id"]
    kinds = clustered.groupBy(*by, "keyword_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"), F.min_by("cluster_label", "seq").alias("label")
    ).groupBy(*by).agg(
        F.sum("n").alias("keyword_count"), F.min_by("label", "seq").alias("cluster_label"),
        F.sort_array(F.collect_list(F.struct("seq", "keyword_type"))).alias("_kinds"),
    )
    samples = ranked(clustered.select(*by, "seq", "keyword"), by, [F.col("seq")], k).groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("rank", "keyword"))).alias("_samples")
    )
    return kinds.join(samples, by).select(
        *by, "cluster_label", "keyword_count",
        F.array_join(F.transform("_samples", lambda x: x["keyword"]), " | ").alias("sample_keywords"),
        F.array_join(F.transform("_kinds", lambda x: x["keyword_type"]), "|").alias("keyword_types"),
    )
