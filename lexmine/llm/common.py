"""What the operators share: tables in the cluster's shared folder, salted joins, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmine.session import shared_folder

_held: list = []


def held(make: Callable, *key) -> Any:
    """make(*key), kept by this worker process until another is asked for; that one is made once this one is gone.

    Spark reuses workers, so what each operator, or each run with a sample of its own, kept for itself would add up.
    """
    if not _held or _held[0] != (make, key):
        _held.clear()
        _held[:] = [(make, key), make(*key)]
    return _held[1]


def _home(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write the frame as a table below the shared folder and read it back: lineage ends there, columns can be pruned."""
    spark = df.sparkSession
    path = f"{_home(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove this application's intermediate tables; call it once no result that reads them is needed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_home(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def salted_join(
    rows: DataFrame, entries: DataFrame, on: list[str], weight: str, spread: Column, total: int,
    share: int = 1000, salts: int = 64,
) -> DataFrame:
    """Inner join of many rows per key with one entry per key; `weight` is the entry's number of rows, `total` their sum.

    Keys with more than one in `share` of all rows are dealt over `salts` tasks by the hash of `spread`. There are
    fewer than `share` such keys, which bounds the broadcast list of them; the rest is a plain join.
    """
    hot = F.col(weight) * share > F.lit(total)
    listed = entries.filter(hot).select(*[F.col(c).alias(f"hot_{c}") for c in on])
    match = [F.col(c) == F.col(f"hot_{c}") for c in on]
    dealt = rows.join(F.broadcast(listed), match, "left").withColumn(
        "salt", F.when(F.col(f"hot_{on[0]}").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0).cast("long"))
    ).drop(*[f"hot_{c}" for c in on])
    copies = entries.withColumn(
        "salt", F.explode(F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
    )
    return dealt.join(copies, [*on, "salt"]).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of ids to (id, component): the smallest id reachable, for every id that has a link.

    Alternates two star steps on the edge table until nothing changes: each node's larger, then its smaller
    neighbours are attached to its smallest one. Rounds grow with the logarithm of a component's size. Links of an id
    with itself and null ids are dropped.
    """
    edges = settle(
        links.filter("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("m")).distinct(), "links"
    )
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("m").alias("x"), F.col("x").alias("m")))
        least = both.groupBy("x").agg(F.least(F.min("m"), F.first("x")).alias("root"))
        large = both.filter("m > x").join(least, "x").select(F.col("m").alias("x"), F.col("root").alias("m"))
        large = large.unionByName(least.filter("root < x").select("x", F.col("root").alias("m"))).distinct()
        lowest = large.groupBy("x").agg(F.min("m").alias("root"))
        small = large.join(lowest, "x").filter("m <> root").select(F.col("m").alias("x"), F.col("root").alias("m"))
        small = small.unionByName(lowest.select("x", F.col("root").alias("m"))).distinct()
        edges = settle(small, "links")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "m")), F.sum(F.col("m").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("x").alias("id"), F.col("m").alias("component")).unionByName(
        edges.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct()
    )


def forest(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same connected parts as the given ones, at most one for each node: to its part's smallest."""
    nodes, places = np.unique(np.concatenate([one, two]), return_inverse=True)
    a, b = places[:len(one)], places[len(one):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
