"""What has been done for each root, so that a run goes on where the last one stopped.

A root is landed, then exported, then cleared. A root that landed without rows counts as not done, and so does a cleared
one: it starts again, in its next epoch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmine.sinks import versions

ROOT = "root_keyword"
LANDED, EXPORTED, CLEARED = "landed", "exported", "cleared"
STATES = [LANDED, EXPORTED, CLEARED]
SCHEMA = "root_keyword string, epoch long, state string, rows long"


def fold(*events: DataFrame) -> DataFrame:
    """The furthest state of each root. Events may come in any order and more than once; the result is the same."""
    every = reduce(DataFrame.unionByName, [e.select(ROOT, "epoch", "state", "rows") for e in events])
    order = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    furthest = every.groupBy(ROOT).agg(F.max(F.struct("epoch", order.alias("step"), "rows", "state")).alias("at"))
    return furthest.select(ROOT, "at.epoch", "at.state", "at.rows")


def is_done() -> Column:
    """Whether a root of a folded ledger needs no requests."""
    return (F.col("state") != CLEARED) & (F.col("rows") > 0)


def pending(roots: DataFrame, ledger: DataFrame) -> DataFrame:
    """The rows of ``roots`` whose root is not done."""
    return roots.join(ledger.where(is_done()).select(ROOT), ROOT, "left_anti").select(*roots.columns)


class Ledger:
    """A folded ledger in a folder; every change is one new version, published by a rename."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def state(self) -> DataFrame:
        return versions.read(self.spark, self.path, SCHEMA)

    def _advance(self, events: DataFrame) -> None:
        number = versions.latest(self.spark, self.path)
        versions.publish(fold(self.state(), events), self.path, number)
        versions.prune(self.spark, self.path)

    def landed(self, roots: DataFrame, rows: DataFrame) -> None:
        """The roots have landed; ``rows`` has root_keyword and rows, and a root that is missing there landed empty."""
        known = self.state().select(ROOT, "epoch", F.col("state").alias("_state"))
        epoch = F.coalesce(F.col("epoch") + (F.col("_state") == CLEARED).cast("int"), F.lit(0)).cast("bigint")
        counted = roots.select(ROOT).distinct().join(rows.select(ROOT, "rows"), ROOT, "left").join(known, ROOT, "left")
        self._advance(counted.select(ROOT, epoch.alias("epoch"), F.lit(LANDED).alias("state"), F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows")))

    def move(self, before: str, after: str) -> None:
        """All roots with rows that are in one state go on to another."""
        moved = self.state().where((F.col("state") == before) & (F.col("rows") > 0))
        self._advance(moved.withColumn("state", F.lit(after)))
