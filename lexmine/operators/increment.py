"""Cleaning batch by batch: a mergeable state of each keyword, kept in buckets, of which a batch touches only its own.

The state of a keyword in its root is its first record and its set of source tags. Both merge in any order, and records
that come twice change nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lexmine.operators.cleaning import is_all_stopwords, is_low_value, length_ok, normalized, once, repeats_merged, words_ok
from lexmine.session import cut_lineage
from lexmine.sinks import landing

KEYS = ["root_keyword", "keyword"]


def state(records: DataFrame) -> DataFrame:
    """root_keyword, keyword, first (the record of least seq), sources. Size filters come before the shuffle."""
    keyword = F.col("keyword")
    sized = normalized(records).where(length_ok(keyword) & words_ok(keyword))
    rest = [c for c in records.columns if c not in {*KEYS, "source", "seq"}]
    return repeats_merged(sized).groupBy(*KEYS).agg(F.min(F.struct("seq", *rest)).alias("first"), F.collect_set("source").alias("sources"))


def merge(*states: DataFrame) -> DataFrame:
    """The state of all records, from states of parts of them. A tag set is one row's, as it is in the result."""
    every = reduce(DataFrame.unionByName, states)
    tags = F.array_distinct(F.flatten(F.collect_set("sources")))
    return every.groupBy(*KEYS).agg(F.min("first").alias("first"), tags.alias("sources"))


def finish(known: DataFrame, columns: list[str]) -> DataFrame:
    """Cleaned keywords with the columns of the records: what cleaning all records at once gives."""
    keyword = F.col("keyword")
    made = known.select(*KEYS, "first.*", F.array_join(F.sort_array("sources"), "|").alias("source")).select(*columns)
    return once(made, _wanted=~is_all_stopwords(keyword) & ~is_low_value(keyword)).where("_wanted").drop("_wanted")


class CleanedTable:
    """Cleaned keywords of all batches so far, in a folder."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int = landing.BUCKETS):
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets
        self.state_schema = state(spark.createDataFrame([], schema)).schema

    def add(self, records: DataFrame) -> list[int]:
        """Take in a batch: its buckets are merged and rewritten, the others stay. Returns the buckets."""
        incoming = cut_lineage(state(records.select(*self.schema.names)))
        return landing.rewrite(incoming, self.path, merge, self.buckets)

    def keywords(self) -> DataFrame:
        return finish(landing.read(self.spark, self.path, self.state_schema), self.schema.names)
