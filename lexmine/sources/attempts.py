"""Which requests to send again: what is known of each request's attempts, kept batch by batch.

The state of a request is its best attempt (the first acceptable one) and the number of attempts used. Both are extremes
of attempt numbers, so batches can be merged in any order and answers that arrive twice change nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lexmine import rules
from lexmine.sources.responses import acceptable

KEY = "request_id"


def state(responses: DataFrame) -> DataFrame:
    """request_id, best (NULL without an acceptable attempt), used. Bodies are not read."""
    good = acceptable(F.col("status"), F.col("attempt"))
    return responses.groupBy(KEY).agg(
        F.min(F.when(good, F.col("attempt"))).alias("best"), F.max("attempt").alias("used"))


def merge(*states: DataFrame) -> DataFrame:
    """The state after all batches, from the states of some of them."""
    every = reduce(DataFrame.unionByName, states)
    return every.groupBy(KEY).agg(F.min("best").alias("best"), F.max("used").alias("used"))


def next_attempts(requests: DataFrame, known: DataFrame, most: int = rules.MAX_ATTEMPTS) -> DataFrame:
    """The requests to send now, with ``attempt`` and ``wait_s``, the seconds to wait before: 2 to the attempts used.

    First attempts of requests without an answer, and the next attempt of those without an acceptable one so far.
    """
    used = F.coalesce("used", F.lit(0))
    asked = requests.join(known, KEY, "left").where(F.col("best").isNull() & (used < most))
    wait = F.when(used == 0, 0).otherwise(F.pow(F.lit(2), used)).cast("int")
    return asked.select(*requests.columns, (used + 1).cast("int").alias("attempt"), wait.alias("wait_s"))


def given_up(known: DataFrame, most: int = rules.MAX_ATTEMPTS) -> DataFrame:
    """Requests that yield nothing: every attempt is used and none was acceptable."""
    return known.where(F.col("best").isNull() & (F.col("used") >= most)).select(KEY)


def answers(responses: DataFrame, known: DataFrame) -> DataFrame:
    """Of the captured responses the one that counts for each request; an answer captured twice counts once."""
    best = known.where(F.col("best").isNotNull()).select(KEY, F.col("best").alias("attempt"))
    return responses.join(best, [KEY, "attempt"], "left_semi").dropDuplicates([KEY]).select(*responses.columns)
