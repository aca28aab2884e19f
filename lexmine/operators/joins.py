"""Join against a side with one row per key when the other side may hold most of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SALTS = 32


def _copies(keys: DataFrame, salts: int) -> DataFrame:
    """Every row once per salt, always merged: the planner takes the copies for as small as the keys and would broadcast
    them, which the driver cannot hold for millions of keys."""
    last = F.lit(salts - 1).cast("bigint")
    return keys.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).hint("merge")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread_by: str, salts: int = SALTS) -> DataFrame:
    """Equi-join that splits every key of ``left`` over ``salts`` tasks by ``spread_by``.

    ``right`` has one row per key and is repeated once per salt.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    return salted.join(_copies(right, salts), [*on, "_salt"]).drop("_salt")


def salted_filter(left: DataFrame, keys: DataFrame, on: list[str], spread_by: str, present: bool = True, salts: int = SALTS) -> DataFrame:
    """Rows of ``left`` whose key is, or with ``present=False`` is not, among ``keys``; keys are split as above."""
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    return salted.join(_copies(keys.select(*on).distinct(), salts), [*on, "_salt"], "left_semi" if present else "left_anti").select(*left.columns)
