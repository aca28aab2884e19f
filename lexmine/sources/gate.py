"""The one way from extracted rows to keyword records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmine import rules
from lexmine.functions.text import strip
from lexmine.operators.cleaning import once

MIN_RECORD_LENGTH = 2
# A record's order is its response's order and its position in it; a body holds far fewer rows than this.
ROWS_PER_RESPONSE = 1 << 26


def row(keyword: Column, source: Column | str, title=None, description=None, url=None) -> Column:
    """One extracted row; parts not given are empty."""
    def text(value) -> Column:
        if value is None:
            return F.lit("")
        return F.lit(value) if isinstance(value, str) else F.coalesce(value, F.lit(""))

    return F.struct(
        keyword.alias("keyword"), text(source).alias("source"), text(title).alias("title"),
        text(description).alias("description"), text(url).alias("url"),
    )


def record_gate(df: DataFrame) -> DataFrame:
    """Strip and lower the keyword, drop it below two characters, default the source to the channel."""
    gated = once(df, keyword=F.lower(strip(F.col("keyword")))).where(F.length("keyword") >= MIN_RECORD_LENGTH)
    source = F.when(F.coalesce("source", F.lit("")) == "", F.col("channel")).otherwise(F.col("source"))
    return gated.select(
        "root_keyword", "seq", "keyword", source.alias("source"), "channel",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "description", "url")],
        F.lit(rules.LANGUAGE).alias("language"), F.lit(rules.COUNTRY).alias("country"), "collected_at",
    )


def emit(responses: DataFrame, rows: Column) -> DataFrame:
    """Records of each response from its array of rows, in array order. NULL arrays give nothing."""
    at = F.col("collected_at") if "collected_at" in responses.columns else F.localtimestamp()
    # The outer form: for the inner one the optimizer adds a test of the array's size below, which would parse every
    # body a second time. The gate drops the NULL row of an empty array.
    opened = responses.select(
        "root_keyword", "channel", F.col("seq").alias("_seq"), at.alias("collected_at"), rows.alias("_rows")
    ).select("root_keyword", "channel", "_seq", "collected_at", F.posexplode_outer("_rows").alias("_pos", "_row"))
    return record_gate(opened.select(
        "root_keyword", "channel", "collected_at",
        (F.col("_seq") * F.lit(ROWS_PER_RESPONSE) + F.col("_pos")).alias("seq"), "_row.*",
    ))
