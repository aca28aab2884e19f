"""Related queries and topics captured as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexmine import rules
from lexmine.functions.text import strip
from lexmine.sources.gate import ROWS_PER_RESPONSE, record_gate

CHANNEL_SEQ = rules.CHANNELS.index("google_trends") << 24


def trend_records(trends: DataFrame) -> DataFrame:
    """Queries, then topics, each top before rising, in rank order."""
    topic = F.col("kind") == "topic"
    tag = F.concat(F.when(topic, "google_trends_topic_").otherwise("google_trends_"), F.col("rank_type"))
    block = F.when(topic, 2).otherwise(0) + F.when(F.col("rank_type") == "rising", 1).otherwise(0)
    at = F.col("collected_at") if "collected_at" in trends.columns else F.localtimestamp()
    text = strip(F.col("text"))
    return record_gate(trends.where(F.col("rank_type").isin("top", "rising") & (text != "")).select(
        "root_keyword", F.lit("google_trends").alias("channel"), tag.alias("source"), text.alias("keyword"),
        ((F.lit(CHANNEL_SEQ).cast("bigint") + block) * F.lit(ROWS_PER_RESPONSE) + F.col("ord")).alias("seq"),
        *[F.lit("").alias(c) for c in ("title", "description", "url")], at.alias("collected_at"),
    ))
