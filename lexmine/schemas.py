"""Table schemas. Nothing in the library infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

RESPONSES = T.StructType([
    T.StructField("request_id", T.StringType(), False),
    T.StructField("root_keyword", T.StringType(), False),
    T.StructField("channel", T.StringType(), False),
    T.StructField("endpoint", T.StringType(), False),
    T.StructField("query", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("attempt", T.IntegerType(), False),
    T.StructField("status", T.IntegerType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("body", T.StringType()),
])

RECORDS = T.StructType([
    T.StructField("root_keyword", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("keyword", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("channel", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("collected_at", T.TimestampNTZType()),
])

TRENDS = T.StructType([
    T.StructField("root_keyword", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("rank_type", T.StringType(), False),
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("text", T.StringType()),
])
