"""Small frames for tests."""

from pyspark.sql import functions as F

RECORD = (
    "root_keyword string, seq long, keyword string, source string, channel string, title string, "
    "description string, url string"
)
RESPONSE = (
    "request_id string, root_keyword string, channel string, endpoint string, query string, url string, "
    "attempt int, status int, seq long, body string"
)


def keyword_frame(spark, keywords, root="scissor lift"):
    rows = [(root, i, k, f"s{i}", "google", "", "", "") for i, k in enumerate(keywords)]
    df = spark.createDataFrame(rows, RECORD)
    return df.select(
        "*", F.lit("en").alias("language"), F.lit("US").alias("country"),
        F.lit("2024-01-01 10:00:00.5").cast("timestamp_ntz").alias("collected_at"),
    )


def response(channel, endpoint, body, root="scissor lift", seq=0, url="", attempt=1, status=200):
    return (f"{channel}/{endpoint}/{seq}/{root}", root, channel, endpoint, root, url, attempt, status, seq, body)


def responses(spark, *rows):
    return spark.createDataFrame(list(rows), RESPONSE)


def found(df, *columns):
    columns = columns or ("keyword", "source")
    return [tuple(r[c] for c in columns) for r in df.orderBy("seq").collect()]
