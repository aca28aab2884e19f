"""Resume by stream: records that arrive are labelled and landed once, whatever restarts in between.

Only row-wise operators run here. Merging duplicates needs all records of a keyword and stays a batch step over the
landed table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmine.operators.cleaning import keep_keyword, normalized
from lexmine.operators.labels import label
from lexmine.sinks.landing import by_bucket


def label_stream(records: DataFrame) -> DataFrame:
    """Normalise, filter and label records as they come; works on batch frames too."""
    return label(normalized(records).where(keep_keyword(F.col("keyword"))))


def land_stream(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch of records to the landing table; the checkpoint remembers what has been read."""
    def append(batch: DataFrame, batch_id: int) -> None:
        # A batch that is retried replaces its own folder.
        by_bucket(batch).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")

    return (
        records.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
