"""Row numbers of a total order over any number of rows: range partitions, counted, and the sums of the counts before."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from lexmine.session import cut_lineage

# monotonically_increasing_id has the row's place in its partition in its lower bits.
PLACE_BITS = 33


def with_positions(df: DataFrame, *order: Column | str, partitions: int | None = None) -> DataFrame:
    """Add ``position``, from 1, in the given order. Rows that the order does not tell apart are numbered in any order.

    Ranges are drawn from a sample, so what they hold is written down before it is counted; the driver sees one count
    per partition. No task sorts more than its range.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    written = cut_lineage(ranged.select(
        "*", F.shiftright(number, PLACE_BITS).cast("int").alias("_part"), number.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("_place")))
    counts = {r["_part"]: r["n"] for r in written.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = sorted(counts)
    before = dict(zip(parts, accumulate((counts[p] for p in parts), initial=1)))
    starts = F.array(*[F.lit(before.get(p, 0)).cast("bigint") for p in range(max(parts, default=0) + 1)])
    return written.select(*df.columns, (F.get(starts, F.col("_part")) + F.col("_place")).alias("position"))
