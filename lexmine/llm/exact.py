"""Exact deduplication through an extendible-hash index on shared files."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmine.llm.common import salted_join, settle

# The directory has at most 2 ** MOST_BITS cells, which bounds its broadcast; larger tables have larger buckets instead.
MOST_BITS = 20
# Keys with more than one in so many of all rows are hot; there are fewer of them than that, which bounds their list.
HOT_SHARE = 100_000
# The rows of a hot text merge in the map tasks and then in so many lanes, so its owner reads that many rows at most.
LANES = 64


def directory(entries: DataFrame, n: int, capacity: int) -> tuple[DataFrame, int]:
    """(cell, bucket, depth) rows and the bits of a cell.

    Starting from one bucket that holds every key, a bucket with more than `capacity` entries is split by the next
    leading bit of the hash, until none is overfull; the directory doubles with its deepest bucket. Entries are counted
    once by cells finer than any expected bucket, and each level sums those. Keys that agree in all bits of a cell stay
    together, however many they are: their bucket is an overflow bucket.
    """
    bits = min(MOST_BITS, max(1, math.ceil(math.log2(max(2, n / capacity))) + 6))
    cells = entries.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("cell")).agg(F.count("*").alias("load"))
    levels = cells.select(
        "cell", "load", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")
    ).withColumn("bucket", F.expr(f"shiftright(cell, {bits} - depth)"))
    loads = levels.groupBy("depth", "bucket").agg(F.sum("load").alias("load"))
    fits = loads.filter((F.col("load") <= capacity) | (F.col("depth") == bits)).select("depth", "bucket")
    found = levels.join(fits, ["depth", "bucket"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return found.select("cell", F.expr(f"shiftleft(shiftright(cell, {bits} - depth), {bits} - depth)").alias("bucket"), "depth"), bits


def routed(rows: DataFrame, keys: DataFrame, total: int) -> DataFrame:
    """h, text, keep_id, group_size: what the owners are sent, a row per row, or few rows per hot text.

    A text with a third of all rows leaves each map task as one row, and its lanes as one row each; these are parts of
    its group still. Texts of other keys go to their owners as they are, so most texts are shuffled once.
    """
    listed = F.broadcast(keys.filter(F.col("n_rows") * HOT_SHARE > total).select("h"))
    merged = rows.join(listed, "h", "left_semi").withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(LANES)))
    merged = merged.groupBy("h", "lane", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    single = rows.join(listed, "h", "left_anti").select("h", "text", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return merged.select("h", "text", "keep_id", "group_size").unionByName(single)


def build_index(rows: DataFrame, keys: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame, int, int]:
    """The index table, its directory, the bits of a cell and the number of rows.

    `rows` has doc_id, text and the 64-bit key h, `keys` each h and its number of rows. The directory gives each row
    the bucket of its key, a range of keys, and the bucket's owner is sent all rows of the range. The owner compares
    the texts of a key byte by byte: equal ones become one entry, different ones a chain. An entry is its bucket, key
    and `link` (its place in the chain, from 1), the digest of its text, its largest doc_id and its number of rows.
    """
    n, total = keys.agg(F.count("*"), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    buckets, bits = directory(keys, n, capacity)
    buckets = settle(buckets, "directory")
    cell = F.shiftrightunsigned("h", 64 - bits)
    owned = routed(rows, keys, total).withColumn("cell", cell).join(F.broadcast(buckets.select("cell", "bucket")), "cell").drop("cell")
    entries = owned.repartition("bucket").groupBy("bucket", "h", "text").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    chain = Window.partitionBy("bucket", "h").orderBy("text_sha256")
    index = settle(entries.withColumn("text_sha256", F.sha2("text", 256)).drop("text").withColumn("link", F.row_number().over(chain)), "index")
    chained = index.join(index.filter("link > 1").select("bucket", "h").distinct(), ["bucket", "h"], "left_semi")
    if not chained.groupBy("bucket", "h", "text_sha256").count().filter("count > 1").isEmpty():
        raise ValueError("two different texts have one SHA-256 digest")
    return index, buckets, bits, total


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 512,
    key: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text is an empty one. The row with the largest id stays. Rows that
    repeat an id and a text each count in group_size and share one decision. Ids may be null: such a row stays only if
    its whole group has no id. An empty table gives an empty result; other columns are not read. `key` gives the
    64-bit hash of a text; texts that it maps to one value are chained and told apart by their bytes.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", key(F.col("text")))
    narrow = settle(rows.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256")), "digests")
    keys = settle(narrow.groupBy("h").agg(F.count("*").alias("n_rows")), "keys")
    index, buckets, bits, total = build_index(rows, keys, capacity)
    asked = narrow.withColumn("cell", F.shiftrightunsigned("h", 64 - bits)).join(F.broadcast(buckets.select("cell", "bucket")), "cell")
    found = salted_join(asked.drop("cell"), index.drop("link"), ["bucket", "h", "text_sha256"], "group_size", F.col("doc_id"), total)
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
