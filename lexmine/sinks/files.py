"""Write results: CSV exports and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from lexmine import rules
from lexmine.operators.ordered import with_positions
from lexmine.sinks import versions
from lexmine.sinks.landing import BUCKETS, bucket_number, bucket_of, by_bucket

CSV_OPTIONS = {
    "header": "true", "escape": '"', "emptyValue": "", "nullValue": "", "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def slug(root: Column) -> Column:
    return F.replace(F.lower(root), F.lit(" "), F.lit("-"))


def iso_text(timestamp: Column) -> Column:
    """ISO text with six fraction digits, or none at a whole second."""
    text = timestamp.cast("string")
    fraction = F.substring(text, 20, 7)
    return F.concat(
        F.replace(F.substring(text, 1, 19), F.lit(" "), F.lit("T")),
        F.when(fraction == "", "").otherwise(F.rpad(fraction, 7, "0")),
    )


def conform(df: DataFrame, *inner: str) -> DataFrame:
    """The 16 output columns in their order, missing ones empty, other columns after them. ``inner`` are dropped."""
    def column(name: str) -> Column:
        if name not in df.columns:
            return F.lit("").alias(name)
        return iso_text(F.col(name)).alias(name) if name == "collected_at" else F.col(name)

    extra = [c for c in df.columns if c not in rules.OUTPUT_COLUMNS and c not in inner]
    return df.select(*[column(c) for c in rules.OUTPUT_COLUMNS], *extra)


def _written(rows: DataFrame, path: str, *by: str) -> bool:
    """Write a CSV export in one pass; whether it has rows. An empty one is taken away again."""
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    (counted.write.partitionBy(*by) if by else counted.write).mode("overwrite").options(**CSV_OPTIONS).csv(path)
    if not seen.get["n"]:
        versions.remove(rows.sparkSession, path)
    return seen.get["n"] > 0


def csv_lines(df: DataFrame) -> DataFrame:
    """root_keyword, slug and the CSV text of every row, as the exports write it."""
    out = conform(df, "seq")
    return out.select("root_keyword", slug(F.col("root_keyword")).alias("slug"), F.to_csv(F.struct(*out.columns), CSV_OPTIONS).alias("line"))


def write_ordered_csv(df: DataFrame, path: str, order: list[Column | str], rows_per_part: int = 1_000_000) -> bool:
    """A CSV export in a total order: row n is in the folder ``part=<(n - 1) / rows_per_part>``, parts named in order.

    Every folder has one file of at most ``rows_per_part`` rows, in order.
    """
    numbered = with_positions(df, *order)
    part = F.lpad(F.expr(f"(position - 1) div {int(rows_per_part)}").cast("string"), 9, "0")
    dealt = numbered.withColumn("part", part).repartition("part").sortWithinPartitions("part", "position")
    return _written(conform(dealt, "seq", "position"), path, "part")


def write_csv(df: DataFrame, path: str) -> bool:
    """One CSV export; an empty frame writes nothing."""
    return _written(conform(df, "seq"), path)


def write_csv_per_root(df: DataFrame, path: str, buckets: int = BUCKETS) -> bool:
    """The exports of all roots in a fixed number of folders ``bucket=<n>``; a root's rows are together and in order.

    ``root_rows`` finds those of one root.
    """
    order = ["seq"] if "seq" in df.columns else []
    dealt = by_bucket(df, buckets, *order)
    return _written(conform(dealt, "seq"), path, "bucket")


def root_rows(spark: SparkSession, path: str, root: str, extra: list[str] = [], buckets: int = BUCKETS) -> DataFrame:
    """The export of one root, read back from its bucket alone."""
    schema = ", ".join(f"`{c}` string" for c in [*rules.OUTPUT_COLUMNS, *extra])
    folder = f"bucket={bucket_number(root, buckets)}"
    if folder not in versions.children(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).options(**CSV_OPTIONS).csv(f"{path}/{folder}")
    return rows.where(F.col("root_keyword") == root)


def export_per_root(records: DataFrame, labelled: DataFrame, clustered: DataFrame, folder: str) -> None:
    write_csv_per_root(records, f"{folder}/keywords_raw")
    write_csv_per_root(labelled, f"{folder}/keywords_clean")
    write_csv_per_root(clustered, f"{folder}/keyword_clusters")


def export_all(
    records: DataFrame, labelled: DataFrame, clustered: DataFrame, final_map: DataFrame, map_order: list[Column | str], folder: str
) -> None:
    """``final_map`` needs no order; its export is written in ``map_order``."""
    write_csv(records, f"{folder}/all_keywords")
    write_csv(labelled, f"{folder}/all_keywords_clean")
    write_csv(clustered, f"{folder}/all_keyword_clusters")
    write_ordered_csv(final_map, f"{folder}/final_keyword_map", map_order)


def write_root_reports(lines: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Reports of all roots in a fixed number of folders ``bucket=<n>``, back to back in the order of the roots.

    A report has a bounded number of lines, so each root's lines are in one file.
    """
    out = lines.withColumn("bucket", bucket_of(F.col("root_keyword"), buckets)).repartition("bucket")
    out = out.sortWithinPartitions("bucket", "root_keyword", "section", "line_no").select("bucket", "line")
    out.write.mode("overwrite").partitionBy("bucket").text(path)


def write_global_report(lines: DataFrame, path: str) -> None:
    """Range-partitioned by line, so the parts read in order form the report however many roots there are."""
    lines.orderBy("section", "line_no", "line").select("line").write.mode("overwrite").text(path)
