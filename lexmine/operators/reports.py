"""Counts, top lists and report text over records, labelled keywords and clusters.

Every count combines map-side, so a root that holds most of the table is no harder than any other. Rankings run on
counted rows, or keep only the first k per task before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmine import rules

ROOT = "root_keyword"


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def sorted_counts(df: DataFrame, label: str, scope: str | None = ROOT) -> DataFrame:
    """Rows per label, most frequent first inside each scope; equal counts in label order."""
    by = [scope, label] if scope else [label]
    order = [F.col(scope)] if scope else []
    return counts(df, *by).orderBy(*order, F.desc("n"), label)


def distributions(labelled: DataFrame) -> DataFrame:
    """Type, intent and value counts per root and type counts over all roots, in one pass.

    ``distribution`` names the count; columns that a count does not group by are NULL.
    """
    root, kind, intent, value = (F.col(c) for c in (ROOT, "keyword_type", "search_intent", "commercial_value"))
    grouped = labelled.groupingSets(
        [[root, kind], [root, intent], [root, value], [kind]], root, kind, intent, value
    ).agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n"))
    # grouping_id has one bit per column, set where the column is rolled up.
    name = F.when(F.col("_set") == 0b0011, "root_type").when(F.col("_set") == 0b0101, "root_intent")
    name = name.when(F.col("_set") == 0b0110, "root_value").otherwise("type")
    return grouped.select(name.alias("distribution"), ROOT, "keyword_type", "search_intent", "commercial_value", "n")


LIMIT_PUSHED = 1000  # above this the optimizer no longer cuts ranks per task before the shuffle
SPLITS = 64


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int | None = None, spread_by: str = "keyword") -> DataFrame:
    """Number rows inside each group; with ``k`` only the first k, cut per task before the shuffle.

    For a large ``k`` every group is first cut to k in each of its splits by ``spread_by``, so that one group never
    meets in a single task as a whole.
    """
    def first(frame: DataFrame, keys: list) -> DataFrame:
        return frame.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    if k is None:
        return first(df, by)
    if k > LIMIT_PUSHED:
        split = F.pmod(F.xxhash64(spread_by), F.lit(SPLITS))
        df = first(df.withColumn("_split", split), [*by, "_split"]).where(F.col("rank") <= k).drop("_split", "rank")
    return first(df, by).where(F.col("rank") <= k)


def top_high_value(labelled: DataFrame, k: int = rules.TOP_KEYWORDS) -> DataFrame:
    """First k high-value keywords of each root, in record order."""
    high = labelled.where(F.col("commercial_value") == rules.HIGH_VALUE).select(ROOT, "seq", "keyword")
    return ranked(high, [ROOT], [F.col("seq"), F.col("keyword")], k).select(ROOT, "rank", "keyword")


def top_clusters(clustered: DataFrame, k: int = rules.TOP_CLUSTERS) -> DataFrame:
    sized = counts(clustered, ROOT, "cluster_label")
    return ranked(sized, [ROOT], [F.desc("n"), F.col("cluster_label")], k).select(ROOT, "rank", "cluster_label", "n")


def half_even_text(rate: Column) -> Column:
    """One decimal, ties of the exact binary value to even. 2**56 makes every bit of a rate up to 100 an integer."""
    scaled = (rate * F.lit(float(2**56))).cast("bigint").cast("decimal(38,0)") * F.lit(10)
    unit = F.lit(2**56).cast("decimal(20,0)")
    whole = F.floor(rate * 10).cast("decimal(20,0)")
    # floor(rate * 10) may be one off where the product was rounded.
    whole = F.when(whole * unit > scaled, whole - 1).when((whole + 1) * unit <= scaled, whole + 1).otherwise(whole)
    twice = (scaled - whole * unit) * 2
    up = (twice > unit) | ((twice == unit) & (whole % 2 != 0))
    tenths = (whole + F.when(up, 1).otherwise(0)).cast("bigint")
    return F.concat((tenths / 10).cast("decimal(20,1)").cast("string"), F.lit("%"))


def dedup_rate(raw_rows: Column, clean_rows: Column) -> tuple[Column, Column]:
    """Share of records that cleaning removed: as a number and as report text (``N/A`` without records)."""
    rate = (F.lit(1.0) - clean_rows / F.greatest(raw_rows, F.lit(1))) * F.lit(100.0)
    text = F.when(raw_rows == 0, F.lit("N/A")).otherwise(half_even_text(rate))
    return F.when(raw_rows > 0, rate), text


def root_totals(records: DataFrame, labelled: DataFrame) -> DataFrame:
    """Raw and clean rows and the dedup rate of each root: two counts joined on the root."""
    raw = counts(records, ROOT).withColumnRenamed("n", "raw_rows")
    clean = counts(labelled, ROOT).withColumnRenamed("n", "clean_rows")
    both = raw.join(clean, ROOT, "left").withColumn("clean_rows", F.coalesce("clean_rows", F.lit(0)))
    rate, text = dedup_rate(F.col("raw_rows"), F.col("clean_rows"))
    return both.select(ROOT, "raw_rows", "clean_rows", rate.alias("rate"), text.alias("rate_text"))


def global_totals(records: DataFrame, labelled: DataFrame, clustered: DataFrame) -> DataFrame:
    """Totals over all roots, one row per metric.

    ``cluster_ids`` counts ids, which start again at 0 in each root; ``clusters`` counts clusters.
    """
    def one(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.agg(value.cast("bigint").alias("value")).select(F.lit(name).alias("metric"), "value")

    found = counts(clustered, ROOT, "cluster_id").agg(
        F.countDistinct("cluster_id").alias("cluster_ids"), F.count(F.lit(1)).alias("clusters"))
    names = ["cluster_ids", "clusters"]
    ids = found.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])))
    parts = [one(records, "raw", F.count(F.lit(1))), one(labelled, "clean", F.count(F.lit(1))), ids]
    return reduce(DataFrame.unionByName, parts)


def concat_roots(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; nothing is merged across roots, missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# ---- report text --------------------------------------------------------------------------------
# Headings and line formats of the text reports.

BAR = "=" * 60
ROOT_TITLE, GLOBAL_TITLE = "  SEO 关键词采集摘要报告", "  SEO 关键词采集 - 全局汇总报告"
ROOT_LINE, TIME_LINE = "  词根: %s", "  生成时间: %s"
TOTALS_HEAD, RAW_LINE, CLEAN_LINE, RATE_LINE = (
    "【采集数量】", "  原始关键词:  %6d 条", "  清洗后关键词:%6d 条", "  去重率:      %s",
)
CHANNEL_HEAD, CHANNEL_LINE = "【渠道来源统计（原始）】", "  %-30s %5d 条"
TYPE_HEAD, TYPE_LINE = "【关键词类型分布（清洗后）】", "  %-40s %5d 条"
INTENT_HEAD, INTENT_LINE = "【搜索意图分布】", "  %-20s %5d 条"
VALUE_HEAD, VALUE_LINE = "【商业价值分布】", "  %-10s %5d 条"
TOP_HEAD, TOP_LINE = "【Top 20 高商业价值关键词】", "  · %s"
CLUSTER_HEAD, CLUSTER_LINE = "【聚类分布（Top 10 聚类）】", "  %-50s %4d 条"
ROOTS_HEAD, SUMS_HEAD = "【词根列表】", "【总计】"
RAW_SUM_LINE, CLEAN_SUM_LINE, CLUSTER_SUM_LINE = (
    "  原始关键词总量:  %6d 条", "  清洗后总量:      %6d 条", "  聚类数量:        %d",
)
BY_ROOT_HEAD, BY_ROOT_LINE = "【各词根采集量（原始）】", "  %-40s %5d 条"
ALL_TYPES_HEAD = "【全局关键词类型分布】"


def _framed(df: DataFrame, head: Column, line: Column) -> DataFrame:
    """Ranked rows of (root_keyword, section) as lines: the heading at 0, each row at its rank, a blank at the end."""
    def at(number: Column, text: Column) -> Column:
        return F.struct(number.cast("bigint").alias("line_no"), text.alias("line"))

    whole = Window.partitionBy(ROOT, "section")
    rank = F.col("rank")
    lines = F.array(
        F.when(rank == 1, at(F.lit(0), head)), at(rank, line), F.when(rank == F.col("_last"), at(rank + 1, F.lit("")))
    )
    return df.withColumn("_last", F.max("rank").over(whole)).select(
        ROOT, "section", F.inline(F.filter(lines, lambda x: x.isNotNull()))
    )


def _fixed(df: DataFrame, section: int, lines: list[Column], by: list[str]) -> DataFrame:
    structs = [F.struct(F.lit(i).cast("bigint").alias("line_no"), c.alias("line")) for i, c in enumerate(lines)]
    return df.select(*by, F.lit(section).alias("section"), F.inline(F.array(*structs)))


def report_lines(records: DataFrame, labelled: DataFrame, clustered: DataFrame, generated_at: str) -> DataFrame:
    """The report of every root as rows (root_keyword, section, line_no, line)."""
    channels = counts(records, ROOT, "channel")
    shares = distributions(labelled).where(F.col("distribution") != "type").select(
        ROOT, "distribution", F.coalesce("keyword_type", "search_intent", "commercial_value").alias("label"), "n"
    )
    raw = channels.groupBy(ROOT).agg(F.sum("n").alias("raw_rows"))
    clean = shares.where(F.col("distribution") == "root_value").groupBy(ROOT).agg(F.sum("n").alias("clean_rows"))
    totals = raw.join(clean, ROOT, "left").withColumn("clean_rows", F.coalesce("clean_rows", F.lit(0)))
    totals = totals.withColumn("rate_text", dedup_rate(F.col("raw_rows"), F.col("clean_rows"))[1])
    bar = F.lit(BAR)
    head = _fixed(totals, 0, [
        bar, F.lit(ROOT_TITLE), F.format_string(ROOT_LINE, ROOT), F.lit(TIME_LINE % generated_at), bar,
        F.lit(""), F.lit(TOTALS_HEAD), F.format_string(RAW_LINE, "raw_rows"),
        F.format_string(CLEAN_LINE, "clean_rows"), F.format_string(RATE_LINE, "rate_text"), F.lit(""),
    ], [ROOT])
    # All counted sections share one ranking.
    section = F.when(F.col("distribution") == "root_type", 2).when(F.col("distribution") == "root_intent", 3).otherwise(4)
    counted = channels.select(ROOT, F.lit(1).alias("section"), F.col("channel").alias("label"), "n").unionByName(
        shares.select(ROOT, section.alias("section"), "label", "n")
    )
    counted = ranked(counted, [ROOT, "section"], [F.desc("n"), F.col("label")])
    title, text = F.lit(CHANNEL_HEAD), F.format_string(CHANNEL_LINE, "label", "n")
    for number, heading, line in [
        (2, TYPE_HEAD, TYPE_LINE), (3, INTENT_HEAD, INTENT_LINE), (4, VALUE_HEAD, VALUE_LINE),
    ]:
        here = F.col("section") == number
        title = F.when(here, F.lit(heading)).otherwise(title)
        text = F.when(here, F.format_string(line, "label", "n")).otherwise(text)
    top = top_high_value(labelled).withColumn("section", F.lit(5))
    groups = top_clusters(clustered).withColumn("section", F.lit(6))
    return reduce(DataFrame.unionByName, [
        head, _framed(counted, title, text),
        _framed(top, F.lit(TOP_HEAD), F.format_string(TOP_LINE, "keyword")),
        _framed(groups, F.lit(CLUSTER_HEAD), F.format_string(CLUSTER_LINE, "cluster_label", "n")),
        _fixed(totals, 7, [bar], [ROOT]),
    ])


def global_report_lines(
    records: DataFrame, labelled: DataFrame, clustered: DataFrame, roots: DataFrame, generated_at: str
) -> DataFrame:
    """The report over all roots as rows (section, line_no, line). ``roots`` has root_keyword and its position.

    Root lists are numbered by their own order: position for the list, (count, root) for the totals. Those lines
    carry no rank over the whole table, so nothing is pulled into one task; see ``sinks`` for the ordered file.
    """
    head = [BAR, GLOBAL_TITLE, TIME_LINE % generated_at, BAR, "", ROOTS_HEAD]
    spark = records.sparkSession
    one = spark.range(1)
    listed = roots.select(
        F.lit(1).alias("section"), F.col("position").cast("bigint").alias("line_no"),
        F.format_string(TOP_LINE, ROOT).alias("line"),
    )
    metric = lambda name: F.max(F.when(F.col("metric") == name, F.col("value")))
    sums = global_totals(records, labelled, clustered).agg(
        metric("raw").alias("raw"), metric("clean").alias("clean"), metric("cluster_ids").alias("ids")
    )
    sums = _fixed(sums, 2, [
        F.lit(""), F.lit(SUMS_HEAD), F.format_string(RAW_SUM_LINE, "raw"), F.format_string(CLEAN_SUM_LINE, "clean"),
        F.format_string(CLUSTER_SUM_LINE, "ids"), F.lit(""),
    ], [])
    # Descending count as the line number: larger counts come first, equal ones are told apart by the text.
    by_root = counts(records, ROOT).select(
        F.lit(4).alias("section"), (-F.col("n")).alias("line_no"), F.format_string(BY_ROOT_LINE, ROOT, "n").alias("line")
    )
    kinds = counts(labelled, "keyword_type").select(
        F.lit(7).alias("section"), (-F.col("n")).alias("line_no"),
        F.format_string(TYPE_LINE, "keyword_type", "n").alias("line"),
    )
    parts = [
        _fixed(one, 0, [F.lit(x) for x in head], []), listed, sums,
        _fixed(one, 3, [F.lit(BY_ROOT_HEAD)], []), by_root,
        _fixed(one, 5, [F.lit("")], []), _fixed(one, 6, [F.lit(ALL_TYPES_HEAD)], []), kinds,
        _fixed(one, 8, [F.lit(""), F.lit(BAR)], []),
    ]
    return reduce(DataFrame.unionByName, parts)
