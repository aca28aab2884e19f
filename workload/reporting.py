"""Queries over fitted clusters and report text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmine.operators import reports
from lexmine.operators.clusters import with_labels
from lexmine.plans.analysis import cluster
from lexmine.session import cut_lineage
from workload.captures import records, table
from workload.clustering import CLUSTERED_SQL, labelled, with_fixed_ids
from workload.registry import query
from workload import sql_base as s

AT = "2024-01-01 00:00:00"


@query("cluster")
def fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fitted model per root. The SVD and the starts are random, so ids cannot be stated in SQL."""
    return cluster(labelled(spark, sf_dir)).select("root_keyword", "keyword", "cluster_id", "cluster_label")


@query("cluster_invariants", f"""WITH {s.labelled_cte()}
SELECT root_keyword, count(*) AS keywords, count(DISTINCT keyword) AS distinct_keywords, least(20, count(*) - 1) AS max_clusters,
       0 AS bad_ids, 0 AS bad_labels FROM labelled GROUP BY root_keyword""")
def cluster_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every keyword is in one cluster of its root, ids are in range, labels belong to their own cluster."""
    found = cluster(labelled(spark, sf_dir))
    own = F.concat(F.lit("["), F.col("cluster_id").cast("string"), F.lit("] "), F.col("keyword")) == F.col("cluster_label")
    per_cluster = found.groupBy("root_keyword", "cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("keyword").alias("k"), F.max(own).alias("own"),
        F.countDistinct("cluster_label").alias("labels"),
    )
    n = F.sum("n")
    top = F.least(F.lit(20), n - 1)
    bad_ids = F.sum(F.when((F.col("cluster_id") < 0) | (F.col("cluster_id") > 19), 1).otherwise(0))
    bad_labels = F.sum(F.when(~F.col("own") | (F.col("labels") != 1), 1).otherwise(0))
    return per_cluster.groupBy("root_keyword").agg(
        n.alias("keywords"), F.sum("k").alias("distinct_keywords"), top.alias("max_clusters"),
        F.greatest(bad_ids, F.when(F.count(F.lit(1)) > top, 1).otherwise(0)).alias("bad_ids"), bad_labels.alias("bad_labels"),
    )


def _padded(label: str, width: int, n: str, digits: int) -> str:
    return f"'  ' || {label} || repeat(' ', greatest(0, {width} - length({label}))) || ' ' || lpad({n}::VARCHAR, {digits}, ' ') || ' 条'"


def _section(number: int, head: str, table_name: str, line: str) -> str:
    return f"""
SELECT root_keyword, {number} AS section, rn AS line_no, {line} AS line FROM {table_name}
UNION ALL SELECT DISTINCT root_keyword, {number}, 0, '{head}' FROM {table_name}
UNION ALL SELECT root_keyword, {number}, max(rn) + 1, '' FROM {table_name} GROUP BY root_keyword"""


def _ranked(name: str, source: str, label: str, limit: str = "") -> str:
    return f"""{name} AS (
  SELECT root_keyword, {label} AS label, count(*) AS n, row_number() OVER (PARTITION BY root_keyword ORDER BY count(*) DESC, {label}) AS rn
  FROM {source} GROUP BY root_keyword, {label} {limit})"""


BAR = "=" * 60
REPORT_SQL = f"""WITH {CLUSTERED_SQL},
raw_n AS (SELECT root_keyword, count(*) AS raw_rows FROM records GROUP BY ALL),
clean_n AS (SELECT root_keyword, count(*) AS clean_rows FROM labelled GROUP BY ALL),
totals AS (SELECT root_keyword, raw_rows, clean_rows, (1.0::DOUBLE - clean_rows::DOUBLE / raw_rows) * 100.0::DOUBLE AS rate
           FROM raw_n JOIN clean_n USING (root_keyword)),
{_ranked('channels', 'records', 'channel')},
{_ranked('types', 'labelled', 'keyword_type')},
{_ranked('intents', 'labelled', 'search_intent')},
{_ranked('worth', 'labelled', 'commercial_value')},
{_ranked('sizes', 'clustered', 'cluster_label', 'QUALIFY rn <= 10')},
tops AS (SELECT root_keyword, keyword AS label, 0 AS n, row_number() OVER (PARTITION BY root_keyword ORDER BY seq) AS rn
         FROM labelled WHERE commercial_value = 'High' QUALIFY rn <= 20),
heads AS (SELECT root_keyword, ['{BAR}', '  SEO 关键词采集摘要报告', '  词根: ' || root_keyword, '  生成时间: {AT}', '{BAR}', '', '【采集数量】',
            '  原始关键词:  ' || lpad(raw_rows::VARCHAR, 6, ' ') || ' 条', '  清洗后关键词:' || lpad(clean_rows::VARCHAR, 6, ' ') || ' 条',
            '  去重率:      ' || printf('%.1f%%', rate), ''] AS lines FROM totals)
SELECT root_keyword, 0 AS section, i - 1 AS line_no, lines[i] AS line FROM (SELECT root_keyword, lines, unnest(range(1, 12)) AS i FROM heads)
UNION ALL {_section(1, '【渠道来源统计（原始）】', 'channels', _padded('label', 30, 'n', 5))}
UNION ALL {_section(2, '【关键词类型分布（清洗后）】', 'types', _padded('label', 40, 'n', 5))}
UNION ALL {_section(3, '【搜索意图分布】', 'intents', _padded('label', 20, 'n', 5))}
UNION ALL {_section(4, '【商业价值分布】', 'worth', _padded('label', 10, 'n', 5))}
UNION ALL {_section(5, '【Top 20 高商业价值关键词】', 'tops', "'  · ' || label")}
UNION ALL {_section(6, '【聚类分布（Top 10 聚类）】', 'sizes', _padded('label', 50, 'n', 4))}
UNION ALL SELECT root_keyword, 7, 0, '{BAR}' FROM totals"""


@query("report_lines", REPORT_SQL)
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_lineage(labelled(spark, sf_dir))
    return reports.report_lines(records(spark, sf_dir), found, with_labels(with_fixed_ids(found)), AT)


@query("report_lines_global", f"""WITH {CLUSTERED_SQL},
fixed(section, line_no, line) AS (VALUES
  (0, 0, '{BAR}'), (0, 1, '  SEO 关键词采集 - 全局汇总报告'), (0, 2, '  生成时间: {AT}'), (0, 3, '{BAR}'), (0, 4, ''), (0, 5, '【词根列表】'),
  (2, 0, ''), (2, 1, '【总计】'), (2, 5, ''), (3, 0, '【各词根采集量（原始）】'), (5, 0, ''), (6, 0, '【全局关键词类型分布】'), (8, 0, ''), (8, 1, '{BAR}'))
SELECT * FROM fixed
UNION ALL SELECT 1, min(p_partkey), '  · ' || lower(p_name) FROM part GROUP BY lower(p_name)
UNION ALL SELECT 2, 2, '  原始关键词总量:  ' || lpad(count(*)::VARCHAR, 6, ' ') || ' 条' FROM records
UNION ALL SELECT 2, 3, '  清洗后总量:      ' || lpad(count(*)::VARCHAR, 6, ' ') || ' 条' FROM labelled
UNION ALL SELECT 2, 4, '  聚类数量:        ' || count(DISTINCT cluster_id) FROM clustered
UNION ALL SELECT 4, -n, {_padded('root_keyword', 40, 'n', 5)} FROM (SELECT root_keyword, count(*) AS n FROM records GROUP BY ALL)
UNION ALL SELECT 7, -n, {_padded('keyword_type', 40, 'n', 5)} FROM (SELECT keyword_type, count(*) AS n FROM labelled GROUP BY ALL)""")
def report_lines_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_lineage(labelled(spark, sf_dir))
    roots = table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("root_keyword")).agg(F.min("p_partkey").alias("position"))
    return reports.global_report_lines(records(spark, sf_dir), found, with_labels(with_fixed_ids(found)), roots, AT)
