"""Queries over keyword records: cleaning, labels, final map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmine.functions.text import fold, normalize
from lexmine.operators import cleaning, labels
from lexmine.plans import analysis
from workload import sql_base as s
from workload.captures import NARROW, records
from workload.registry import query

RECORD = "root_keyword, seq, keyword, source, channel, title, description, url, language, country, collected_at"


@query("raw_fixture", f"WITH {s.records_cte()} SELECT {RECORD} FROM records")
def raw_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir)


@query("normalize", f"WITH {s.records_cte()} SELECT root_keyword, seq, {s.norm('keyword')} AS keyword FROM records")
def normalize_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("root_keyword", "seq", normalize(F.col("keyword")).alias("keyword"))


def _filtered(spark: SparkSession, sf_dir: str, condition: Column) -> DataFrame:
    return cleaning.normalized(records(spark, sf_dir)).select("root_keyword", "seq", "keyword").where(condition)


def _filter_sql(condition: str) -> str:
    return (
        f"WITH {s.records_cte()}, norm AS (SELECT root_keyword, seq, {s.norm('keyword')} AS keyword FROM records) "
        f"SELECT * FROM norm WHERE {condition}"
    )


@query("len_filter", _filter_sql("length(keyword) BETWEEN 3 AND 120"))
def len_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, cleaning.length_ok(F.col("keyword")))


@query("word_filter", _filter_sql(f"{s.n_words('keyword')} BETWEEN 1 AND 15"))
def word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, cleaning.words_ok(F.col("keyword")))


@query("low_value_filter", _filter_sql(f"NOT {s.low_value('keyword')}"))
def low_value_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, ~cleaning.is_low_value(F.col("keyword")))


@query("stopword_filter", _filter_sql(f"NOT ({s.all_stop('keyword')})"))
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, ~cleaning.is_all_stopwords(F.col("keyword")))


@query("dedup_merge", f"""WITH {s.records_cte()}
SELECT root_keyword, min(seq) AS seq, keyword, string_agg(DISTINCT source, '|' ORDER BY source) AS source,
       arg_min(channel, seq) AS channel, arg_min(title, seq) AS title, arg_min(description, seq) AS description,
       arg_min(url, seq) AS url, arg_min(language, seq) AS language, arg_min(country, seq) AS country,
       arg_min(collected_at, seq) AS collected_at
FROM records GROUP BY root_keyword, keyword""")
def dedup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.merge_duplicates(records(spark, sf_dir))


@query("clean_keywords", f"WITH {s.clean_cte()} SELECT {RECORD} FROM cleaned")
def clean_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean(records(spark, sf_dir))


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cleaning.clean(records(spark, sf_dir).select(*NARROW)).select("root_keyword", "keyword")
    return kept.withColumn("m", fold(F.col("keyword")))


def _label_sql(columns: str) -> str:
    return (
        f"WITH {s.clean_cte()}, folded AS (SELECT root_keyword, keyword, translate(keyword, 'ſı', 'si') AS m "
        f"FROM cleaned) SELECT root_keyword, keyword, {columns} FROM folded"
    )


@query("classify_low_intent", _label_sql(f"{s.is_low_first('m')} AS low_intent"))
def classify_low_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir).select("root_keyword", "keyword", labels.is_low_intent(F.col("m")).alias("low_intent"))


@query("classify_core", _label_sql(f"{s.is_core('keyword', 'root_keyword')} AS core"))
def classify_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = labels.is_core(F.col("keyword"), F.col("root_keyword"))
    return _cleaned(spark, sf_dir).select("root_keyword", "keyword", core.alias("core"))


@query("classify_rules", _label_sql(f"{s.rule_case('m')} AS rule_type"))
def classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir).select("root_keyword", "keyword", labels.rule_type(F.col("m")).alias("rule_type"))


@query("classify_longtail", f"""WITH {s.labelled_cte()}
SELECT root_keyword, keyword FROM labelled WHERE keyword_type = 'Long Tail Keyword'""")
def classify_longtail(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = cleaning.once(
        _cleaned(spark, sf_dir),
        keyword_type=labels.keyword_type(F.col("keyword"), F.col("root_keyword"), match=F.col("m")),
    )
    return typed.where(F.col("keyword_type") == "Long Tail Keyword").select("root_keyword", "keyword")


@query("classify", _label_sql(f"{s.type_case('keyword', 'm', 'root_keyword')} AS keyword_type"))
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = labels.keyword_type(F.col("keyword"), F.col("root_keyword"), match=F.col("m"))
    return _cleaned(spark, sf_dir).select("root_keyword", "keyword", kind.alias("keyword_type"))


@query("intent", _label_sql(f"{s.intent_case('m')} AS search_intent"))
def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir).select("root_keyword", "keyword", labels.search_intent(F.col("m")).alias("search_intent"))


@query("commercial_value", _label_sql(f"{s.value_case('m')} AS commercial_value"))
def commercial_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = labels.commercial_value(F.col("m"))
    return _cleaned(spark, sf_dir).select("root_keyword", "keyword", value.alias("commercial_value"))


@query("page_type", f"""WITH {s.labelled_cte()}
SELECT root_keyword, keyword, keyword_type, search_intent, page_type FROM labelled""")
def page_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = analysis.analyze(records(spark, sf_dir).select(*NARROW))
    return labelled.select("root_keyword", "keyword", "keyword_type", "search_intent", "page_type")


@query("final_keyword_map", f"""WITH {s.labelled_cte()}
SELECT {RECORD}, keyword_type, search_intent, commercial_value, page_type
FROM labelled WHERE keyword_type <> 'Low Intent / Negative Keyword'
ORDER BY CASE commercial_value WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, keyword_type, keyword, root_keyword""")
def final_keyword_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.final_keyword_map(analysis.analyze(records(spark, sf_dir)))
