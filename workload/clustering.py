"""Queries over features, clusters, counts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmine.operators import clusters, features, reports
from lexmine.operators.cleaning import clean
from lexmine.operators.cluster_fit import fit
from lexmine.plans.analysis import analyze
from lexmine.session import cut_lineage
from lexmine.sinks.files import conform
from workload import sql_base as s
from workload.captures import NARROW, records, table
from workload.labelling import RECORD
from workload.registry import query


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords with their labels; of the records' own columns only NARROW."""
    return analyze(records(spark, sf_dir).select(*NARROW))


def labelled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords with their labels and all columns of the records."""
    return analyze(records(spark, sf_dir))


FIXED_ID = "CAST(length(keyword) % 20 AS INTEGER)"
CLUSTERED_SQL = f"""{s.labelled_cte()},
ids AS (SELECT *, {FIXED_ID} AS cluster_id FROM labelled),
names AS (
  SELECT root_keyword, cluster_id,
         '[' || cluster_id || '] ' || coalesce(
           first(keyword ORDER BY length(keyword), seq) FILTER ({s.n_words('keyword')} <= 3), arg_min(keyword, seq)) AS cluster_label
  FROM ids GROUP BY root_keyword, cluster_id),
clustered AS (SELECT ids.*, cluster_label FROM ids JOIN names USING (root_keyword, cluster_id))"""


def with_fixed_ids(df: DataFrame) -> DataFrame:
    """Cluster ids that both engines can compute, for the steps after the fit."""
    return df.withColumn("cluster_id", (F.length("keyword") % 20).cast("int"))


def fixed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.with_labels(with_fixed_ids(cut_lineage(labelled(spark, sf_dir))))


GRAMS_SQL = f"""{s.clean_cte()},
split_words AS (SELECT root_keyword, keyword, unnest(string_split(keyword, ' ')) AS word FROM cleaned),
sized AS (SELECT root_keyword, keyword, ' ' || word || ' ' AS padded, unnest(range(2, least(4, length(word) + 2) + 1)) AS n FROM split_words),
grams AS (SELECT root_keyword, keyword, unnest(list_transform(range(1, length(padded) - n + 2), lambda i: substring(padded, i, n))) AS gram FROM sized),
tf AS (SELECT root_keyword, keyword, gram, count(*) AS tf FROM grams GROUP BY ALL)"""


@query("char_ngrams", f"WITH {GRAMS_SQL} SELECT root_keyword, gram, sum(tf)::BIGINT AS n, count(*) AS keywords FROM tf GROUP BY ALL")
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of each gram in each root's keywords."""
    counts = features.gram_counts(clean(records(spark, sf_dir).select(*NARROW))).where(F.col("gram").isNotNull())
    return counts.groupBy("root_keyword", "gram").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("keywords"))


@query("tfidf_weights", f"""WITH {GRAMS_SQL},
docs AS (SELECT root_keyword, count(*) AS n FROM cleaned GROUP BY ALL),
vocab AS (
  SELECT root_keyword, gram, count(*) AS df FROM tf GROUP BY root_keyword, gram
  QUALIFY row_number() OVER (PARTITION BY root_keyword ORDER BY sum(tf) DESC, gram) <= 20000),
raw AS (
  SELECT tf.root_keyword, keyword, gram, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS w
  FROM tf JOIN vocab USING (root_keyword, gram) JOIN docs USING (root_keyword)),
scaled AS (SELECT root_keyword, keyword, gram, w / sqrt(sum(w * w) OVER (PARTITION BY root_keyword, keyword)) AS w FROM raw)
SELECT root_keyword, gram, count(*) AS keywords, round(sum(w), 6) AS weight, round(max(w), 6) AS top_weight
FROM scaled GROUP BY ALL""")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit-length TF-IDF of every keyword, summed up per gram."""
    rows = features.tfidf(cut_lineage(clean(records(spark, sf_dir).select(*NARROW)).select("root_keyword", "keyword")))
    terms = rows.select("root_keyword", F.inline("terms"))
    return terms.groupBy("root_keyword", "gram").agg(
        F.count(F.lit(1)).alias("keywords"), F.round(F.sum("weight"), 6).alias("weight"),
        F.round(F.max("weight"), 6).alias("top_weight"),
    )


@query("tfidf_capped", f"""WITH {GRAMS_SQL},
vocab AS (
  SELECT root_keyword, gram FROM tf GROUP BY root_keyword, gram
  QUALIFY row_number() OVER (PARTITION BY root_keyword ORDER BY sum(tf) DESC, gram) <= 12)
SELECT tf.root_keyword, keyword, count(vocab.gram) AS terms FROM tf LEFT JOIN vocab USING (root_keyword, gram) GROUP BY ALL""")
def tfidf_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of every keyword with a vocabulary of 12 grams a root; many keywords have none."""
    rows = features.tfidf(cut_lineage(clean(records(spark, sf_dir).select(*NARROW)).select("root_keyword", "keyword")), max_features=12)
    return rows.select("root_keyword", "keyword", F.size("terms").cast("bigint").alias("terms"))


ALPHABETS = ["abcdefghij", "klmnopqrst", "uvwxyzäöüß", "0123456789"]


@query("cluster_planted", """
SELECT 'root' || p_partkey // 4 % 8 AS root_keyword, p_partkey % 4 AS planted, count(*) AS keywords, 1 AS clusters, 1 AS groups
FROM part GROUP BY ALL""")
def cluster_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of four alphabets in each root: each planted group is one cluster, and no cluster has two."""
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 4).alias("planted"))
    spelt = F.lit(None).cast("string")
    for i, letters in enumerate(ALPHABETS):
        word = F.concat(F.lit(f"{letters} "), F.translate(F.col("p_partkey").cast("string"), "0123456789", letters))
        spelt = F.when(F.col("planted") == i, word).otherwise(spelt)
    root = F.concat(F.lit("root"), (F.floor(F.col("p_partkey") / 4) % 8).cast("string"))
    planted = cut_lineage(part.select(root.alias("root_keyword"), spelt.alias("keyword"), "planted"))
    found = planted.join(fit(planted.select("root_keyword", "keyword"), n_clusters=4), ["root_keyword", "keyword"])
    pairs = found.groupBy("root_keyword", "planted", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    mixed = pairs.groupBy("root_keyword", "cluster_id").agg(F.count(F.lit(1)).alias("groups"))
    return pairs.join(mixed, ["root_keyword", "cluster_id"]).groupBy("root_keyword", "planted").agg(
        F.sum("n").alias("keywords"), F.count(F.lit(1)).alias("clusters"), F.max("groups").alias("groups"))


@query("cluster_labels", f"WITH {CLUSTERED_SQL} SELECT root_keyword, keyword, cluster_id, cluster_label FROM clustered")
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_clusters(spark, sf_dir).select("root_keyword", "keyword", "cluster_id", "cluster_label")


@query("cluster_summary", f"""WITH {CLUSTERED_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY root_keyword, cluster_id ORDER BY seq) AS rn FROM clustered),
kinds AS (SELECT root_keyword, cluster_id, keyword_type, min(seq) AS seq FROM clustered GROUP BY ALL),
types AS (SELECT root_keyword, cluster_id, string_agg(keyword_type, '|' ORDER BY seq) AS keyword_types FROM kinds GROUP BY ALL)
SELECT root_keyword, cluster_id, min(cluster_label) AS cluster_label, count(*) AS keyword_count,
       string_agg(keyword, ' | ' ORDER BY seq) FILTER (rn <= 5) AS sample_keywords, any_value(keyword_types) AS keyword_types
FROM numbered JOIN types USING (root_keyword, cluster_id) GROUP BY root_keyword, cluster_id""")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.summary(fixed_clusters(spark, sf_dir))


@query("cluster_small", f"""WITH {s.labelled_cte()},
types AS (SELECT root_keyword || '/' || keyword_type || '/' || search_intent || '/' || commercial_value AS root_keyword, keyword FROM labelled),
small AS (SELECT root_keyword FROM types GROUP BY ALL HAVING count(*) < 3)
SELECT root_keyword, keyword, 0 AS cluster_id, 'cluster_0' AS cluster_label FROM types WHERE root_keyword IN (SELECT root_keyword FROM small)""")
def cluster_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords scoped by root and labels, where a scope has fewer than three."""
    scope = F.concat_ws("/", "root_keyword", "keyword_type", "search_intent", "commercial_value")
    return clusters.small_clusters(labelled(spark, sf_dir).select(scope.alias("root_keyword"), "keyword"))


def _counts_sql(label: str, table: str = "labelled", cte: str | None = None) -> str:
    return f"WITH {cte or s.labelled_cte()} SELECT root_keyword, {label}, count(*) AS n FROM {table} GROUP BY ALL"


@query("count_by_channel", _counts_sql("channel", "records", s.records_cte()))
def count_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sorted_counts(records(spark, sf_dir), "channel")


@query("count_by_type", _counts_sql("keyword_type"))
def count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sorted_counts(labelled(spark, sf_dir), "keyword_type")


@query("count_by_intent", _counts_sql("search_intent"))
def count_by_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sorted_counts(labelled(spark, sf_dir), "search_intent")


@query("count_by_value", _counts_sql("commercial_value"))
def count_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sorted_counts(labelled(spark, sf_dir), "commercial_value")


@query("count_by_root", f"WITH {s.records_cte()} SELECT root_keyword, count(*) AS n FROM records GROUP BY ALL")
def count_by_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sorted_counts(records(spark, sf_dir), "root_keyword", scope=None)


@query("distribution_grouping_sets", f"""WITH {s.labelled_cte()}
SELECT 'root_type' AS distribution, root_keyword, keyword_type, NULL AS search_intent, NULL AS commercial_value, count(*) AS n FROM labelled GROUP BY ALL
UNION ALL SELECT 'root_intent', root_keyword, NULL, search_intent, NULL, count(*) FROM labelled GROUP BY ALL
UNION ALL SELECT 'root_value', root_keyword, NULL, NULL, commercial_value, count(*) FROM labelled GROUP BY ALL
UNION ALL SELECT 'type', NULL, keyword_type, NULL, NULL, count(*) FROM labelled GROUP BY ALL""")
def distribution_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distributions(labelled(spark, sf_dir))


@query("top20_high_value", f"""WITH {s.labelled_cte()}
SELECT root_keyword, CAST(row_number() OVER (PARTITION BY root_keyword ORDER BY seq) AS INTEGER) AS rank, keyword
FROM labelled WHERE commercial_value = 'High' QUALIFY rank <= 20""")
def top20_high_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_high_value(labelled(spark, sf_dir))


@query("top10_clusters", f"""WITH {CLUSTERED_SQL}, sized AS (SELECT root_keyword, cluster_label, count(*) AS n FROM clustered GROUP BY ALL)
SELECT root_keyword, CAST(row_number() OVER (PARTITION BY root_keyword ORDER BY n DESC, cluster_label) AS INTEGER) AS rank, cluster_label, n
FROM sized QUALIFY rank <= 10""")
def top10_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_clusters(fixed_clusters(spark, sf_dir))


TOTALS_SQL = f"""{s.labelled_cte()},
raw_n AS (SELECT root_keyword, count(*) AS raw_rows FROM records GROUP BY ALL),
clean_n AS (SELECT root_keyword, count(*) AS clean_rows FROM labelled GROUP BY ALL),
totals AS (SELECT root_keyword, raw_rows, coalesce(clean_rows, 0) AS clean_rows,
                  (1.0::DOUBLE - coalesce(clean_rows, 0)::DOUBLE / raw_rows) * 100.0::DOUBLE AS rate
           FROM raw_n LEFT JOIN clean_n USING (root_keyword))"""


@query("dedup_rate", f"""WITH {TOTALS_SQL}
SELECT root_keyword, raw_rows, clean_rows, round(rate, 6) AS rate, printf('%.1f%%', rate) AS rate_text FROM totals""")
def dedup_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = reports.root_totals(records(spark, sf_dir), labelled(spark, sf_dir))
    return totals.withColumn("rate", F.round("rate", 6))


@query("global_totals", f"""WITH {CLUSTERED_SQL}
SELECT 'raw' AS metric, count(*) AS value FROM records UNION ALL SELECT 'clean', count(*) FROM labelled
UNION ALL SELECT 'cluster_ids', count(DISTINCT cluster_id) FROM clustered
UNION ALL SELECT 'clusters', count(DISTINCT (root_keyword, cluster_id)) FROM clustered""")
def global_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labelled(spark, sf_dir)
    return reports.global_totals(records(spark, sf_dir), found, with_fixed_ids(found))


@query("concat_roots", f"""WITH {s.labelled_cte()}
SELECT {RECORD}, NULL AS keyword_type FROM records UNION ALL SELECT {RECORD}, keyword_type FROM labelled""")
def concat_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labelled_records(spark, sf_dir).drop("search_intent", "commercial_value", "page_type")
    return reports.concat_roots(records(spark, sf_dir), found)


@query("conform_output", f"""WITH {s.labelled_cte()}
SELECT keyword, root_keyword, source, channel, keyword_type, search_intent, page_type, commercial_value, title, description, url,
       language, country, strftime(collected_at, '%Y-%m-%dT%H:%M:%S') AS collected_at, '' AS cluster_id, '' AS cluster_label, seq
FROM labelled""")
def conform_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(labelled_records(spark, sf_dir))
