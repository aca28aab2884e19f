"""The queries over the given tables, one for each operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmine.llm import bestfit, bpe, centroids
from lexmine.llm.exact import exact_dedup
from lexmine.llm.langid import identify_documents
from lexmine.llm.licenses import expected_sql, scan
from lexmine.llm.mixing import mix
from lexmine.llm.neardup import near_duplicates
from lexmine.llm.negatives import hard_negatives
from lexmine.llm.packing import pack, summary
from lexmine.llm.pii import pii_digest
from lexmine.llm.registry import EXPECTED, QUERIES, query, table  # noqa: F401
from lexmine.llm.secrets import secrets_digest
from lexmine.llm.vectors import near_vectors


@query("op4_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def ranks() -> bytes:
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read()


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), ranks(), public_tokenizers.PATTERN))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(table(spark, sf_dir, "documents"))


@query("op6_mixing", r"""
WITH docs AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
    FROM documents),
named AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no
    FROM docs GROUP BY source),
weighed AS (
    SELECT *, CASE source_no % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS most FROM named),
levels AS (
    SELECT *, (1.5 * sum(source_size) OVER () - (sum(most) OVER upto - most))::DOUBLE / sum(weight) OVER onward AS level
    FROM weighed
    WINDOW upto AS (ORDER BY most::DOUBLE / weight, source_no ROWS UNBOUNDED PRECEDING),
           onward AS (ORDER BY most::DOUBLE / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
goals AS (
    SELECT source, source_size, CASE WHEN most::DOUBLE / weight <= level THEN most::DOUBLE
           ELSE weight * max(CASE WHEN most::DOUBLE / weight > level THEN level END) OVER () END AS target
    FROM levels),
placed AS (
    SELECT doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS quota,
           CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
    FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       greatest(least(start + size, quota) - start, 0)
       + greatest(least(start + size + source_size, quota) - start - source_size, 0) AS taken
FROM placed""")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


@query("op10_secrets")
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(table(spark, sf_dir, "documents"))


@query("op3_near_dedup", r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
    FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION SELECT r.doc_id, p.b FROM reached r JOIN (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) p ON r.other = p.a)
SELECT s.doc_id, CAST(len(any_value(s.s)) AS BIGINT) AS n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept
FROM sets s JOIN reached r ON s.doc_id = r.doc_id GROUP BY s.doc_id""")
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


@query("op7_vector_dedup", """
WITH RECURSIVE good AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reached AS (
    SELECT vec_id, vec_id AS other FROM embeddings
    UNION SELECT r.vec_id, p.b FROM reached r JOIN pairs p ON r.other = p.a),
counts AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT r.vec_id, coalesce(any_value(c.n), 0) AS n_links, min(r.other) AS component_id, r.vec_id = min(r.other) AS kept
FROM reached r LEFT JOIN counts c ON r.vec_id = c.a GROUP BY r.vec_id""")
def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op5_licenses", expected_sql())
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(pack(table(spark, sf_dir, "documents"), ranks(), public_tokenizers.PATTERN))


def _nearest(centres: str) -> str:
    """SQL for every kept vector with the nearest of the centroids, ties to the smaller number."""
    apart = "CAST(list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) AS BIGINT)"
    return f"""
    SELECT r, vec_id, v, number, d FROM (
        SELECT k.*, c.number, {apart} AS d, row_number() OVER (PARTITION BY k.r ORDER BY {apart}, c.number) AS place
        FROM kept k CROSS JOIN {centres} c) WHERE place = 1"""


def _means(given: str, before: str) -> str:
    """SQL for the floors of the clusters' means; an empty cluster keeps its centroid."""
    return f"""
    SELECT number, CASE WHEN any_value(m.v) IS NULL THEN any_value(b.v) ELSE any_value(m.v) END AS v FROM {before} b LEFT JOIN (
        SELECT number, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
            SELECT number, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM {given} CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY number, i)
        GROUP BY number) m USING (number) GROUP BY number"""


@query("op11_centroids", f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
    SELECT number - 1 AS number, v FROM (
        SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) AS number, v FROM kept) WHERE number <= 16),
a0 AS MATERIALIZED ({_nearest("c0")}), c1 AS MATERIALIZED ({_means("a0", "c0")}),
a1 AS MATERIALIZED ({_nearest("c1")}), c2 AS MATERIALIZED ({_means("a1", "c1")}),
a2 AS MATERIALIZED ({_nearest("c2")}), c3 AS MATERIALIZED ({_means("a2", "c2")}),
a3 AS MATERIALIZED ({_nearest("c3")})
SELECT vec_id, CAST(a.number AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.number) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a3 a JOIN c3 c ON a.number = c.number""")
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.summary(*centroids.cluster(table(spark, sf_dir, "embeddings")))


@query("op12_hard_negatives", """
WITH rows AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id, a.label = b.label AS same,
           CAST(coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
positives AS (
    SELECT r, anchor_id, other, vec_id AS positive_id, score AS positive_score FROM (
        SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS place FROM scores WHERE same) WHERE place <= 5),
found AS (
    SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.r, p.other ORDER BY s.score DESC, s.vec_id NULLS LAST) AS place
    FROM positives p JOIN scores s ON p.r = s.r
    WHERE NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE place <= 3""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, id_ = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    moved = F.when(id_ % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), id_ % 50 == 0)


@query("op13_best_fit")
def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        vocabulary = file.read()
    return bestfit.pack(bestfit.digests(bestfit.pieces(table(spark, sf_dir, "documents"), vocabulary, end=1)))
