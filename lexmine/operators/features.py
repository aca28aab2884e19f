"""Character n-gram TF-IDF of keywords, per scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmine import rules
from lexmine.operators.reports import ranked
from lexmine.session import cut_lineage

ROOT = "root_keyword"
ROWS_PER_TASK = 10_000  # keywords whose grams one task counts


def char_ngrams(keyword: Column) -> Column:
    """n-grams of 2 to 4 characters inside each word padded with one space on both sides.

    In the padded keyword such a window has spaces at its ends only, and not only spaces. An overlapping match per
    length finds them all; repeats are kept.
    """
    padded = F.concat(F.lit(" "), keyword, F.lit(" "))
    windows = ["(?=([^ ]{2}| [^ ]|[^ ] ))", "(?=(.[^ ].))", "(?=(.[^ ]{2}.))"]
    return F.concat(*[F.regexp_extract_all(padded, F.lit(w), 1) for w in windows])


def gram_counts(df: DataFrame, scope: str = ROOT) -> DataFrame:
    """Grams of each keyword; one without grams keeps a row whose gram is null."""
    grams = df.select(scope, "keyword", F.explode_outer(char_ngrams(F.col("keyword"))).alias("gram"))
    return grams.groupBy(scope, "keyword", "gram").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(df: DataFrame, scope: str = ROOT, max_features: int = rules.MAX_FEATURES) -> DataFrame:
    """The most frequent grams of each scope with their smoothed idf; ``idx`` numbers them from 0.

    A scope's grams are cut to ``max_features`` in each of their splits before they meet.
    """
    n = df.groupBy(scope).agg(F.count(F.lit(1)).alias("_n"))
    found = gram_counts(df, scope).where(F.col("gram").isNotNull()).groupBy(scope, "gram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("_total"))
    top = ranked(found, [scope], [F.desc("_total"), F.col("gram")], max_features, "gram")
    idf = F.log((F.lit(1.0) + F.col("_n")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return top.join(n, scope).select(scope, "gram", (F.col("rank") - 1).alias("idx"), idf.alias("idf"))


def tfidf(df: DataFrame, scope: str = ROOT, max_features: int = rules.MAX_FEATURES, grams: bool = True) -> DataFrame:
    """One row per keyword with its grams as an array of (gram, idx, weight); weights have length 1.

    A keyword of which no gram is in the vocabulary keeps its row, with an empty array. Only the narrow keywords are
    shuffled before they grow into grams; the vocabulary, built first, is joined as its measured size allows, and
    skewed grams are split. ``grams=False`` leaves the gram text out of the arrays.
    """
    keywords = df.select(scope, "keyword")
    # A keyword grows into about a hundred grams, which adaptive coalescing cannot foresee: tasks follow the rows.
    tasks = max(keywords.sparkSession.sparkContext.defaultParallelism, -(-keywords.count() // ROWS_PER_TASK))
    keywords = keywords.repartition(tasks, scope, "keyword")
    vocab = cut_lineage(vocabulary(keywords, scope, max_features))
    terms = gram_counts(keywords, scope).join(vocab, [scope, "gram"], "left")
    weight = (F.lit(1.0) + F.log("tf")) * F.col("idf")
    weighted = terms.select(scope, "keyword", "gram", "idx", weight.alias("w"))
    parts = ["idx", "gram", "w"] if grams else ["idx", "w"]
    rows = weighted.groupBy(scope, "keyword").agg(
        F.sort_array(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct(*parts)))).alias("terms"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"),
    )

    def scaled(t: Column) -> Column:
        return F.struct(*([t["gram"]] if grams else []), t["idx"], (t["w"] / F.col("_norm")).alias("weight"))

    return rows.select(scope, "keyword", F.transform("terms", scaled).alias("terms"))
