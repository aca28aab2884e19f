"""Cleaning: normalise, filter, and merge duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmine import rules
from lexmine.functions.text import fold, normalize, word_count


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once.

    Filters that follow are otherwise pushed below the projection and each repeats the whole expression. A
    one-row generator keeps them above it.
    """
    kept = [F.col(c) for c in df.columns if c not in columns]
    made = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select(*kept, F.inline(F.array(made)))


def length_ok(keyword: Column, low: int = rules.MIN_LENGTH, high: int = rules.MAX_LENGTH) -> Column:
    return F.length(keyword).between(low, high)


def words_ok(keyword: Column, low: int = rules.MIN_WORDS, high: int = rules.MAX_WORDS) -> Column:
    return word_count(keyword).between(low, high)


def is_low_value(keyword: Column) -> Column:
    """Blocked words, pure digits, or nothing but symbols and non-Latin letters."""
    blocked = rules.Rule("blocked", words=rules.BLOCKED_WORDS).regex()
    return fold(keyword).rlike(rf"{blocked}|^\p{{Nd}}+$|^[^a-zA-Z0-9\s\-]+$")


def is_all_stopwords(keyword: Column) -> Column:
    stopword = f"(?:{'|'.join(rules.STOPWORDS)})"
    return keyword.rlike(rf"^{stopword}(?: {stopword})*\z")


def keep_keyword(keyword: Column) -> Column:
    """All cleaning filters, cheapest first."""
    return length_ok(keyword) & words_ok(keyword) & ~is_all_stopwords(keyword) & ~is_low_value(keyword)


def repeats_merged(df: DataFrame) -> DataFrame:
    """Rows that differ in ``seq`` alone, as the one of least seq; rows without a seq stay apart from those with one.

    A hash aggregate of fixed-size state. Aggregates of strings or sets sort their whole input from the 129th key on, so
    they should be given what this leaves.
    """
    others = [c for c in df.columns if c != "seq"]
    merged = df.groupBy(*others, F.col("seq").isNull().alias("_unnumbered")).agg(F.min("seq").alias("seq"))
    return merged.select(*df.columns)


def merge_duplicates(df: DataFrame, scope: str = "root_keyword", merge_channel: bool = False) -> DataFrame:
    """One row per keyword in its scope: the first record by ``seq``, with all source tags merged.

    Two aggregates with map-side combine: rows that differ in ``seq`` alone become one, then those of a keyword do.
    Neither shuffles all rows of a keyword that fills a third of the table to one task. ``merge_channel`` also merges the channels (off: the first record's channel stays).
    """
    merged = ["source", "channel"] if merge_channel else ["source"]
    rest = [c for c in df.columns if c not in {scope, "keyword", *merged}]
    out = repeats_merged(df).groupBy(scope, "keyword").agg(
        F.min_by(F.struct(*rest), "seq").alias("_first"),
        *[F.array_join(F.sort_array(F.collect_set(c)), "|").alias(c) for c in merged],
    )
    return out.select(*[F.col(f"_first.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def normalized(df: DataFrame) -> DataFrame:
    return once(df, keyword=normalize(F.col("keyword"))).select(*df.columns)


def clean(df: DataFrame) -> DataFrame:
    """Normalise, filter, merge duplicates: records -> one row per (root, keyword).

    The filters look at the keyword alone, so they commute with the merge. The size tests are cheap and keep long
    texts out of the shuffle; the regex tests wait until duplicates are gone.
    """
    keyword = F.col("keyword")
    sized = normalized(df).where(length_ok(keyword) & words_ok(keyword))
    merged = merge_duplicates(sized)
    wanted = ~is_all_stopwords(keyword) & ~is_low_value(keyword)
    return once(merged, _wanted=wanted).where("_wanted").drop("_wanted")
