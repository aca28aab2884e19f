"""Keyword type, search intent, commercial value and page type: ordered rules as CASE expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmine import rules
from lexmine.functions.patterns import Rule
from lexmine.functions.text import fold, split_words, word_count, words
from lexmine.operators.cleaning import once


def first_hit(text: Column, ordered: list[Rule], otherwise: Column) -> Column:
    """Label of the first rule that matches the folded text."""
    start, *others = ordered
    case = F.when(start.hit(text), F.lit(start.label))
    return reduce(lambda c, rule: c.when(rule.hit(text), F.lit(rule.label)), others, case).otherwise(otherwise)


def mentions_root(keyword: Column, root: Column) -> Column:
    """The whole root, or each of its first two words, occurs in the keyword as a substring."""
    root = F.lower(root)
    root_words = split_words(root)
    second = F.get(root_words, F.lit(1))
    return F.contains(keyword, root) | (
        F.contains(keyword, F.coalesce(F.get(root_words, F.lit(0)), F.lit("")))
        & F.contains(keyword, F.coalesce(second, F.lit("")))
    )


def is_low_intent(match: Column) -> Column:
    return rules.LOW_INTENT_FIRST.hit(match)


def is_core(keyword: Column, *roots: Column) -> Column:
    mentioned = reduce(lambda a, b: a | b, [mentions_root(keyword, r) for r in roots])
    return (word_count(keyword) <= rules.CORE_MAX_WORDS) & mentioned


def shares_root_word(keyword: Column, *roots: Column) -> Column:
    shared = [F.arrays_overlap(words(keyword), split_words(F.lower(r))) for r in roots]
    return reduce(lambda a, b: a | b, shared)


def rule_type(match: Column) -> Column:
    """The phrase rules alone; NULL where none applies."""
    return first_hit(match, rules.TYPE_RULES, F.lit(None).cast("string"))


def keyword_type(keyword: Column, *roots: Column, match: Column | None = None) -> Column:
    """Low intent, short keyword with the root, phrase rules, long tail, shared root word, else industrial.

    ``roots`` may be several columns (or literals); without any, the two root steps are skipped. ``match`` is
    the folded keyword, where the caller has it as a column already.
    """
    match = fold(keyword) if match is None else match
    leftover = F.when(word_count(keyword) >= rules.LONG_TAIL_MIN_WORDS, rules.LONG_TAIL)
    if roots:
        leftover = leftover.when(shares_root_word(keyword, *roots), rules.CORE)
    leftover = leftover.otherwise(rules.INDUSTRIAL)
    by_rule = first_hit(match, rules.TYPE_RULES, leftover)
    case = F.when(is_low_intent(match), rules.LOW_INTENT)
    if roots:
        case = case.when(is_core(keyword, *roots), rules.CORE)
    return case.otherwise(by_rule)


def search_intent(match: Column) -> Column:
    return first_hit(match, rules.INTENT_RULES, F.lit(rules.INFORMATIONAL))


def commercial_value(match: Column) -> Column:
    by_length = F.when(word_count(match) >= rules.MEDIUM_MIN_WORDS, rules.MEDIUM_VALUE).otherwise(rules.LOW_VALUE)
    return first_hit(match, rules.VALUE_RULES, by_length)


def page_type_rows() -> list[tuple[str, str, str]]:
    """Every (type, intent) pair with its page: 13 x 4 rows."""
    rows = []
    for kind in rules.KEYWORD_TYPES:
        pages = rules.PAGE_TYPES.get(kind, {})
        fallback = next(iter(pages.values()), rules.DEFAULT_PAGE)
        rows.extend((kind, intent, pages.get(intent, fallback)) for intent in rules.INTENTS)
    return rows


def page_types(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{kind}', '{intent}', '{page}')" for kind, intent, page in page_type_rows())
    return spark.sql(f"SELECT * FROM VALUES {values} AS pages(keyword_type, search_intent, page_type)")


def with_page_type(df: DataFrame) -> DataFrame:
    """Look the page up in the 52-row dimension; its size is fixed, so it is always broadcast."""
    pages = F.broadcast(page_types(df.sparkSession))
    joined = df.join(pages, ["keyword_type", "search_intent"], "left")
    return joined.select(*df.columns, F.coalesce("page_type", F.lit(rules.DEFAULT_PAGE)).alias("page_type"))


def label(df: DataFrame) -> DataFrame:
    """Add keyword_type, search_intent, commercial_value and page_type; each rule list runs once per row."""
    kw, match = F.col("keyword"), F.col("_match")
    labelled = once(
        df.withColumn("_match", fold(kw)),
        keyword_type=keyword_type(kw, F.col("root_keyword"), match=match),
        search_intent=search_intent(match),
        commercial_value=commercial_value(match),
    ).drop("_match")
    return with_page_type(labelled)
