"""Keyword types against a whole table of roots, without a comparison of every keyword with every root.

A keyword is core if it is short and holds the first two words of some root as substrings (which a keyword that holds
the whole root does). A substring without spaces lies inside one word of the keyword, so roots are proposed by an
inverted index: each pair of first words is filed under its rarer word, and that word under its rarest gram. The grams
of the keywords' different words find index words, containment is tested, and only then come keywords and pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmine import rules
from lexmine.functions.text import fold, split_words, word_count, words
from lexmine.operators.cleaning import once
from lexmine.operators.joins import salted_join
from lexmine.operators.labels import first_hit, is_low_intent

GRAM = 3


def grams(word: Column, size: Column) -> Column:
    """The different substrings of one size."""
    last = F.length(word) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(word, i, size))))


def first_words(roots: DataFrame) -> DataFrame:
    """The different pairs of first words; ``two`` is empty for roots of one word. Roots without a word are left out."""
    found = split_words(F.lower(F.col("root_keyword")))
    pairs = roots.select(found.alias("_words")).select(
        F.get("_words", F.lit(0)).alias("one"), F.coalesce(F.get("_words", F.lit(1)), F.lit("")).alias("two"))
    return pairs.where(F.col("one").isNotNull()).distinct()


def filed(pairs: DataFrame) -> DataFrame:
    """(key, other): each pair under the word that fewer pairs have."""
    both = pairs.select(F.explode(F.array("one", "two")).alias("word")).where("word <> ''")
    uses = both.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    one, two = uses.withColumnsRenamed({"word": "one", "n": "n_one"}), uses.withColumnsRenamed({"word": "two", "n": "n_two"})
    counted = salted_join(pairs, one, ["one"], "two")
    alone = counted.where("two = ''").select(F.col("one").alias("key"), F.lit("").alias("other"))
    judged = salted_join(counted.where("two <> ''"), two, ["two"], "one")
    rarer = F.when(F.col("n_one") <= F.col("n_two"), F.struct(F.col("one").alias("key"), F.col("two").alias("other"))).otherwise(
        F.struct(F.col("two").alias("key"), F.col("one").alias("other")))
    return judged.select(rarer.alias("at")).select("at.*").unionByName(alone).distinct()


def index(keys: DataFrame) -> DataFrame:
    """(gram, key): each key under that of its grams which the fewest keys have. Keys shorter than a gram are their own."""
    size = F.least(F.length("key"), F.lit(GRAM))
    listed = keys.select("key").distinct().select("key", F.explode(grams(F.col("key"), size)).alias("gram"))
    uses = listed.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counted = salted_join(listed, uses, ["gram"], "key")
    return counted.groupBy("key").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")).select("gram", "key")


def contained(vocabulary: DataFrame, keys: DataFrame) -> DataFrame:
    """(word, key) for every key that is a substring of a word of the vocabulary."""
    word = F.col("word")
    listed = vocabulary.select("word", F.explode(F.flatten(F.array_compact(F.array(*[grams(word, F.lit(n)) for n in range(1, GRAM + 1)])))).alias("gram"))
    proposed = salted_join(listed, index(keys), ["gram"], "word")
    return proposed.where(F.contains(word, F.col("key"))).select("word", "key")


def core_keywords(keywords: DataFrame, roots: DataFrame) -> DataFrame:
    """The different keywords of few words that hold the first two words of some root."""
    short = keywords.select("keyword").where(word_count(F.col("keyword")) <= rules.CORE_MAX_WORDS).distinct()
    spread = short.select("keyword", F.explode(F.array_distinct(words(F.col("keyword")))).alias("word"))
    pairs = filed(first_words(roots))
    found = contained(spread.select("word").distinct(), pairs)
    held = salted_join(spread, found, ["word"], "keyword").select("keyword", "key").distinct()
    matched = salted_join(held, pairs, ["key"], "keyword").where(F.contains("keyword", F.col("other")))
    return matched.select("keyword").distinct()


def sharing_keywords(keywords: DataFrame, roots: DataFrame) -> DataFrame:
    """The different keywords, below the length of a long tail, that have a word of some root."""
    short = keywords.select("keyword").where(word_count(F.col("keyword")) < rules.LONG_TAIL_MIN_WORDS).distinct()
    spread = short.select("keyword", F.explode(words(F.col("keyword"))).alias("word"))
    known = roots.select(F.explode(split_words(F.lower(F.col("root_keyword")))).alias("word")).distinct()
    return salted_join(spread, known, ["word"], "keyword").select("keyword").distinct()


def classify(keywords: DataFrame, roots: DataFrame) -> DataFrame:
    """keyword, keyword_type of every different keyword (normalised), judged against all of ``roots``.

    Low intent, short with the first words of a root, phrase rules, long tail, any word of a root, else industrial.
    ``roots`` has root_keyword; an empty table leaves the two root steps out.
    """
    def flagged(df: DataFrame, core: bool, shares: bool) -> DataFrame:
        return df.select("keyword", F.lit(core).alias("core"), F.lit(shares).alias("shares"))

    every = flagged(keywords, False, False).unionByName(flagged(core_keywords(keywords, roots), True, False))
    every = every.unionByName(flagged(sharing_keywords(keywords, roots), False, True))
    known = every.groupBy("keyword").agg(F.bool_or("core").alias("core"), F.bool_or("shares").alias("shares"))
    match = F.col("_match")
    leftover = F.when(word_count(F.col("keyword")) >= rules.LONG_TAIL_MIN_WORDS, rules.LONG_TAIL).when(F.col("shares"), rules.CORE)
    kind = F.when(is_low_intent(match), rules.LOW_INTENT).when(F.col("core"), rules.CORE).otherwise(
        first_hit(match, rules.TYPE_RULES, leftover.otherwise(rules.INDUSTRIAL)))
    return once(known.withColumn("_match", fold(F.col("keyword"))), keyword_type=kind).select("keyword", "keyword_type")
