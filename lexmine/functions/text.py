"""Text column functions with one fixed meaning of "space" and "word character".

Java, Python and RE2 disagree about ``\\s``, ``\\w`` and ``\\b`` outside ASCII, so the classes are spelled out.
Everything here is a built-in expression and stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unicode white space, including the four ASCII separators U+001C..U+001F.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind (``trim`` knows only U+0020)."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


# Text that ``normalize`` would only lower-case: single spaces between runs of characters that need no care.
# Rare scripts outside the ranges take the long way, with the same result.
_PLAIN = r"[!-%'-~\xa1-\x{167f}\x{3001}-\x{d7ff}]++"
TIDY = rf"^{_PLAIN}(?: {_PLAIN})*+\z"


def normalize(text: Column) -> Column:
    """Canonical keyword: no control characters or HTML entities, straight quotes, single spaces, lower case.

    Most keywords are tidy already, so one anchored match decides whether the replacements run at all.
    """
    tidy = F.regexp_replace(text, CONTROL, "")
    tidy = F.regexp_replace(tidy, rf"&#?{WORD}+;", " ")
    tidy = F.translate(tidy, "’“”", "'\"\"")
    # After the collapse only U+0020 is left at the ends, so the cheap trim is enough.
    tidy = F.trim(F.regexp_replace(tidy, rf"{SPACE}+", " "))
    return F.lower(F.when(text.rlike(TIDY), text).otherwise(tidy))


def fold(text: Column) -> Column:
    """Lower-cased text made comparable without a case-insensitive regex: long s and dotless i are the only
    lower-case letters that a Unicode case-insensitive match equates with ASCII ones."""
    return F.translate(text, "ſı", "si")


def words(text: Column) -> Column:
    """Words of a text whose spaces are already collapsed."""
    return F.split(text, " ", -1)


def split_words(text: Column) -> Column:
    """Words of any text: split on white space runs, no empty words."""
    return F.array_remove(F.split(strip(text), rf"{SPACE}+", -1), "")


def word_count(text: Column) -> Column:
    """Number of words of a text whose spaces are already collapsed."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1


def quote_plus(text: Column) -> Column:
    """Form encoding with ``~`` kept and ``*`` escaped."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
