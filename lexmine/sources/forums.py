"""Forum posts and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmine.operators.joins import salted_filter
from lexmine import rules
from lexmine.functions.text import strip
from lexmine.sources.gate import emit, row
from lexmine.sources.responses import endpoint_rows
from lexmine.sources.results import BLOCK, HEADING, LINK, PLAIN_SNIPPET, result_blocks, titled_rows, with_elements

POSTS = "struct<data:struct<children:array<struct<data:struct<title:string,selftext:string,url:string>>>>>"
DESCRIPTION_LENGTH = 200


def question_sentences(text: Column, strict: bool = True) -> Column:
    """Questions in a text: sentences ended by ``?`` of 11 to 199 characters.

    ``strict`` asks for a question mark inside a sentence that was split at question marks, and so finds none;
    it is the default because it is what the extractor has always returned.
    """
    if strict:
        sentences = F.filter(F.split(text, r"[.!?\n]", -1), lambda s: F.contains(s, F.lit("?")))
    else:
        # Cut after each mark: one pass over the text, however long its sentences are.
        pieces = F.filter(F.split(text, r"(?<=[.!?\n])", -1), lambda s: s.endswith("?"))
        sentences = F.transform(pieces, lambda s: F.substring(s, F.lit(1), F.length(s) - 1))
    return F.filter(F.transform(sentences, strip), lambda s: F.length(s).between(11, 199))


def _posts(body: Column) -> Column:
    posts = F.transform(F.from_json(body, POSTS)["data"]["children"], lambda c: c["data"])
    return F.filter(posts, lambda p: p.isNotNull())


def reddit_rows(body: Column, strict: bool = True) -> Column:
    def rows(post: Column) -> Column:
        title, text = F.coalesce(post["title"], F.lit("")), F.coalesce(post["selftext"], F.lit(""))
        titled = row(title, "reddit_post_title", title, F.substring(text, 1, DESCRIPTION_LENGTH), post["url"])
        asked = F.transform(question_sentences(text, strict), lambda s: row(s, "reddit_question"))
        return F.concat(F.filter(F.array(titled), lambda r: r["keyword"] != ""), asked)

    return F.flatten(F.transform(_posts(body), rows))


def reddit_posts(resolved: DataFrame, strict: bool = True) -> DataFrame:
    """Post titles of the search over everything, each followed by the questions in its text."""
    return emit(endpoint_rows(resolved, "forum", "reddit"), reddit_rows(F.col("body"), strict))


def subreddit_rows(body: Column, url: Column) -> Column:
    tag = F.concat(F.lit("reddit_"), F.regexp_extract(url, r"/r/([^/]+)/", 1))
    titles = F.transform(_posts(body), lambda p: F.coalesce(p["title"], F.lit("")))
    return F.transform(F.filter(titles, lambda t: t != ""), lambda t: row(t, tag, t))


def subreddit_posts(resolved: DataFrame) -> DataFrame:
    """Post titles of each subreddit search, where the search over everything was answered."""
    found = emit(endpoint_rows(resolved, "forum", "subreddit"), subreddit_rows(F.col("body"), F.col("url")))
    return salted_filter(found, endpoint_rows(resolved, "forum", "reddit"), ["root_keyword"], "keyword")


QUORA_PARTS = [BLOCK, HEADING, PLAIN_SNIPPET, LINK]


def quora_rows(els: Column) -> Column:
    blocks = result_blocks(els, PLAIN_SNIPPET)
    return titled_rows(F.filter(blocks, lambda b: F.contains(F.lower(b["url"]), F.lit("quora.com"))), "quora_question")


def quora_questions(resolved: DataFrame) -> DataFrame:
    return emit(with_elements(endpoint_rows(resolved, "forum", "quora"), *QUORA_PARTS), quora_rows(F.col("els")))
