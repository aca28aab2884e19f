"""Search result pages: related searches, questions, organic results, embedded video data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmine.functions.text import split_words
from lexmine.sources.dom import either, elements, first, is_a, select, text_or_empty, texts, within
from lexmine.sources.gate import emit, row
from lexmine.sources.responses import endpoint_rows

# ---- Fixed values: where the parts of a result page sit -----------------------------------------

RELATED = [
    is_a("div", cls="s75CSd"), is_a("div", attr="data-initq"), is_a("a", cls="k8XOCe"), is_a("div", cls="B9g0yd"),
]
QUESTIONS = [is_a("div", cls="related-question-pair"), is_a("div", attr="data-q"), is_a("span", cls="CSkcDe")]
BLOCK = either(is_a("div", cls="tF2Cxc"), is_a("div", cls="g"))
HEADING = is_a("h3")
SNIPPET = either(is_a("div", cls="VwiC3b"), is_a("span", cls="aCOpRe"))
PLAIN_SNIPPET = is_a("div", cls="VwiC3b")
LINK = is_a("a", attr="href")
SPAN = is_a("span")

GOOGLE_PARTS = [*RELATED, *QUESTIONS, BLOCK, HEADING, SNIPPET, LINK, SPAN]

BING_BLOCK, BING_RELATED = is_a("li", cls="b_algo"), either(is_a("li", cls="b_rs"), is_a("div", cls="b_rs"))

BING_PARTS = [BING_BLOCK, BING_RELATED, is_a("h2"), is_a("div", cls="b_caption"), is_a("p"), is_a("a")]

VIDEO_DATA = r"(?s)var ytInitialData = (\{.*?\});</script>"
VIDEO_SCHEMA = """struct<contents:struct<twoColumnSearchResultsRenderer:struct<primaryContents:struct<
  sectionListRenderer:struct<contents:array<struct<itemSectionRenderer:struct<contents:array<struct<
  videoRenderer:struct<videoId:string,title:struct<runs:array<struct<text:string>>>>>>>>>>>>>>"""


def with_elements(responses: DataFrame, *tests) -> DataFrame:
    """Add the wanted elements of each body as ``els``."""
    wanted = [w for test in tests for w in test.wanted]
    return responses.withColumn("els", elements(F.col("body"), wanted))


def related_texts(els: Column) -> Column:
    """Related searches: marked elements first, then links back to the search; each text once."""
    marked = [F.filter(texts(select(els, test)), lambda t: F.length(t) > 3) for test in RELATED]
    links = select(els, lambda e: is_a("a", attr="href")(e) & e["attrs"]["href"].rlike(r"/search\?q="))
    linked = F.filter(texts(links), lambda t: F.length(t).between(5, 99))
    return F.array_distinct(F.concat(*marked, linked))


def question_texts(els: Column, root: Column) -> Column:
    """People also ask: marked elements with a question mark, then question-like spans about the root."""
    word = F.lower(F.get(split_words(root), F.lit(0)))
    marked = [F.filter(texts(select(els, test)), lambda t: F.contains(t, F.lit("?"))) for test in QUESTIONS]
    spans = F.filter(
        texts(select(els, SPAN)),
        lambda t: t.endswith("?") & F.length(t).between(11, 199) & F.contains(F.lower(t), word),
    )
    return F.array_distinct(F.concat(*marked, spans))


def result_blocks(els: Column, snippet=SNIPPET) -> Column:
    """Title, description and url of every block; parts are the first of their kind inside the block."""
    return F.transform(select(els, BLOCK), lambda b: F.struct(
        text_or_empty(first(els, HEADING, b)).alias("title"),
        text_or_empty(first(els, snippet, b)).alias("description"),
        F.coalesce(first(els, LINK, b)["attrs"]["href"], F.lit("")).alias("url"),
    ))


def titled_rows(blocks: Column, source: str) -> Column:
    found = F.filter(blocks, lambda b: b["title"] != "")
    return F.transform(found, lambda b: row(b["title"], source, b["title"], b["description"], b["url"]))


def google_result_rows(els: Column, root: Column) -> Column:
    return F.concat(
        F.transform(related_texts(els), lambda t: row(t, "google_related_search")),
        F.transform(question_texts(els, root), lambda t: row(t, "google_paa")),
        titled_rows(result_blocks(els), "google_serp_title"),
    )


def google_results(resolved: DataFrame) -> DataFrame:
    pages = with_elements(endpoint_rows(resolved, "google", "serp"), *GOOGLE_PARTS)
    return emit(pages, google_result_rows(F.col("els"), F.col("root_keyword")))


def bing_result_rows(els: Column) -> Column:
    h2, caption = is_a("h2"), is_a("div", cls="b_caption")
    title, snippet = within(els, h2, is_a("a")), within(els, caption, is_a("p"))
    blocks = F.transform(select(els, BING_BLOCK), lambda b: F.struct(
        text_or_empty(first(els, title, b)).alias("title"),
        text_or_empty(first(els, snippet, b)).alias("description"),
        F.coalesce(first(els, title, b)["attrs"]["href"], F.lit("")).alias("url"),
    ))
    related = F.filter(texts(select(els, within(els, BING_RELATED, is_a("a")))), lambda t: t != "")
    return F.concat(titled_rows(blocks, "bing_serp_title"), F.transform(related, lambda t: row(t, "bing_related")))


def bing_results(resolved: DataFrame) -> DataFrame:
    return emit(with_elements(endpoint_rows(resolved, "bing", "serp"), *BING_PARTS), bing_result_rows(F.col("els")))


def youtube_result_rows(body: Column) -> Column:
    """Videos in the page's embedded data; a missing level gives no row."""
    data = F.from_json(F.regexp_extract(body, VIDEO_DATA, 1), VIDEO_SCHEMA)
    sections = data["contents"]["twoColumnSearchResultsRenderer"]["primaryContents"]["sectionListRenderer"]["contents"]
    none = F.array().cast("array<string>")

    def video(item: Column) -> Column:
        runs = F.transform(item["videoRenderer"]["title"]["runs"], lambda r: F.coalesce(r["text"], F.lit("")))
        title = F.array_join(F.coalesce(runs, none), "")
        watch = F.concat(
            F.lit("https://www.youtube.com/watch?v="), F.coalesce(item["videoRenderer"]["videoId"], F.lit(""))
        )
        return row(title, "youtube_serp", title, url=watch)

    listed = F.filter(F.transform(sections, lambda s: s["itemSectionRenderer"]["contents"]), lambda c: c.isNotNull())
    return F.filter(F.transform(F.flatten(listed), video), lambda r: r["keyword"] != "")


def youtube_results(resolved: DataFrame) -> DataFrame:
    return emit(endpoint_rows(resolved, "youtube", "serp"), youtube_result_rows(F.col("body")))
