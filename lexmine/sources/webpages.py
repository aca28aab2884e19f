"""Competitor pages: discovery from a result page, then title, description, headings, slug and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmine import rules
from lexmine.functions import urls
from lexmine.functions.text import split_words, strip
from lexmine.operators.reports import ranked
from lexmine.sources.dom import first, is_a, select, texts, within
from lexmine.sources.gate import emit, row
from lexmine.sources.responses import endpoint_rows
from lexmine.sources.results import BLOCK, LINK, with_elements

TITLE, META, H1, H2 = is_a("title"), is_a("meta", attr="name"), is_a("h1"), is_a("h2")


def competitor_links(links: DataFrame, k: int | None = rules.COMPETITORS_PER_ROOT) -> DataFrame:
    """Pages to read for each root: outside links, the first per host, the first k hosts.

    ``links`` has root_keyword, seq and href. Hosts combine map-side and each task keeps k rows per root.
    """
    href = F.col("href")
    skipped = [F.contains(href, F.lit(name)) for name in rules.COMPETITOR_SKIP]
    outside = href.startswith("http")
    for hit in skipped:
        outside = outside & ~hit
    hosts = links.where(outside).select("root_keyword", "seq", "href", urls.host(href).alias("host"))
    per_host = hosts.where(F.col("host") != "").groupBy("root_keyword", "host").agg(
        F.min("seq").alias("seq"), F.min_by("href", "seq").alias("url")
    )
    return ranked(per_host, ["root_keyword"], [F.col("seq")], k).select("root_keyword", "rank", "host", "url")


def discovered(resolved: DataFrame) -> DataFrame:
    """Requests for the competitor pages that the discovery result page names."""
    pages = with_elements(endpoint_rows(resolved, "competitor", "discovery"), BLOCK, LINK)
    els = F.col("els")
    found = pages.select(
        "root_keyword", F.posexplode_outer(select(els, within(els, BLOCK, LINK))).alias("seq", "_link")
    ).select("root_keyword", "seq", F.col("_link")["attrs"]["href"].alias("href"))
    return competitor_links(found).select(
        "root_keyword", F.lit("competitor").alias("channel"), F.lit("page").alias("endpoint"),
        (F.col("rank") - 1).alias("query_ord"), F.col("root_keyword").alias("query"), "url",
    )


def tag_of(url: Column, suffix: str = "") -> Column:
    return F.concat(F.lit("competitor:"), urls.host(url), F.lit(suffix))


def page_title(els: Column) -> Column:
    return F.coalesce(first(els, TITLE)["text"], F.lit(""))


def page_description(els: Column) -> Column:
    """Content of the first description; a later one does not stand in for an empty first one."""
    meta = first(els, lambda e: META(e) & (e["attrs"]["name"] == "description"))
    return F.coalesce(meta["attrs"]["content"], F.lit(""))


def url_slug(url: Column) -> Column:
    return strip(F.regexp_replace(urls.path(url), r"[-_/]", " "))


def anchors(els: Column, root: Column) -> Column:
    """Links of 4 to 79 characters of text that contain a word of the root."""
    found = split_words(F.lower(root))
    return select(els, lambda e: LINK(e) & F.length(e["text"]).between(4, 79) & F.exists(
        found, lambda w: F.contains(F.lower(e["text"]), w)))


PAGE_PARTS = [TITLE, META, H1, H2, LINK]


def with_page_elements(pages: DataFrame) -> DataFrame:
    return with_elements(pages, *PAGE_PARTS)


def heading_rows(els: Column, title: Column, url: Column) -> Column:
    h1 = F.filter(texts(select(els, H1)), lambda t: t != "")
    h2 = F.filter(texts(select(els, H2)), lambda t: F.length(t).between(1, 99))
    return F.concat(
        F.transform(h1, lambda t: row(t, tag_of(url, ":h1"), title, url=url)),
        F.transform(h2, lambda t: row(t, tag_of(url, ":h2"), title, url=url)),
    )


def title_rows(title: Column, url: Column) -> Column:
    return F.filter(F.array(row(title, tag_of(url), title, url=url)), lambda r: r["keyword"] != "")


def description_rows(description: Column, url: Column) -> Column:
    made = F.array(row(description, tag_of(url), description=description, url=url))
    return F.filter(made, lambda r: r["keyword"] != "")


def slug_rows(url: Column) -> Column:
    return F.filter(F.array(row(url_slug(url), tag_of(url, ":url_slug"), url=url)), lambda r: F.length(r["keyword"]) > 3)


def anchor_rows(els: Column, root: Column, url: Column) -> Column:
    return F.transform(anchors(els, root), lambda e: row(
        e["text"], tag_of(url, ":anchor"), url=urls.join(url, e["attrs"]["href"])))


def page_record_rows(els: Column, title: Column, url: Column, root: Column) -> Column:
    return F.concat(
        title_rows(title, url), description_rows(page_description(els), url), heading_rows(els, title, url),
        slug_rows(url), anchor_rows(els, root, url),
    )


def page_records(resolved: DataFrame) -> DataFrame:
    """All six kinds of records of each competitor page."""
    pages = with_page_elements(endpoint_rows(resolved, "competitor", "page"))
    pages = pages.withColumn("page_title", page_title(F.col("els")))
    return emit(pages, page_record_rows(F.col("els"), F.col("page_title"), F.col("url"), F.col("root_keyword")))
