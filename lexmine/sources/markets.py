"""Marketplace result pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmine import rules
from lexmine.operators.joins import salted_filter
from lexmine.sources.dom import either, is_a, select, texts, within
from lexmine.sources.gate import emit, row
from lexmine.sources.responses import endpoint_rows, used_fallback
from lexmine.sources.results import with_elements
from lexmine.sources.suggest import _kind

# ---- Fixed values: where product titles sit -----------------------------------------------------

GALLERY, CARD = is_a("h2", cls="organic-gallery-title__outter"), is_a("h2", cls="search-card-e-title")
CARD_BOX, NORMAL = is_a("div", cls="search-card-e-title"), is_a("a", cls="elements-title-normal__outter")
SCRIPT = is_a("script", attr="type")

PRODUCT_H2, PRODUCT_BOX = is_a("h2", cls="product-name"), is_a("div", cls="product-title")
PRODUCT_SPAN, PRODUCT_LINK = is_a("span", cls="product-name"), is_a("a", cls="title")
RELATED_BOX = either(is_a("div", cls="related-search"), is_a("div", cls="hot-search"))
CATEGORY_BOX = either(is_a("ul", cls="category-list"), is_a("div", cls="filter-item"))


ALIBABA_PARTS = [GALLERY, CARD, CARD_BOX, NORMAL, SCRIPT, is_a("span")]
MADEINCHINA_PARTS = [PRODUCT_H2, PRODUCT_BOX, PRODUCT_SPAN, PRODUCT_LINK, RELATED_BOX, CATEGORY_BOX, is_a("a")]


def longer(found: Column, n: int) -> Column:
    return F.filter(texts(found), lambda t: F.length(t) > n)


def script_names(els: Column) -> Column:
    """``name`` of the object, or of each object of the list, in every JSON script; a bad script is skipped."""
    scripts = select(els, lambda e: SCRIPT(e) & (e["attrs"]["type"] == "application/json"))

    # Each step is a transform of its own, so that what it names is computed once: a payload is parsed once.
    parsed = F.transform(scripts, lambda e: F.try_parse_json(e["text"]))

    def objects(data: Column) -> Column:
        items = F.when(_kind(data).startswith("ARRAY"), F.try_variant_get(data, "$", "array<variant>"))
        return F.coalesce(items, F.array(data))

    def read(x: Column) -> Column:
        # Something that is not an object, or a name that is not text, ends its script.
        bad = ~_kind(x).startswith("OBJECT") | (~_kind(F.try_variant_get(x, "$.name", "variant")).isin("STRING", "VOID"))
        return F.struct(bad.alias("bad"), F.try_variant_get(x, "$.name", "string").alias("name"))

    def names(items: Column) -> Column:
        bad = F.array_position(items["bad"], True)
        return F.when(bad > 0, F.slice(items["name"], F.lit(1), (bad - 1).cast("int"))).otherwise(items["name"])

    listed = F.transform(parsed, objects)
    named = F.transform(F.transform(listed, lambda items: F.transform(items, read)), names)
    return F.filter(F.flatten(named), lambda t: t.isNotNull() & (t != ""))


def alibaba_title_rows(els: Column) -> Column:
    """Product titles, one pass per place: an element found in two places counts twice. Then script names."""
    places = [GALLERY, CARD, within(els, CARD_BOX, is_a("span")), NORMAL]
    found = F.concat(*[longer(select(els, place), 5) for place in places])
    return F.concat(
        F.transform(found, lambda t: row(t, "alibaba_product_title", url=rules.ALIBABA_SEARCH_URL)),
        F.transform(script_names(els), lambda t: row(t, "alibaba_jsonld")),
    )


def alibaba_titles(resolved: DataFrame) -> DataFrame:
    return emit(with_elements(endpoint_rows(resolved, "alibaba", "search"), *ALIBABA_PARTS), alibaba_title_rows(F.col("els")))


def alibaba_fallback_rows(els: Column) -> Column:
    found = F.filter(texts(select(els, either(GALLERY, CARD))), lambda t: t != "")
    return F.transform(found, lambda t: row(t, "alibaba_title_html"))


def alibaba_fallback_titles(resolved: DataFrame) -> DataFrame:
    """Titles of the products page, where the suggestion payload did not parse."""
    pages = with_elements(endpoint_rows(resolved, "alibaba", "products"), GALLERY, CARD)
    records = emit(pages, alibaba_fallback_rows(F.col("els")))
    return used_fallback(records, resolved, "alibaba", "suggest", when_missing=False)


def madeinchina_rows(els: Column, url: Column | None) -> Column:
    """Titles of a page; with its url, that is of the first page, the related and category links too."""
    link = is_a("a")
    places = [PRODUCT_H2, within(els, PRODUCT_BOX, link), PRODUCT_SPAN, PRODUCT_LINK]
    found = F.concat(*[longer(select(els, place), 5) for place in places])
    titles = F.transform(found, lambda t: row(t, "madeinchina_product_title", url=url))
    if url is None:
        return titles
    related = F.filter(texts(select(els, within(els, RELATED_BOX, link))), lambda t: t != "")
    category = longer(select(els, within(els, CATEGORY_BOX, link)), 3)
    return F.concat(
        titles, F.transform(related, lambda t: row(t, "madeinchina_related")),
        F.transform(category, lambda t: row(t, "madeinchina_category")),
    )


def madeinchina_titles(resolved: DataFrame) -> DataFrame:
    """Titles of both pages, and related and category links of the first. The second counts only with the first."""
    els = F.col("els")
    page1, page2 = (endpoint_rows(resolved, "madeinchina", e) for e in ("search", "search_page2"))
    second = emit(with_elements(page2, *MADEINCHINA_PARTS), madeinchina_rows(els, None))
    return emit(with_elements(page1, *MADEINCHINA_PARTS), madeinchina_rows(els, F.col("url"))).unionByName(
        salted_filter(second, page1, ["root_keyword"], "keyword"))
