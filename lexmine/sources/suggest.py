"""Suggestion payloads: four JSON shapes, read as VARIANT. A malformed body yields no row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lexmine import rules
from lexmine.functions.text import quote_plus
from lexmine.sources.gate import emit, row
from lexmine.sources.responses import endpoint_rows, is_json_object, used_fallback


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _texts(items: Column, pick: Callable[[Column], Column], bad: Callable[[Column], Column]) -> Column:
    """Picked strings up to the first bad item; items without a string are skipped."""
    def text(item: Column) -> Column:
        value = pick(item)
        return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))

    stop = F.array_position(F.transform(items, bad), True)
    good = F.when(stop > 0, F.slice(items, F.lit(1), (stop - 1).cast("int"))).otherwise(items)
    return F.filter(F.transform(good, text), lambda t: t.isNotNull() & (t != ""))


def _items(json: Column, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(json), path, "array<variant>")


def array_texts(body: Column) -> Column:
    """``["query", ["a", "b"]]``"""
    return _texts(_items(body, "$[1]"), lambda x: x, lambda x: _kind(x) != "STRING")


def jsonp_texts(body: Column) -> Column:
    """``callback(["query", ["a", ["b", 0]]])``: an item is a string or a list with the string first."""
    inner = F.regexp_extract(body, r"(?s)\[.*\]", 0)

    def pick(item: Column) -> Column:
        head = F.try_variant_get(item, "$[0]", "variant")
        return F.when(_kind(item).startswith("ARRAY"), head).otherwise(item)

    def empty_list(item: Column) -> Column:
        return _kind(item).startswith("ARRAY") & F.try_variant_get(item, "$[0]", "variant").isNull()

    return _texts(_items(inner, "$[1]"), pick, empty_list)


def _field_texts(items: Column, field: str) -> Column:
    def pick(item: Column) -> Column:
        return F.try_variant_get(item, f"$.{field}", "variant")

    def bad(item: Column) -> Column:
        return ~_kind(item).startswith("OBJECT") | ~_kind(pick(item)).isin("STRING", "VOID")

    return _texts(items, pick, bad)


def object_texts(body: Column) -> Column:
    """``{"suggestions": [{"value": "a"}]}``"""
    return _field_texts(_items(body, "$.suggestions"), "value")


def nested_texts(body: Column) -> Column:
    """``{"result": {"list": [{"keyword": "a"}]}}``"""
    return _field_texts(_items(body, "$.result.list"), "keyword")


def _rows(texts: Column, source: Column | str, with_url: bool = False) -> Column:
    search = F.lit(f"{rules.GOOGLE_SEARCH_URL}?q=")
    return F.transform(texts, lambda t: row(t, source, url=F.concat(search, quote_plus(t)) if with_url else None))


def google_suggestions(resolved: DataFrame) -> DataFrame:
    plain = endpoint_rows(resolved, "google", "suggest")
    more = endpoint_rows(resolved, "google", "suggest_alpha", "suggest_modifier")
    texts = array_texts(F.col("body"))
    tag = F.concat(F.lit("google_"), F.col("endpoint"))
    return emit(plain, _rows(texts, "google_suggest", with_url=True)).unionByName(emit(more, _rows(texts, tag)))


def bing_suggestions(resolved: DataFrame) -> DataFrame:
    found = endpoint_rows(resolved, "bing", "suggest", "suggest_ext")
    return emit(found, _rows(array_texts(F.col("body")), F.concat(F.lit("bing_"), F.col("endpoint"))))


def youtube_suggestions(resolved: DataFrame) -> DataFrame:
    found = endpoint_rows(resolved, "youtube", "suggest", "suggest_ext")
    return emit(found, _rows(jsonp_texts(F.col("body")), F.concat(F.lit("youtube_"), F.col("endpoint"))))


def amazon_suggestions(resolved: DataFrame) -> DataFrame:
    """The legacy endpoint stands in where the primary did not answer or did not parse."""
    body = F.col("body")
    main = emit(endpoint_rows(resolved, "amazon", "suggest").where(is_json_object(body)), _rows(object_texts(body), "amazon_suggest"))
    spare = emit(endpoint_rows(resolved, "amazon", "suggest_legacy"), _rows(array_texts(body), "amazon_suggest"))
    more = emit(endpoint_rows(resolved, "amazon", "suggest_ext"), _rows(object_texts(body), "amazon_suggest_ext"))
    used = used_fallback(spare, resolved, "amazon", "suggest", when_missing=True)
    return main.unionByName(used).unionByName(more)


def alibaba_suggestions(resolved: DataFrame) -> DataFrame:
    found = endpoint_rows(resolved, "alibaba", "suggest")
    return emit(found, _rows(nested_texts(F.col("body")), "alibaba_suggest"))
