"""Captured responses of every channel -> one table of keyword records, in one pass that also tells what it rejected."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from lexmine.operators.joins import salted_filter
from lexmine.session import cut_lineage
from lexmine.sources import forums, markets, results, suggest, webpages
from lexmine.sources.dom import elements_by
from lexmine.sources.gate import ROWS_PER_RESPONSE, record_gate
from lexmine.sources.responses import is_json, is_json_object, resolve
from lexmine.sources.trends import trend_records

ROOT = "root_keyword"


def _body() -> Column:
    return F.col("body")


def _els() -> Column:
    return F.col("els")


def _jsonp(body: Column) -> Column:
    return is_json(F.regexp_extract(body, r"(?s)\[.*\]", 0))


def _video(body: Column) -> Column:
    """A page without video data is no fault, one whose data cannot be read is."""
    data = F.regexp_extract(body, results.VIDEO_DATA, 1)
    return body.isNotNull() & ((data == "") | is_json(data))


@dataclass(frozen=True)
class Route:
    """How answers of some endpoints are read: their rows, the page parts they need or the test of their payload.

    ``gate`` names the answer of the same root that decides on the rows, ``shut`` that it keeps them out.
    """

    channel: str
    endpoints: tuple[str, ...]
    rows: Callable[[], Column]
    parts: list = field(default_factory=list)
    readable: Callable[[Column], Column] | None = None
    gate: str | None = None
    shut: bool = False

    @property
    def keys(self) -> list[str]:
        return [f"{self.channel}/{e}" for e in self.endpoints]


def _tagged(texts: Callable[[Column], Column], tag: str | Column, with_url: bool = False) -> Callable[[], Column]:
    return lambda: suggest._rows(texts(_body()), F.concat(F.lit(f"{tag}_"), "endpoint") if tag in ("google", "bing", "youtube") else tag, with_url)


ROUTES = [
    Route("google", ("suggest",), _tagged(suggest.array_texts, "google", True), readable=is_json),
    Route("google", ("suggest_alpha", "suggest_modifier"), _tagged(suggest.array_texts, "google"), readable=is_json),
    Route("google", ("serp",), lambda: results.google_result_rows(_els(), F.col(ROOT)), results.GOOGLE_PARTS),
    Route("bing", ("suggest", "suggest_ext"), _tagged(suggest.array_texts, "bing"), readable=is_json),
    Route("bing", ("serp",), lambda: results.bing_result_rows(_els()), results.BING_PARTS),
    Route("youtube", ("suggest", "suggest_ext"), _tagged(suggest.jsonp_texts, "youtube"), readable=_jsonp),
    Route("youtube", ("serp",), lambda: results.youtube_result_rows(_body()), readable=_video),
    Route("amazon", ("suggest",), _tagged(suggest.object_texts, "amazon_suggest"), readable=is_json_object),
    Route("amazon", ("suggest_ext",), _tagged(suggest.object_texts, "amazon_suggest_ext"), readable=is_json_object),
    Route("amazon", ("suggest_legacy",), _tagged(suggest.array_texts, "amazon_suggest"), readable=is_json, gate="amazon/suggest", shut=True),
    Route("alibaba", ("suggest",), _tagged(suggest.nested_texts, "alibaba_suggest"), readable=is_json_object),
    Route("alibaba", ("search",), lambda: markets.alibaba_title_rows(_els()), markets.ALIBABA_PARTS),
    Route("alibaba", ("products",), lambda: markets.alibaba_fallback_rows(_els()), [markets.GALLERY, markets.CARD], gate="alibaba/suggest"),
    Route("madeinchina", ("search",), lambda: markets.madeinchina_rows(_els(), F.col("url")), markets.MADEINCHINA_PARTS),
    Route("madeinchina", ("search_page2",), lambda: markets.madeinchina_rows(_els(), None), markets.MADEINCHINA_PARTS, gate="madeinchina/search"),
    Route("forum", ("reddit",), lambda: forums.reddit_rows(_body()), readable=is_json),
    Route("forum", ("subreddit",), lambda: forums.subreddit_rows(_body(), F.col("url")), readable=is_json, gate="forum/reddit"),
    Route("forum", ("quora",), lambda: forums.quora_rows(_els()), forums.QUORA_PARTS),
    Route("competitor", ("page",), lambda: webpages.page_record_rows(_els(), webpages.page_title(_els()), F.col("url"), F.col(ROOT)), webpages.PAGE_PARTS),
]
# Answers without rows of their own: a discovery page names requests (lexmine.plans.crawl).
SILENT = ["competitor/discovery"]
# Which answers open or shut a gate: all of them, only readable, or only unreadable ones.
GATES = {"amazon/suggest": True, "alibaba/suggest": False, "madeinchina/search": None, "forum/reddit": None}

RECORD, REJECTED, ANSWER = "record", "rejected", "answer"
FIELDS = ["keyword", "source", "title", "description", "url"]


def _case(route: Column, choices: list[tuple[list[str], Column]], otherwise: Column) -> Column:
    chosen = reduce(lambda case, c: case.when(route.isin(*c[0]), c[1]), choices[1:], F.when(route.isin(*choices[0][0]), choices[0][1]))
    return chosen.otherwise(otherwise)


def route(responses: DataFrame) -> DataFrame:
    """Every response read once: its records, a row for a payload that was rejected, and what decides on other answers.

    Columns: kind, request_id, root_keyword, channel, endpoint, seq, keyword, source, title, description, url,
    collected_at, reason (``json``, ``html`` or ``unrouted``, for rejected ones). ``responses`` are resolved ones.
    """
    at = F.col("collected_at") if "collected_at" in responses.columns else F.localtimestamp()
    name = F.col("route")
    pages = {key: [w for test in r.parts for w in test.wanted] for r in ROUTES for key in r.keys if r.parts}
    read = responses.withColumn("collected_at", at).withColumn("route", F.concat_ws("/", "channel", "endpoint"))
    read = read.withColumn("els", elements_by(name, _body(), pages))
    # The outer generator and single use of the body keep the optimizer from parsing a body twice.
    json = _case(name, [(r.keys, r.readable(_body())) for r in ROUTES if r.readable], F.lit(True))
    html = ~name.isin(*pages) | _els().isNotNull()
    known = name.isin(*[k for r in ROUTES for k in r.keys], *SILENT)
    reason = F.when(~known, "unrouted").when(~html, "html").when(~F.coalesce(json, F.lit(False)), "json")
    nothing = F.array().cast("array<struct<keyword:string,source:string,title:string,description:string,url:string>>")
    rows = F.coalesce(_case(name, [(r.keys, r.rows()) for r in ROUTES], nothing), nothing)

    def tagged(kind: str, when: Column, why: Column) -> Column:
        made = F.struct(F.lit(kind).alias("kind"), *[F.lit("").alias(f) for f in FIELDS], why.alias("reason"))
        return F.filter(F.array(made), lambda _: when)

    records = F.transform(rows, lambda r: F.struct(F.lit(RECORD).alias("kind"), *[r[f].alias(f) for f in FIELDS], F.lit(None).cast("string").alias("reason")))
    opens = F.coalesce(_case(name, [([key], F.lit(True) if good is None else F.col("reason").isNull() == good) for key, good in GATES.items()], F.lit(False)), F.lit(False))
    judged = read.withColumn("reason", reason)
    every = F.concat(records, tagged(REJECTED, F.col("reason").isNotNull(), F.col("reason")), tagged(ANSWER, opens, F.lit(None).cast("string")))
    opened = judged.select(
        "request_id", ROOT, "channel", "endpoint", F.col("seq").alias("_seq"), "collected_at", F.posexplode_outer(every).alias("_pos", "_row"))
    return opened.where(F.col("_row").isNotNull()).select(
        "request_id", ROOT, "channel", "endpoint", "collected_at", (F.col("_seq") * F.lit(ROWS_PER_RESPONSE) + F.col("_pos")).alias("seq"), "_row.*")


def kept(routed: DataFrame) -> DataFrame:
    """Records whose gate is open: fallbacks only where the primary answer asks for them, later pages only with the first."""
    shown = routed.where(F.col("kind") == RECORD)
    name = F.concat_ws("/", "channel", "endpoint")
    gates = {key: r for r in ROUTES if r.gate for key in r.keys}
    plain = shown.where(~name.isin(*gates))
    answers = routed.where(F.col("kind") == ANSWER).select(ROOT, F.concat_ws("/", "channel", "endpoint").alias("_gate")).distinct()
    for shut in (True, False):
        mine = {key: r.gate for key, r in gates.items() if r.shut == shut}
        gate = F.element_at(F.create_map(*[F.lit(x) for pair in mine.items() for x in pair]), name)
        some = shown.where(name.isin(*mine)).withColumn("_gate", gate)
        found = salted_filter(some, answers, [ROOT, "_gate"], "keyword", present=not shut)
        plain = plain.unionByName(found.select(*plain.columns))
    return plain


@dataclass(frozen=True)
class Extraction:
    """What one pass over captured responses gave. All of it reads the one narrow table that the pass wrote."""

    routed: DataFrame
    counts: dict

    @property
    def records(self) -> DataFrame:
        return record_gate(kept(self.routed))

    @property
    def rejected(self) -> DataFrame:
        """request_id, root_keyword, channel, endpoint, seq, reason of every payload that could not be read."""
        return self.routed.where(F.col("kind") == REJECTED).select("request_id", ROOT, "channel", "endpoint", "seq", "reason")


def extract(responses: DataFrame) -> Extraction:
    """Resolve attempts, read every response once and write what was found; ``counts`` has records and rejected."""
    seen = Observation()
    kind = F.col("kind")
    routed = route(resolve(responses)).observe(
        seen, F.count_if(kind == RECORD).alias("records"), F.count_if(kind == REJECTED).alias("rejected"))
    written = cut_lineage(routed)
    return Extraction(written, seen.get)


def extract_all(responses: DataFrame, trends: DataFrame | None = None) -> DataFrame:
    """Records of all channels, from one pass over the responses."""
    records = extract(responses).records
    return records if trends is None else records.unionByName(trend_records(trends))
