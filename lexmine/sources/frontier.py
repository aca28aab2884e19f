"""Which requests a list of roots needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmine import rules
from lexmine.operators.joins import salted_filter
from lexmine.sources.responses import fallback_roots
from lexmine.functions.text import quote_plus, strip

REQUEST = ["channel", "endpoint", "query_ord", "query", "url"]


def roots_normalize(lines: DataFrame, line: str, *order: str) -> DataFrame:
    """Roots from free text lines: split on commas, strip, lower, first occurrence of each.

    ``order`` are the columns that order the lines; the result keeps them with the position inside the line.
    """
    parts = lines.select(*order, F.posexplode(F.split(line, ",", -1)).alias("position", "part"))
    named = parts.select(*order, "position", F.lower(strip(F.col("part"))).alias("root_keyword"))
    first = named.where(F.col("root_keyword") != "").groupBy("root_keyword").agg(
        F.min(F.struct(*order, "position")).alias("_first")
    )
    return first.select("root_keyword", "_first.*")


def _request(channel: str, endpoint: str, number: int, query: Column, url: Column | str) -> Column:
    return F.struct(
        F.lit(channel).alias("channel"), F.lit(endpoint).alias("endpoint"), F.lit(number).alias("query_ord"),
        query.alias("query"), (F.lit(url) if isinstance(url, str) else url).alias("url"),
    )


def _expand(roots: DataFrame, requests: list[Column]) -> DataFrame:
    """A fixed list of requests per root is an array, so no join is needed."""
    return roots.select("root_keyword", F.inline(F.array(*requests)))


def expand_root(roots: DataFrame) -> DataFrame:
    root = F.col("root_keyword")
    return _expand(roots, [
        _request("google", "suggest", 0, root, rules.GOOGLE_SUGGEST_URL),
        _request("bing", "suggest", 0, root, rules.BING_SUGGEST_URL),
        _request("youtube", "suggest", 0, root, rules.GOOGLE_SUGGEST_URL),
        _request("amazon", "suggest", 0, root, rules.AMAZON_SUGGEST_URL),
        _request("alibaba", "suggest", 0, root, rules.ALIBABA_SUGGEST_URL),
        _request("google_trends", "trends", 0, F.substring(root, 1, rules.TRENDS_ROOT_LENGTH), ""),
    ])


def fallback_requests(roots: DataFrame, resolved: DataFrame) -> DataFrame:
    """Requests to the legacy suggestions of Amazon, for roots whose answer is missing or did not parse."""
    answered, present = fallback_roots(resolved, "amazon", "suggest", when_missing=True)
    unanswered = salted_filter(roots.select("root_keyword"), answered, ["root_keyword"], "root_keyword", present)
    return _expand(unanswered, [_request("amazon", "suggest_legacy", 0, F.col("root_keyword"), rules.AMAZON_LEGACY_URL)])


def expand_alphabet(roots: DataFrame) -> DataFrame:
    letters = F.array(*[F.lit(c) for c in rules.ALPHABET])
    return roots.select("root_keyword", F.posexplode(letters).alias("query_ord", "_letter")).select(
        "root_keyword", F.lit("google").alias("channel"), F.lit("suggest_alpha").alias("endpoint"), "query_ord",
        F.concat_ws(" ", "root_keyword", "_letter").alias("query"), F.lit(rules.GOOGLE_SUGGEST_URL).alias("url"),
    )


def expand_modifiers(roots: DataFrame) -> DataFrame:
    endpoint = {"google": "suggest_modifier"}
    url = {
        "google": rules.GOOGLE_SUGGEST_URL, "bing": rules.BING_SUGGEST_URL, "youtube": rules.GOOGLE_SUGGEST_URL,
        "amazon": rules.AMAZON_SUGGEST_URL,
    }
    fixed = F.array(*[
        F.struct(
            F.lit(channel).alias("channel"), F.lit(endpoint.get(channel, "suggest_ext")).alias("endpoint"),
            F.lit(i).alias("query_ord"), F.lit(modifier).alias("_modifier"), F.lit(url[channel]).alias("url"),
        )
        for channel, modifiers in rules.MODIFIERS.items() for i, modifier in enumerate(modifiers)
    ])
    opened = roots.select("root_keyword", F.inline(fixed))
    return opened.select(
        "root_keyword", "channel", "endpoint", "query_ord",
        F.concat_ws(" ", "root_keyword", "_modifier").alias("query"), "url",
    )


def expand_pages(roots: DataFrame) -> DataFrame:
    """Result pages, forum searches and competitor discovery."""
    root = F.col("root_keyword")
    china = F.concat(
        F.lit(rules.MADEINCHINA_URL), quote_plus(F.replace(root, F.lit(" "), F.lit("-"))), F.lit("/F1/")
    )
    products = F.concat(F.lit(rules.ALIBABA_PRODUCTS_URL), quote_plus(root), F.lit(".html"))
    quora = F.concat(F.lit("site:quora.com "), root)
    discovery = F.concat(root, F.lit(" manufacturer supplier"))
    return _expand(roots, [
        _request("google", "serp", 0, root, rules.GOOGLE_SEARCH_URL),
        _request("bing", "serp", 0, root, rules.BING_SEARCH_URL),
        _request("youtube", "serp", 0, root, rules.YOUTUBE_SEARCH_URL),
        _request("alibaba", "products", 0, root, products),
        _request("alibaba", "search", 0, root, rules.ALIBABA_SEARCH_URL),
        _request("madeinchina", "search", 0, root, china),
        _request("madeinchina", "search_page2", 0, root, F.concat(china, F.lit("?pageNum=2"))),
        _request("forum", "reddit", 0, root, f"{rules.REDDIT_URL}search.json"),
        *[
            _request("forum", "subreddit", i, root, f"{rules.REDDIT_URL}r/{sub}/search.json")
            for i, sub in enumerate(rules.SUBREDDITS)
        ],
        _request("forum", "quora", 0, quora, rules.GOOGLE_SEARCH_URL),
        _request("competitor", "discovery", 0, discovery, rules.GOOGLE_SEARCH_URL),
    ])


def expand_domains(roots: DataFrame, domains: list[str]) -> DataFrame:
    """Home page and product search of each configured competitor; used instead of discovery."""
    if not domains:
        return roots.limit(0).select("root_keyword", *[F.lit(None).cast("string").alias(c) for c in REQUEST])
    root = F.col("root_keyword")
    search = F.replace(root, F.lit(" "), F.lit("+"))
    requests = []
    for i, domain in enumerate(domains):
        home = f"https://{domain}"
        requests += [
            _request("competitor", "page", 2 * i, root, home),
            _request("competitor", "page", 2 * i + 1, root, F.concat(F.lit(f"{home}/search?q="), search)),
        ]
    return _expand(roots, requests)


def channel_filter(requests: DataFrame, switches: dict[str, bool] | None = None, strict: bool = False) -> DataFrame:
    """Drop the channels that are switched off. Only the nine channel switches count and unknown ones are on;
    ``strict`` also honours the switch for Quora."""
    state = {**rules.DEFAULT_SWITCHES, **(switches or {})}
    off = [channel for channel, switch in rules.CHANNEL_SWITCH.items() if not state.get(switch, True)]
    kept = requests.where(~F.col("channel").isin(off)) if off else requests
    if strict and not state.get("quora", True):
        kept = kept.where(~((F.col("channel") == "forum") & (F.col("endpoint") == "quora")))
    return kept


def pending(requests: DataFrame, landed: DataFrame) -> DataFrame:
    """Requests of roots that have no landed record yet. The done list is one narrow column."""
    return requests.join(landed.select("root_keyword").distinct(), "root_keyword", "left_anti")


def numbered(requests: DataFrame) -> DataFrame:
    """Add request_id and ``seq``, the order of the answer inside its root: channel, endpoint, query."""
    order = F.lit(None).cast("bigint")
    for i, channel in enumerate(rules.CHANNELS):
        for j, endpoint in enumerate(rules.ENDPOINTS[channel]):
            here = (F.col("channel") == channel) & (F.col("endpoint") == endpoint)
            order = F.when(here, F.lit((i << 24) | (j << 16)).cast("bigint")).otherwise(order)
    return requests.select(
        F.concat_ws("/", "channel", "endpoint", F.col("query_ord").cast("string"), "root_keyword").alias("request_id"),
        "root_keyword", *REQUEST, (order + F.col("query_ord")).alias("seq"),
    )


def params(requests: DataFrame) -> DataFrame:
    """Add ``params``, the parameters of each request by name in their order, and ``request_url`` with them in it."""
    def of(values: dict[str, str]) -> Column:
        pairs = [(F.lit(k), F.col("query") if v == rules.QUERY else F.lit(v)) for k, v in values.items()]
        return F.array(*[F.struct(k.alias("name"), v.alias("value")) for k, v in pairs])

    name = F.concat_ws("/", "channel", "endpoint")
    found = F.lit(None).cast("array<struct<name:string,value:string>>")
    for key, values in rules.PARAMS.items():
        found = F.when(name == key, of(values)).otherwise(found)
    listed = F.transform("_params", lambda p: F.concat(p["name"], F.lit("="), quote_plus(p["value"])))
    with_pairs = requests.withColumn("_params", found)
    made = F.when(F.col("_params").isNull(), F.col("url")).otherwise(F.concat("url", F.lit("?"), F.array_join(listed, "&")))
    return with_pairs.select(*requests.columns, F.map_from_entries("_params").alias("params"), made.alias("request_url"))


def frontier(roots: DataFrame, domains: list[str] | None = None, switches: dict[str, bool] | None = None) -> DataFrame:
    """All requests of all roots."""
    pages = expand_pages(roots)
    if domains:
        pages = pages.where(F.col("endpoint") != "discovery")
    parts = [expand_root(roots), expand_alphabet(roots), expand_modifiers(roots), pages]
    if domains:
        parts.append(expand_domains(roots, domains))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return numbered(channel_filter(every, switches))
