"""Queries over captured payloads. Spark builds the payloads from the given tables; the SQL states what is in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmine.sources import forums, markets, results, suggest, webpages
from lexmine.sources.dom import elements, is_a, select
from lexmine.sources.trends import trend_records
from workload import sql_base as s
from workload.captures import spread, table
from workload.registry import query
from workload.templates import COLLECTED_AT

OUT = ["root_keyword", "seq", "keyword", "source", "channel", "title", "description", "url"]
SHIFT = 67108864  # positions inside one response


def esc(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def captured(df: DataFrame, channel: str, endpoint: Column | str, root: Column, seq: Column, body: Column, url=None) -> DataFrame:
    name = F.lit(endpoint) if isinstance(endpoint, str) else endpoint
    return df.select(
        seq.cast("string").alias("request_id"), root.alias("root_keyword"), F.lit(channel).alias("channel"),
        name.alias("endpoint"), (F.lit("") if url is None else url).alias("url"), seq.cast("bigint").alias("seq"),
        body.alias("body"), F.lit(COLLECTED_AT).cast("timestamp_ntz").alias("collected_at"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def rows_sql(source: str, root: str, seq: str, rows: list[tuple], where: str = "") -> str:
    """Expected records: ``rows`` lists (condition, position, keyword, source, channel, title, description, url)."""
    structs = ", ".join(
        "{'ok': %s, 'pos': %s, 'keyword': %s, 'source': %s, 'channel': %s, 'title': %s, 'description': %s, 'url': %s}"
        % tuple(x if isinstance(x, str) else str(x) for x in r) for r in rows
    )
    return f"""
SELECT root_keyword, seq * {SHIFT} + r.pos AS seq, lower({s.strip('r.keyword')}) AS keyword, r.source AS source,
       r.channel AS channel, r.title AS title, r.description AS description, r.url AS url
FROM (SELECT {root} AS root_keyword, CAST({seq} AS BIGINT) AS seq, unnest([{structs}]) AS r FROM {source} {where})
WHERE r.ok AND length({s.strip('r.keyword')}) >= 2"""


def _q(text: str) -> str:
    return f"replace(replace(replace(url_encode({text}), '%20', '+'), '*', '%2A'), '%7E', '~')"


def _suggest_sql() -> str:
    search = "'https://www.google.com/search?q=' || "
    one, two = "p_name || ' ' || p_type", "'  ' || p_brand || ' ' || p_name || '*~ '"
    rows = []
    for kind, channel, tag, with_url in [
        ("ECONOMY", "google", "google_suggest", True), ("LARGE", "google", "google_suggest_alpha", False),
        ("MEDIUM", "google", "google_suggest_modifier", False), ("PROMO", "bing", "bing_suggest", False),
        ("SMALL", "bing", "bing_suggest_ext", False),
    ]:
        for pos, text in [(0, one), (1, two)]:
            url = search + _q(text) if with_url else "''"
            rows.append((f"p_type = '{kind}'", pos, text, s.q(tag), s.q(channel), "''", "''", url))
    return rows_sql("part", "lower(p_name)", "p_partkey", rows)


@query("extract_suggest_array", _suggest_sql())
def extract_suggest_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part type decides which endpoint answered; STANDARD parts get a payload cut short, texts a bare page."""
    body = F.to_json(F.array(F.col("p_name"), F.lit("@"))).cast("string")
    texts = F.to_json(F.array(
        F.concat_ws(" ", "p_name", "p_type"), F.concat(F.lit("  "), F.col("p_brand"), F.lit(" "), F.col("p_name"), F.lit("*~ ")),
        F.lit("x"),
    ))
    body = F.replace(body, F.lit('"@"'), texts)
    kind = F.col("p_type")
    body = F.when(kind == "STANDARD", F.substring(body, 1, 20)).otherwise(body)
    google = F.when(kind == "LARGE", "suggest_alpha").when(kind == "MEDIUM", "suggest_modifier").otherwise("suggest")
    bing = F.when(kind == "SMALL", "suggest_ext").otherwise("suggest")
    df = parts(spark, sf_dir)
    of_bing = kind.isin("PROMO", "SMALL")
    pages = docs(spark, sf_dir)
    texts_only = captured(pages, "google", "suggest", F.col("source"), F.col("doc_id"), F.col("text"))
    found = suggest.google_suggestions(
        captured(df.where(~of_bing), "google", google, F.lower("p_name"), F.col("p_partkey"), body).unionByName(texts_only)
    ).unionByName(suggest.bing_suggestions(captured(df.where(of_bing), "bing", bing, F.lower("p_name"), F.col("p_partkey"), body)))
    return found.select(*OUT)


@query("extract_suggest_jsonp", rows_sql("part", "lower(p_name)", "p_partkey", [
    ("true", 0, "p_name || ' how to'", "CASE WHEN p_size <= 25 THEN 'youtube_suggest' ELSE 'youtube_suggest_ext' END", "'youtube'", "''", "''", "''"),
    ("true", 1, "p_brand || ' ' || p_name", "CASE WHEN p_size <= 25 THEN 'youtube_suggest' ELSE 'youtube_suggest_ext' END", "'youtube'", "''", "''", "''"),
    ("true", 2, "p_type || ' demo'", "CASE WHEN p_size <= 25 THEN 'youtube_suggest' ELSE 'youtube_suggest_ext' END", "'youtube'", "''", "''", "''"),
]))
def extract_suggest_jsonp(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.format_string(
        'window.google.ac.h(["%s",[["%s how to",0,[512]],"%s %s",%d,[["no"],1],["%s demo",3]],{"k":1}])',
        "p_name", "p_name", "p_brand", "p_name", "p_size", "p_type",
    )
    endpoint = F.when(F.col("p_size") <= 25, "suggest").otherwise("suggest_ext")
    return suggest.youtube_suggestions(
        captured(parts(spark, sf_dir), "youtube", endpoint, F.lower("p_name"), F.col("p_partkey"), body)
    ).select(*OUT)


AMAZON_ROOT = "lower(p_name) || ' ' || p_partkey"


@query("extract_suggest_objects", " UNION ALL ".join([
    rows_sql("part", AMAZON_ROOT, "p_partkey", [
        ("p_size <= 30", 0, "p_name || ' bulk'", "'amazon_suggest'", "'amazon'", "''", "''", "''"),
        ("p_size <= 30", 1, "p_type || ' ' || p_name", "'amazon_suggest'", "'amazon'", "''", "''", "''"),
        ("p_size > 30", 0, "p_name || ' legacy'", "'amazon_suggest'", "'amazon'", "''", "''", "''"),
    ]),
    rows_sql("part", AMAZON_ROOT, "p_partkey", [
        ("true", 0, "p_name || ' price'", "'amazon_suggest_ext'", "'amazon'", "''", "''", "''"),
    ]),
]))
def extract_suggest_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts above size 30 have an unreadable primary answer, so the legacy one counts."""
    df = parts(spark, sf_dir)
    root = F.concat_ws(" ", F.lower("p_name"), F.col("p_partkey").cast("string"))
    good = F.format_string('{"alias":"aps","suggestions":[{"value":"%s bulk"},{"value":""},{"type":"x"},{"value":"%s %s"}]}', "p_name", "p_type", "p_name")
    body = F.when(F.col("p_size") <= 30, good).otherwise("<html>busy</html>")
    legacy = F.format_string('["%s",["%s legacy"],[],[]]', "p_name", "p_name")
    more = F.format_string('{"suggestions":[{"value":"%s price"}]}', "p_name")
    every = captured(df, "amazon", "suggest", root, F.col("p_partkey"), body).unionByName(
        captured(df, "amazon", "suggest_legacy", root, F.col("p_partkey"), legacy)
    ).unionByName(captured(df, "amazon", "suggest_ext", root, F.col("p_partkey"), more))
    return suggest.amazon_suggestions(every).select(*OUT)


@query("extract_suggest_nested", rows_sql("part", "lower(p_name)", "p_partkey", [
    ("true", 0, "p_brand || ' ' || p_name", "'alibaba_suggest'", "'alibaba'", "''", "''", "''"),
    ("true", 1, "p_name || ' oem'", "'alibaba_suggest'", "'alibaba'", "''", "''", "''"),
]))
def extract_suggest_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.format_string('{"code":200,"result":{"list":[{"keyword":"%s %s"},{"count":3},{"keyword":"%s oem"}]}}', "p_brand", "p_name", "p_name")
    return suggest.alibaba_suggestions(captured(parts(spark, sf_dir), "alibaba", "suggest", F.lower("p_name"), F.col("p_partkey"), body)).select(*OUT)


# ---- result pages around the documents ---------------------------------------------------------

def google_page() -> Column:
    """Related searches, questions and two nested blocks; the whole document is a snippet and a long link text."""
    return F.concat(
        F.lit('<html><body><div class="s75CSd x">'), F.col("lang"), F.lit(" "), F.col("source"), F.lit(' parts</div><div data-initq="1">'),
        F.col("lang"), F.lit(" "), F.col("source"), F.lit(' parts</div><div class="B9g0yd">abc</div><a href="/search?q=1">'), F.col("source"),
        F.lit('</a><a href="/other">elsewhere</a><a href="/search?q=2">'), esc(F.col("text")),
        F.lit('</a><div class="related-question-pair">What is <b>'), F.col("source"), F.lit('</b>?</div><div data-q="1">What is <b>'),
        F.col("source"), F.lit('</b>?</div><div data-q="2">no question</div><span class="CSkcDe">Why '), F.col("lang"),
        F.lit("?</span><span>Is "), F.col("source"), F.lit(" "), F.col("doc_id").cast("string"), F.lit(' good?</span><span>is it really so good?</span>'),
        F.lit('<div class="g"><div class="tF2Cxc"><h3>'), F.col("lang"), F.lit(" report <i>"), F.col("doc_id").cast("string"),
        F.lit('</i></h3><span class="aCOpRe">'), esc(F.col("text")), F.lit('</span><a>none</a><a href="https://'), F.col("source"),
        F.lit('.quora.com/?a=1&amp;b='), F.col("doc_id").cast("string"), F.lit('">go</a></div></div><div class="g"><a href="/x">untitled</a></div></body></html>'),
    )


PLAIN_TEXT = s.strip("text")
GOOGLE_RELATED = [
    ("true", 0, "lang || ' ' || source || ' parts'", "'google_related_search'", "'google'", "''", "''", "''"),
    ("length(source) > 4", 1, "source", "'google_related_search'", "'google'", "''", "''", "''"),
    (f"length({PLAIN_TEXT}) BETWEEN 5 AND 99", "CASE WHEN length(source) > 4 THEN 2 ELSE 1 END", PLAIN_TEXT,
     "'google_related_search'", "'google'", "''", "''", "''"),
]
BEFORE_PAA = f"1 + CAST(length(source) > 4 AS INTEGER) + CAST(length({PLAIN_TEXT}) BETWEEN 5 AND 99 AS INTEGER)"
GOOGLE_PAA = [
    ("true", f"{BEFORE_PAA}", "'What is' || source || '?'", "'google_paa'", "'google'", "''", "''", "''"),
    ("true", f"{BEFORE_PAA} + 1", "'Why ' || lang || '?'", "'google_paa'", "'google'", "''", "''", "''"),
    ("true", f"{BEFORE_PAA} + 2", "'Is ' || source || ' ' || doc_id || ' good?'", "'google_paa'", "'google'", "''", "''", "''"),
]
ORGANIC_URL = "'https://' || source || '.quora.com/?a=1&b=' || doc_id"
ORGANIC = [
    ("true", f"{BEFORE_PAA} + {3 + i}", "lang || ' report' || doc_id", "'google_serp_title'", "'google'",
     "lang || ' report' || doc_id", PLAIN_TEXT, ORGANIC_URL)
    for i in (0, 1)
]


def _google(spark: SparkSession, sf_dir: str, tag: str) -> DataFrame:
    pages = captured(docs(spark, sf_dir), "google", "serp", F.col("source"), F.col("doc_id"), google_page())
    return results.google_results(pages).where(F.col("source") == tag).select(*OUT)


@query("extract_related", rows_sql("documents", "source", "doc_id", GOOGLE_RELATED))
def extract_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _google(spark, sf_dir, "google_related_search")


@query("extract_paa", rows_sql("documents", "source", "doc_id", GOOGLE_PAA))
def extract_paa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _google(spark, sf_dir, "google_paa")


@query("extract_serp_google", rows_sql("documents", "source", "doc_id", ORGANIC))
def extract_serp_google(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _google(spark, sf_dir, "google_serp_title")


@query("extract_quora", rows_sql("documents", "source", "doc_id", [
    ("true", i, "lang || ' report' || doc_id", "'quora_question'", "'forum'", "lang || ' report' || doc_id", "''", ORGANIC_URL)
    for i in (0, 1)
]))
def extract_quora(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = captured(docs(spark, sf_dir), "forum", "quora", F.col("source"), F.col("doc_id"), google_page())
    return forums.quora_questions(pages).select(*OUT)


@query("extract_serp_bing", rows_sql("documents", "source", "doc_id", [
    ("true", 0, "source || ' catalog ' || doc_id", "'bing_serp_title'", "'bing'", "source || ' catalog ' || doc_id", PLAIN_TEXT,
     "'https://b.example/' || doc_id"),
    ("true", 1, "lang || ' guide'", "'bing_serp_title'", "'bing'", "lang || ' guide'", "''", "''"),
    ("true", 2, "source || ' used'", "'bing_related'", "'bing'", "''", "''", "''"),
    ("true", 3, "lang || ' new'", "'bing_related'", "'bing'", "''", "''", "''"),
]))
def extract_serp_bing(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(
        F.lit('<ol><li class="b_algo"><h2><a href="https://b.example/'), F.col("doc_id").cast("string"), F.lit('">'), F.col("source"), F.lit(" catalog "), F.col("doc_id").cast("string"),
        F.lit('</a></h2><p>not this</p><div class="b_caption"><p>'), esc(F.col("text")), F.lit('</p><p>second</p></div></li>'),
        F.lit('<li class="b_algo"><h2><a>'), F.col("lang"), F.lit(' guide</a></h2></li><li class="b_algo"><h2>no link</h2></li>'),
        F.lit('<li class="b_rs"><a href="/1">'), F.col("source"), F.lit(' used</a></li></ol><div class="b_rs"><ul><li><a>'), F.col("lang"),
        F.lit(" new</a></li><li><a> </a></li></ul></div>"),
    )
    return results.bing_results(captured(docs(spark, sf_dir), "bing", "serp", F.col("source"), F.col("doc_id"), body)).select(*OUT)


@query("extract_youtube_results", rows_sql("documents", "source", "doc_id", [
    ("true", 0, "text || ' ' || lang", "'youtube_serp'", "'youtube'", "text || ' ' || lang", "''", "'https://www.youtube.com/watch?v=v' || doc_id"),
    ("true", 1, "source || ' video'", "'youtube_serp'", "'youtube'", "source || ' video'", "''", "'https://www.youtube.com/watch?v='"),
]))
def extract_youtube_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.to_json(F.array(F.struct(F.col("text").alias("text")), F.struct(F.concat(F.lit(" "), F.col("lang")).alias("text"))))
    body = F.concat(
        F.lit('<script>var ytInitialData = {"contents":{"twoColumnSearchResultsRenderer":{"primaryContents":'
              '{"sectionListRenderer":{"contents":[{"itemSectionRenderer":{"contents":[{"videoRenderer":{"videoId":"v'), F.col("doc_id").cast("string"),
        F.lit('","title":{"runs":'), runs, F.lit('}}},{"adRenderer":{}}]}},{"continuationItemRenderer":{}},'
              '{"itemSectionRenderer":{"contents":[{"videoRenderer":{"title":{"runs":[{"text":"'), F.col("source"),
        F.lit(' video"},{"bold":true}]}}}]}}]}}}}};</script><script>var other = {};</script>'),
    )
    return results.youtube_results(captured(docs(spark, sf_dir), "youtube", "serp", F.col("source"), F.col("doc_id"), body)).select(*OUT)


ALI = "'https://www.alibaba.com/trade/search'"


@query("extract_alibaba_titles", " UNION ALL ".join([
    rows_sql("documents", "source", "doc_id", [
        ("true", 0, "source || ' machine'", "'alibaba_product_title'", "'alibaba'", "''", "''", ALI),
        ("true", 1, "source || ' machine'", "'alibaba_product_title'", "'alibaba'", "''", "''", ALI),
        (f"length({PLAIN_TEXT}) > 5", 2, PLAIN_TEXT, "'alibaba_product_title'", "'alibaba'", "''", "''", ALI),
        ("true", f"2 + CAST(length({PLAIN_TEXT}) > 5 AS INTEGER)", "lang || ' press'", "'alibaba_product_title'", "'alibaba'", "''", "''", ALI),
        ("true", f"3 + CAST(length({PLAIN_TEXT}) > 5 AS INTEGER)", "text", "'alibaba_jsonld'", "'alibaba'", "''", "''", "''"),
        ("true", f"4 + CAST(length({PLAIN_TEXT}) > 5 AS INTEGER)", "lang || ' one'", "'alibaba_jsonld'", "'alibaba'", "''", "''", "''"),
        ("true", f"5 + CAST(length({PLAIN_TEXT}) > 5 AS INTEGER)", "lang || ' two'", "'alibaba_jsonld'", "'alibaba'", "''", "''", "''"),
    ], "WHERE text <> ''"),
    rows_sql("documents", "source || '/' || doc_id", "doc_id", [
        ("true", 0, "lang || ' lift'", "'alibaba_title_html'", "'alibaba'", "''", "''", "''"),
        ("true", 1, PLAIN_TEXT, "'alibaba_title_html'", "'alibaba'", "''", "''", "''"),
    ]),
]))
def extract_alibaba_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search page, and the products page where the suggestion payload is a plain text."""
    body = F.concat(
        F.lit('<h2 class="organic-gallery-title__outter search-card-e-title">'), F.col("source"), F.lit(' machine</h2>'),
        F.lit('<div class="search-card-e-title"><a><span>'), esc(F.col("text")), F.lit('</span></a><span>tiny</span></div>'),
        F.lit('<a class="elements-title-normal__outter">'), F.col("lang"), F.lit(' press</a><script type="application/json">'),
        F.to_json(F.struct(F.col("text").alias("name"))), F.lit('</script><script type="application/json">[{"name":"'), F.col("lang"),
        F.lit(' one"},{"id":1},{"name":"'), F.col("lang"), F.lit(' two"}]</script><script type="application/json">{"name":</script>'),
        F.lit('<script type="application/ld+json">{"name":"not this"}</script>'),
    )
    titles = F.concat(
        F.lit('<h2 class="search-card-e-title">'), F.col("lang"), F.lit(' lift</h2><h2 class="organic-gallery-title__outter">'),
        esc(F.col("text")), F.lit("</h2><h2>other</h2>"),
    )
    df = docs(spark, sf_dir)
    root = F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string"))
    found = markets.alibaba_titles(captured(df, "alibaba", "search", F.col("source"), F.col("doc_id"), body))
    spare = captured(df, "alibaba", "suggest", root, F.col("doc_id"), F.col("text")).unionByName(
        captured(df, "alibaba", "products", root, F.col("doc_id"), titles))
    return found.unionByName(markets.alibaba_fallback_titles(spare)).select(*OUT)


MIC_URL = "'https://m.example/' || doc_id"


@query("extract_madeinchina", " UNION ALL ".join([
    rows_sql("documents", "source || '/' || doc_id", "doc_id", [
        ("true", 0, "source || ' engine'", "'madeinchina_product_title'", "'madeinchina'", "''", "''", MIC_URL),
        (f"length({PLAIN_TEXT}) > 5", 1, PLAIN_TEXT, "'madeinchina_product_title'", "'madeinchina'", "''", "''", MIC_URL),
        ("true", f"1 + CAST(length({PLAIN_TEXT}) > 5 AS INTEGER)", "source || ' pump one'", "'madeinchina_product_title'", "'madeinchina'", "''", "''", MIC_URL),
        ("true", f"2 + CAST(length({PLAIN_TEXT}) > 5 AS INTEGER)", "lang || ' hot'", "'madeinchina_related'", "'madeinchina'", "''", "''", "''"),
        ("true", f"3 + CAST(length({PLAIN_TEXT}) > 5 AS INTEGER)", "lang || ' tools'", "'madeinchina_category'", "'madeinchina'", "''", "''", "''"),
    ]),
    rows_sql("documents", "source || '/' || doc_id", "doc_id + 1", [
        ("true", 0, "lang || ' page two'", "'madeinchina_product_title'", "'madeinchina'", "''", "''", "''"),
    ]),
]))
def extract_madeinchina(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both pages of every root; second pages whose first page was not answered are ignored."""
    page1 = F.concat(
        F.lit('<h2 class="product-name">'), F.col("source"), F.lit(' engine</h2><div class="product-title"><b><a>'), esc(F.col("text")),
        F.lit('</a></b></div><span class="product-name">'), F.col("source"), F.lit(' pump one</span><a class="title">short</a>'),
        F.lit('<div class="hot-search"><a>'), F.col("lang"), F.lit(' hot</a></div><ul class="category-list"><li><a>'), F.col("lang"),
        F.lit(' tools</a></li><li><a>abc</a></li></ul>'),
    )
    page2 = F.concat(F.lit('<a class="title" href="#">'), F.col("lang"), F.lit(' page two</a><div class="hot-search"><a>late one</a></div>'))
    df = docs(spark, sf_dir)
    root = F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string"))
    pages = captured(df, "madeinchina", "search", root, F.col("doc_id"), page1, F.concat(F.lit("https://m.example/"), F.col("doc_id").cast("string"))).unionByName(
        captured(df, "madeinchina", "search_page2", root, F.col("doc_id") + 1, page2)).unionByName(
        captured(df, "madeinchina", "search_page2", F.concat(root, F.lit("/lost")), F.col("doc_id"), page2))
    return markets.madeinchina_titles(pages).select(*OUT)


@query("extract_reddit_posts", " UNION ALL ".join([
    rows_sql("documents", "source || '/' || doc_id", "doc_id", [
        ("true", 0, "'Is ' || source || ' worth it? ' || lang", "'reddit_post_title'", "'forum'", "'Is ' || source || ' worth it? ' || lang",
         "text[1:200]", "'https://r.example/' || doc_id"),
        ("true", 1, "lang || ' link post'", "'reddit_post_title'", "'forum'", "lang || ' link post'", "''", "''"),
    ]),
    rows_sql("documents", "source || '/' || doc_id", "doc_id + 1", [
        ("true", 0, "source || ' logistics talk'", "'reddit_logistics'", "'forum'", "source || ' logistics talk'", "''", "''"),
    ]),
]))
def extract_reddit_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over everything with the document as post text, and one subreddit search per root."""
    post = F.to_json(F.struct(
        F.concat(F.lit("Is "), F.col("source"), F.lit(" worth it? "), F.col("lang")).alias("title"), F.col("text").alias("selftext"),
        F.concat(F.lit("https://r.example/"), F.col("doc_id").cast("string")).alias("url"),
    ))
    body = F.concat(
        F.lit('{"data":{"children":[{"kind":"t3","data":'), post, F.lit('},{"data":{"title":""}},{"data":{"title":"'), F.col("lang"),
        F.lit(' link post"}}]}}'),
    )
    sub = F.concat(F.lit('{"data":{"children":[{"data":{"title":"'), F.col("source"), F.lit(' logistics talk"}}]}}'))
    df = docs(spark, sf_dir)
    root = F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string"))
    where = F.lit("https://www.reddit.com/r/logistics/search.json")
    pages = captured(df, "forum", "reddit", root, F.col("doc_id"), body).unionByName(
        captured(df, "forum", "subreddit", root, F.col("doc_id") + 1, sub, where)).unionByName(
        captured(df, "forum", "subreddit", F.concat(root, F.lit("/lost")), F.col("doc_id"), sub, where))
    return forums.reddit_posts(pages).unionByName(forums.subreddit_posts(pages)).select(*OUT)


# ---- questions in whole texts ------------------------------------------------------------------

_TEXTS_SQL = """texts AS (SELECT 'd' || doc_id AS id, replace(text, '. ', '? ') AS text FROM documents
  UNION ALL SELECT 'c' || conv_id || '/' || turn, replace(text, '. ', '? ') FROM conversations)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    return docs(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text").unionByName(
        talk.select(F.concat(F.lit("c"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("id"), "text")
    ).select("id", F.replace("text", F.lit(". "), F.lit("? ")).alias("text"))


@query("question_sentences", f"""WITH {_TEXTS_SQL},
found AS (SELECT id, unnest(regexp_extract_all(text, '([^.!?\\n]*)\\?', 1)) AS sentence FROM texts)
SELECT id, {s.strip('sentence')} AS sentence FROM found WHERE length({s.strip('sentence')}) BETWEEN 11 AND 199""")
def question_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = forums.question_sentences(F.col("text"), strict=False)
    return _texts(spark, sf_dir).select("id", F.explode_outer(asked).alias("sentence")).where(F.col("sentence").isNotNull())


@query("question_sentences_strict", f"""WITH {_TEXTS_SQL},
found AS (SELECT id, unnest(regexp_split_to_array(text, '[.!?\\n]')) AS sentence FROM texts)
SELECT id, {s.strip('sentence')} AS sentence FROM found WHERE contains(sentence, '?') AND length({s.strip('sentence')}) BETWEEN 11 AND 199""")
def question_sentences_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = forums.question_sentences(F.col("text"))
    return _texts(spark, sf_dir).select("id", F.explode_outer(asked).alias("sentence")).where(F.col("sentence").isNotNull())


# ---- web pages ---------------------------------------------------------------------------------

PAGE_ROOT = "regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1)"
TITLE_SQL = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
H1_SQL = "regexp_extract(html, '<h1>([^<]*)</h1>', 1)"
HOST_SQL = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
NO_ENTITY = "replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


def clean_sql(x: str) -> str:
    return s.strip(NO_ENTITY.format(x=x))


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages, with a description made of the url and a second heading made of the title twice."""
    pages = spread(table(spark, sf_dir, "pages"))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    body = F.replace(F.col("html"), F.lit("<head>"), F.concat(
        F.lit('<head><meta name="Description" content="no"><meta name="description" content=" '), esc(F.col("url")),
        F.lit('"><meta name="description" content="late">')))
    body = F.replace(body, F.lit("<article>"), F.concat(F.lit("<article><h2>"), title, F.lit("<b> "), title, F.lit("</b></h2>")))
    root = F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1)
    return captured(pages, "competitor", "page", root, F.col("page_id"), body, F.col("url"))


@query("page_title", f"""SELECT page_id AS seq, {clean_sql(TITLE_SQL)} AS title FROM pages""")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = webpages.with_page_elements(web_pages(spark, sf_dir))
    return pages.select("seq", webpages.page_title(F.col("els")).alias("title"))


@query("page_meta", "SELECT page_id AS seq, ' ' || url AS description FROM pages")
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = webpages.with_page_elements(web_pages(spark, sf_dir))
    return pages.select("seq", webpages.page_description(F.col("els")).alias("description"))


_H2 = f"{clean_sql(TITLE_SQL)} || {clean_sql(TITLE_SQL)}"


@query("page_headings", rows_sql("pages", PAGE_ROOT, "page_id", [
    (f"{clean_sql(H1_SQL)} <> ''", 0, clean_sql(H1_SQL), f"'competitor:' || {HOST_SQL} || ':h1'", "'competitor'", clean_sql(TITLE_SQL), "''", "url"),
    (f"length({_H2}) BETWEEN 1 AND 99", f"CAST({clean_sql(H1_SQL)} <> '' AS INTEGER)", _H2, f"'competitor:' || {HOST_SQL} || ':h2'", "'competitor'", clean_sql(TITLE_SQL), "''", "url"),
]))
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmine.sources.gate import emit

    pages = webpages.with_page_elements(web_pages(spark, sf_dir))
    pages = pages.withColumn("page_title", webpages.page_title(F.col("els")))
    return emit(pages, webpages.heading_rows(F.col("els"), F.col("page_title"), F.col("url"))).select(*OUT)


@query("url_slug", rf"""
SELECT page_id, trim(regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '[-_/]', ' ', 'g')) AS slug
FROM pages""")
def url_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url"))
    return pages.select("page_id", webpages.url_slug(F.col("url")).alias("slug"))


@query("page_anchors", f"""
WITH links AS (
  SELECT page_id, {PAGE_ROOT} AS root_keyword, url, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS link FROM pages),
named AS (
  SELECT page_id, root_keyword, url, {NO_ENTITY.format(x="regexp_extract(link, 'href=.([^>]*).>', 1)")} AS href,
         {clean_sql("regexp_extract(link, '>([^<]*)<', 1)")} AS anchor FROM links)
SELECT page_id AS seq, root_keyword, anchor, href,
       regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS url
FROM named WHERE length(anchor) BETWEEN 4 AND 79 AND contains(lower(anchor), root_keyword)""")
def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmine.functions import urls

    pages = webpages.with_page_elements(web_pages(spark, sf_dir))
    found = pages.select("seq", "root_keyword", "url", F.explode_outer(webpages.anchors(F.col("els"), F.col("root_keyword"))).alias("a"))
    href = F.col("a")["attrs"]["href"]
    return found.where(F.col("a").isNotNull()).select(
        "seq", "root_keyword", F.col("a")["text"].alias("anchor"), href.alias("href"), urls.join(F.col("url"), href).alias("url")
    )


@query("page_records", f"""
WITH kinds AS (
  SELECT page_id, {PAGE_ROOT} AS root_keyword, {HOST_SQL} AS host, url, html, {clean_sql(TITLE_SQL)} AS title FROM pages),
found AS (
  SELECT page_id, root_keyword, title AS keyword, 'competitor:' || host AS source, title, '' AS description, url FROM kinds WHERE title <> ''
  UNION ALL SELECT page_id, root_keyword, ' ' || url, 'competitor:' || host, '', ' ' || url, url FROM kinds
  UNION ALL SELECT page_id, root_keyword, {clean_sql(H1_SQL)}, 'competitor:' || host || ':h1', title, '', url FROM kinds
  UNION ALL SELECT page_id, root_keyword, title || title, 'competitor:' || host || ':h2', title, '', url FROM kinds
            WHERE length(title || title) BETWEEN 1 AND 99
  UNION ALL SELECT page_id, root_keyword, regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '[-_/]', ' ', 'g'),
            'competitor:' || host || ':url_slug', '', '', url FROM kinds
            WHERE length(trim(regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '[-_/]', ' ', 'g'))) > 3
  UNION ALL SELECT page_id, root_keyword, anchor, 'competitor:' || host || ':anchor', '', '',
            regexp_extract(url, '^(https?://[^/?#]+)', 1) || href
            FROM (SELECT page_id, root_keyword, host, url, {NO_ENTITY.format(x="regexp_extract(link, 'href=.([^>]*).>', 1)")} AS href,
                         {clean_sql("regexp_extract(link, '>([^<]*)<', 1)")} AS anchor
                  FROM (SELECT *, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS link FROM kinds))
            WHERE length(anchor) BETWEEN 4 AND 79 AND contains(lower(anchor), root_keyword))
SELECT root_keyword, lower({s.strip('keyword')}) AS keyword, source, title, description, url FROM found
WHERE length({s.strip('keyword')}) >= 2""")
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = webpages.page_records(web_pages(spark, sf_dir))
    return found.select("root_keyword", "keyword", "source", "title", "description", "url")


@query("discover_competitors", f"""
WITH links AS (
  SELECT {PAGE_ROOT} AS root_keyword, page_id * 2 AS seq, 'https://www.google.com/url?q=' || url AS href FROM pages
  UNION ALL SELECT {PAGE_ROOT}, page_id * 2 + 1, url FROM pages
  UNION ALL SELECT {PAGE_ROOT}, page_id * 2, '/local' FROM pages),
hosts AS (
  SELECT root_keyword, regexp_extract(href, '^https?://([^/?#]*)', 1) AS host, min(seq) AS seq, arg_min(href, seq) AS url
  FROM links WHERE starts_with(href, 'http')
    AND NOT regexp_matches(href, 'google\\.com|youtube\\.com|wikipedia\\.org|amazon\\.com|alibaba\\.com')
  GROUP BY ALL)
SELECT root_keyword, CAST(row_number() OVER (PARTITION BY root_keyword ORDER BY seq) AS INTEGER) AS rank, host, url
FROM hosts QUALIFY rank <= 5""")
def discover_competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url"))
    root, key = F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1), F.col("page_id")
    links = F.array(
        F.struct((key * 2).alias("seq"), F.concat(F.lit("https://www.google.com/url?q="), "url").alias("href")),
        F.struct((key * 2 + 1).alias("seq"), F.col("url").alias("href")),
        F.struct((key * 2).alias("seq"), F.lit("/local").alias("href")),
    )
    return webpages.competitor_links(pages.select(root.alias("root_keyword"), F.inline(links)))


@query("dom_elements", f"""
WITH tags AS (
  SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages
  UNION ALL SELECT page_id, unnest(['script', 'style']) FROM pages)
SELECT page_id, tag, count(*) AS n FROM tags GROUP BY ALL""")
def dom_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of every page, counted by page and tag."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    found = pages.withColumn("els", elements(F.col("html"))).select("page_id", F.explode_outer("els").alias("e")).where(F.col("e").isNotNull())
    return found.groupBy("page_id", F.col("e")["tag"].alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("select_elements", """
WITH links AS (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="([^"]*)">', 1)) AS href FROM pages)
SELECT page_id, href, count(*) AS n FROM links GROUP BY ALL""")
def select_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links inside the navigation list of every page."""
    from lexmine.sources.dom import within

    nav, link = is_a("nav"), is_a("a", attr="href")
    pages = spread(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("body")))
    pages = results.with_elements(pages, nav, link)
    found = pages.select("page_id", F.explode_outer(select(F.col("els"), within(F.col("els"), nav, link))).alias("e"))
    found = found.where(F.col("e").isNotNull())
    return found.groupBy("page_id", F.col("e")["attrs"]["href"].alias("href")).agg(F.count(F.lit(1)).alias("n"))


@query("extract_trends", f"""
SELECT lower(p_name) AS root_keyword,
       ((CAST(8 AS BIGINT) * 16777216) + CASE WHEN p_type IN ('SMALL', 'PROMO') THEN 2 ELSE 0 END + CASE WHEN p_size > 25 THEN 1 ELSE 0 END) * {SHIFT} + p_partkey AS seq,
       lower(p_brand || ' ' || p_name) AS keyword,
       CASE WHEN p_type IN ('SMALL', 'PROMO') THEN 'google_trends_topic_' ELSE 'google_trends_' END || CASE WHEN p_size > 25 THEN 'rising' ELSE 'top' END AS source,
       'google_trends' AS channel, '' AS title, '' AS description, '' AS url
FROM part WHERE p_type <> 'LARGE'""")
def extract_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    trends = parts(spark, sf_dir).select(
        F.lower("p_name").alias("root_keyword"), F.when(F.col("p_type").isin("SMALL", "PROMO"), "topic").otherwise("query").alias("kind"),
        F.when(F.col("p_size") > 25, "rising").otherwise("top").alias("rank_type"), F.col("p_partkey").cast("int").alias("ord"),
        F.when(F.col("p_type") == "LARGE", "  ").otherwise(F.concat(F.lit(" "), "p_brand", F.lit(" "), "p_name", F.lit("\n"))).alias("text"),
        F.lit(COLLECTED_AT).cast("timestamp_ntz").alias("collected_at"),
    )
    return trend_records(trends).select(*OUT)
