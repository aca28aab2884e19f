"""Queries over roots, requests and captured attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmine.plans.collection import kept, route
from lexmine.sources import frontier, responses
from lexmine.session import cut_lineage
from lexmine.sources.gate import record_gate
from workload import sql_base as s
from workload.captures import spread, table
from workload.registry import query
from workload.templates import COLLECTED_AT

ROOTS_SQL = "roots AS (SELECT DISTINCT lower(concat_ws(' ', p_brand, p_type, p_name)) AS root_keyword FROM part)"
QUOTED = "replace(replace(replace(url_encode({x}), '%20', '+'), '*', '%2A'), '%7E', '~')"


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.lower(F.concat_ws(" ", "p_brand", "p_type", "p_name")).alias("root_keyword")).distinct()


@query("roots_normalize", f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents),
parts AS (
  SELECT doc_id, line_no, unnest(string_split(line, ',')) AS part, generate_subscripts(string_split(line, ','), 1) - 1 AS position
  FROM lines),
named AS (SELECT doc_id, line_no, position, lower({s.strip('part')}) AS root_keyword FROM parts)
SELECT root_keyword, f.doc_id AS doc_id, CAST(f.line_no AS INTEGER) AS line_no, CAST(f.position AS INTEGER) AS position
FROM (SELECT root_keyword, min({{'doc_id': doc_id, 'line_no': line_no, 'position': position}}) AS f
      FROM named WHERE root_keyword <> '' GROUP BY root_keyword)""")
def roots_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every comma-separated phrase of every line of the documents, where it occurs first."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return frontier.roots_normalize(lines, "line", "doc_id", "line_no")


@query("expand_root", f"""WITH {ROOTS_SQL}
SELECT root_keyword, channel, endpoint, 0 AS query_ord,
       CASE WHEN channel = 'google_trends' THEN root_keyword[1:100] ELSE root_keyword END AS query, url
FROM roots, (VALUES
  ('google', 'suggest', 'https://suggestqueries.google.com/complete/search'),
  ('bing', 'suggest', 'https://api.bing.com/osjson.aspx'),
  ('youtube', 'suggest', 'https://suggestqueries.google.com/complete/search'),
  ('amazon', 'suggest', 'https://completion.amazon.com/api/2017/suggestions'),
  ('alibaba', 'suggest', 'https://www.alibaba.com/search/suggest_new'),
  ('google_trends', 'trends', '')) AS e(channel, endpoint, url)""")
def expand_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.expand_root(roots(spark, sf_dir))


@query("fallback_requests", f"""WITH {ROOTS_SQL},
answered AS (SELECT lower(concat_ws(' ', p_brand, p_type, p_name)) AS root_keyword FROM part GROUP BY ALL HAVING max(p_size) > 40)
SELECT root_keyword, 'amazon' AS channel, 'suggest_legacy' AS endpoint, 0 AS query_ord, root_keyword AS query,
       'https://completion.amazon.com/search/complete' AS url
FROM roots WHERE root_keyword NOT IN (SELECT root_keyword FROM answered)""")
def fallback_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of large parts parse, those of middle ones do not, and small ones have none."""
    root = F.lower(F.concat_ws(" ", "p_brand", "p_type", "p_name")).alias("root_keyword")
    sized = table(spark, sf_dir, "part").groupBy(root).agg(F.max("p_size").alias("size")).where("size > 20")
    body = F.when(F.col("size") > 40, '{"suggestions": []}').otherwise("<html>")
    answers = sized.select(
        "root_keyword", F.lit("amazon").alias("channel"), F.lit("suggest").alias("endpoint"), body.alias("body"))
    return frontier.fallback_requests(roots(spark, sf_dir), answers)


@query("expand_alphabet", f"""WITH {ROOTS_SQL}
SELECT root_keyword, 'google' AS channel, 'suggest_alpha' AS endpoint, CAST(i AS INTEGER) AS query_ord,
       root_keyword || ' ' || chr(CAST(97 + i AS INTEGER)) AS query,
       'https://suggestqueries.google.com/complete/search' AS url
FROM roots, range(26) AS letters(i)""")
def expand_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.expand_alphabet(roots(spark, sf_dir))


# The channels' modifiers and addresses, stated again independently of the library's.
@query("expand_modifiers", f"""WITH {ROOTS_SQL}, lists(channel, endpoint, url, words) AS (VALUES
  ('google', 'suggest_modifier', 'https://suggestqueries.google.com/complete/search',
   ['price','manufacturer','factory','supplier','custom','oem','wholesale','specification','for sale','quote','cost',
    'buy','china','how to','what is','types of','best','top','vs','alternative','certified']),
  ('bing', 'suggest_ext', 'https://api.bing.com/osjson.aspx',
   ['price','manufacturer','supplier','factory','custom','oem','buy','for sale','specification','quote','china','how',
    'what','best','vs','certified']),
  ('youtube', 'suggest_ext', 'https://suggestqueries.google.com/complete/search',
   ['how to','installation','working','review','demo','vs','price','china factory','manufacturer']),
  ('amazon', 'suggest_ext', 'https://completion.amazon.com/api/2017/suggestions',
   ['price','for warehouse','industrial','heavy duty','electric','hydraulic','specification','supplier']))
SELECT root_keyword, channel, endpoint, CAST(i - 1 AS INTEGER) AS query_ord, root_keyword || ' ' || words[i] AS query, url
FROM roots, (SELECT channel, endpoint, url, words, unnest(range(1, len(words) + 1)) AS i FROM lists)""")
def expand_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.expand_modifiers(roots(spark, sf_dir))


_SLUG = QUOTED.format(x="replace(root_keyword, ' ', '-')")
_CHINA = f"'https://www.made-in-china.com/multi-search/' || {_SLUG} || '/F1/'"


@query("expand_pages", f"""WITH {ROOTS_SQL}, pages AS (
  SELECT root_keyword, unnest([
    {{'channel': 'google', 'endpoint': 'serp', 'n': 0, 'query': root_keyword, 'url': 'https://www.google.com/search'}},
    {{'channel': 'bing', 'endpoint': 'serp', 'n': 0, 'query': root_keyword, 'url': 'https://www.bing.com/search'}},
    {{'channel': 'youtube', 'endpoint': 'serp', 'n': 0, 'query': root_keyword, 'url': 'https://www.youtube.com/results'}},
    {{'channel': 'alibaba', 'endpoint': 'products', 'n': 0, 'query': root_keyword,
      'url': 'https://www.alibaba.com/Products/' || {QUOTED.format(x='root_keyword')} || '.html'}},
    {{'channel': 'alibaba', 'endpoint': 'search', 'n': 0, 'query': root_keyword, 'url': 'https://www.alibaba.com/trade/search'}},
    {{'channel': 'madeinchina', 'endpoint': 'search', 'n': 0, 'query': root_keyword, 'url': {_CHINA}}},
    {{'channel': 'madeinchina', 'endpoint': 'search_page2', 'n': 0, 'query': root_keyword, 'url': {_CHINA} || '?pageNum=2'}},
    {{'channel': 'forum', 'endpoint': 'reddit', 'n': 0, 'query': root_keyword, 'url': 'https://www.reddit.com/search.json'}},
    {{'channel': 'forum', 'endpoint': 'subreddit', 'n': 0, 'query': root_keyword, 'url': 'https://www.reddit.com/r/manufacturing/search.json'}},
    {{'channel': 'forum', 'endpoint': 'subreddit', 'n': 1, 'query': root_keyword, 'url': 'https://www.reddit.com/r/engineering/search.json'}},
    {{'channel': 'forum', 'endpoint': 'subreddit', 'n': 2, 'query': root_keyword, 'url': 'https://www.reddit.com/r/industrial/search.json'}},
    {{'channel': 'forum', 'endpoint': 'subreddit', 'n': 3, 'query': root_keyword, 'url': 'https://www.reddit.com/r/logistics/search.json'}},
    {{'channel': 'forum', 'endpoint': 'subreddit', 'n': 4, 'query': root_keyword, 'url': 'https://www.reddit.com/r/warehousing/search.json'}},
    {{'channel': 'forum', 'endpoint': 'quora', 'n': 0, 'query': 'site:quora.com ' || root_keyword, 'url': 'https://www.google.com/search'}},
    {{'channel': 'competitor', 'endpoint': 'discovery', 'n': 0, 'query': root_keyword || ' manufacturer supplier', 'url': 'https://www.google.com/search'}}
  ]) AS p FROM roots)
SELECT root_keyword, p.channel AS channel, p.endpoint AS endpoint, p.n AS query_ord, p.query AS query, p.url AS url FROM pages""")
def expand_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.expand_pages(roots(spark, sf_dir))


@query("expand_domains", f"""WITH {ROOTS_SQL}
SELECT root_keyword, 'competitor' AS channel, 'page' AS endpoint, CAST(n AS INTEGER) AS query_ord, root_keyword AS query,
       CASE n WHEN 0 THEN 'https://www.first.example' WHEN 2 THEN 'https://shop.second.example'
              WHEN 1 THEN 'https://www.first.example/search?q=' || replace(root_keyword, ' ', '+')
              ELSE 'https://shop.second.example/search?q=' || replace(root_keyword, ' ', '+') END AS url
FROM roots, range(4) AS numbers(n)""")
def expand_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.expand_domains(roots(spark, sf_dir), ["www.first.example", "shop.second.example"])


@query("channel_filter", f"""WITH {ROOTS_SQL}
SELECT root_keyword, 'suggest' AS endpoint, channel, 0 AS query_ord
FROM roots, (VALUES ('google'), ('youtube'), ('amazon'), ('alibaba')) AS c(channel)
UNION ALL SELECT root_keyword, 'trends', 'google_trends', 0 FROM roots""")
def channel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bing is switched off; switches that no channel listens to change nothing."""
    switches = {"bing_suggest": False, "google_serp": False, "alibaba_titles": False, "not_a_switch": False}
    requests = frontier.channel_filter(frontier.expand_root(roots(spark, sf_dir)), switches)
    return requests.select("root_keyword", "endpoint", "channel", "query_ord")


@query("pending_frontier", f"""WITH {ROOTS_SQL},
done AS (SELECT lower(concat_ws(' ', p_brand, p_type, p_name)) AS root_keyword FROM part WHERE p_size <= 10)
SELECT root_keyword, 'google' AS channel, 'suggest_alpha' AS endpoint, CAST(i AS INTEGER) AS query_ord
FROM roots, range(26) AS letters(i) WHERE root_keyword NOT IN (SELECT root_keyword FROM done)""")
def pending_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = table(spark, sf_dir, "part").where("p_size <= 10").select(
        F.lower(F.concat_ws(" ", "p_brand", "p_type", "p_name")).alias("root_keyword")
    )
    requests = frontier.expand_alphabet(roots(spark, sf_dir))
    return frontier.pending(requests, landed).select("root_keyword", "channel", "endpoint", "query_ord")


@query("resolve_responses", """
WITH attempts AS (
  SELECT event_id // 5 AS request_id, CAST(event_id % 5 + 1 AS INTEGER) AS attempt, props AS body,
         CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 WHEN 'click' THEN 429 WHEN 'view' THEN 301 ELSE 200 END AS status
  FROM events)
SELECT CAST(request_id AS VARCHAR) AS request_id, min(attempt) AS attempt, arg_min(status, attempt) AS status, arg_min(body, attempt) AS body
FROM attempts WHERE attempt <= 3 AND status < 400 GROUP BY request_id""")
def resolve_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five consecutive events are the five attempts of one request."""
    status = F.create_map(*[F.lit(x) for x in ("error", 500, "signup", 404, "click", 429, "view", 301)])
    attempts = spread(table(spark, sf_dir, "events").select("event_id", "event_type", "props")).select(
        F.expr("event_id div 5").cast("string").alias("request_id"),
        F.lit("google").alias("channel"), F.lit("suggest").alias("endpoint"),
        (F.col("event_id") % 5 + 1).cast("int").alias("attempt"),
        F.coalesce(status[F.col("event_type")], F.lit(200)).alias("status"),
        F.col("props").alias("body"),
    )
    return responses.resolve(attempts).select("request_id", "attempt", "status", "body")


@query("quarantine_payloads", """
WITH bodies AS (
  SELECT 'e' || event_id AS request_id, props AS body FROM events
  UNION ALL SELECT 'd' || doc_id, text FROM documents
  UNION ALL SELECT 'j' || doc_id, CAST(to_json([text]) AS VARCHAR) FROM documents)
SELECT request_id, body FROM bodies WHERE NOT json_valid(body)""")
def quarantine_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    def bodies(name: str, prefix: str, key: str, body) -> DataFrame:
        return spread(table(spark, sf_dir, name)).select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("request_id"), body.alias("body")
        )

    every = bodies("events", "e", "event_id", F.col("props")).unionByName(
        bodies("documents", "d", "doc_id", F.col("text"))
    ).unionByName(bodies("documents", "j", "doc_id", F.to_json(F.array("text"))))
    return responses.quarantine(every)


@query("fallback_merge", """
WITH calls AS (
  SELECT lower(p_name) || ' ' || p_partkey AS root_keyword, p_size,
         CASE WHEN p_size <= 20 THEN 'good' WHEN p_size <= 35 THEN 'bad' ELSE 'none' END AS primary_state FROM part)
SELECT root_keyword, 'amazon' AS channel, CASE primary_state WHEN 'good' THEN 'suggest' ELSE 'suggest_legacy' END AS endpoint FROM calls
UNION ALL
SELECT root_keyword, 'alibaba', CASE primary_state WHEN 'good' THEN 'suggest' ELSE 'products' END
FROM calls WHERE primary_state <> 'none'""")
def fallback_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts up to size 20 have a good primary answer, up to 35 a malformed one, larger ones none. Which answers count is
    seen from the records that the extraction keeps."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"))
    root = F.concat_ws(" ", F.lower("p_name"), F.col("p_partkey").cast("string"))
    amazon, legacy = F.lit('{"suggestions":[{"value":"found"}]}'), F.lit('["q",["found"]]')
    alibaba, products = F.lit('{"result":{"list":[{"keyword":"found"}]}}'), F.lit('<h2 class="search-card-e-title">found</h2>')
    answers = [("amazon", "suggest", amazon), ("amazon", "suggest_legacy", legacy), ("alibaba", "suggest", alibaba), ("alibaba", "products", products)]
    calls = F.array(*[F.struct(
        F.lit(channel).alias("channel"), F.lit(endpoint).alias("endpoint"),
        (body if endpoint != "suggest" else F.when(F.col("p_size") <= 20, body).when(F.col("p_size") <= 35, F.lit("<html>"))).alias("body"),
    ) for channel, endpoint, body in answers])
    every = part.select(
        root.alias("root_keyword"), F.col("p_partkey").cast("bigint").alias("seq"), F.inline(calls)).where(F.col("body").isNotNull())
    every = every.withColumn("request_id", F.concat_ws("/", "channel", "endpoint", "root_keyword")).withColumn("url", F.lit(""))
    return kept(cut_lineage(route(every))).select("root_keyword", "channel", "endpoint")


@query("record_gate", f"""
WITH lines AS (
  SELECT doc_id, source AS tag, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
SELECT doc_id || '/' || line_no AS root_keyword, CAST(line_no AS BIGINT) AS seq, lower({s.strip('line')}) AS keyword,
       CASE WHEN tag = 'src1' THEN 'forum' ELSE tag END AS source, 'forum' AS channel, '' AS title,
       '' AS description, '' AS url, 'en' AS language, 'US' AS country, TIMESTAMP '{COLLECTED_AT}' AS collected_at
FROM lines WHERE length({s.strip('line')}) >= 2""")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the documents as a candidate; the tag of one source is blank."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "keyword"))
    return record_gate(lines.select(
        F.concat_ws("/", F.col("doc_id").cast("string"), F.col("line_no").cast("string")).alias("root_keyword"),
        F.col("line_no").cast("bigint").alias("seq"), "keyword",
        F.when(F.col("source") != "src1", F.col("source")).otherwise("").alias("source"),
        F.lit("forum").alias("channel"), F.lit(None).cast("string").alias("title"),
        F.lit("").alias("description"), F.lit("").alias("url"),
        F.lit(COLLECTED_AT).cast("timestamp_ntz").alias("collected_at"),
    ))
