"""Queries over whole runs: what landed, what is done, what to send next, and everything that one pass extracts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmine import rules
from lexmine.operators import clusters, roots as root_table
from lexmine.operators.cleaning import clean
from lexmine.operators.increment import CleanedTable
from lexmine.operators.ordered import with_positions
from lexmine.plans import crawl, ledger
from lexmine.plans.analysis import analyze, final_keyword_map, map_order
from lexmine.plans.collection import extract
from lexmine.session import cut_lineage, shared_folder
from lexmine.sinks import files, landing
from lexmine.sources import attempts, frontier
from workload import sql_base as s
from workload.captures import NARROW, records, spread, table
from workload.labelling import RECORD
from workload.registry import query
from workload.requesting import QUOTED, ROOTS_SQL, roots
from workload.templates import COLLECTED_AT

BUCKETS = 64


@query("landing_layout", f"""
WITH parts AS (SELECT lower(concat_ws(' ', p_brand, p_type, p_name)) AS root_keyword, p_name, p_size FROM part)
SELECT CAST(CAST('0x' || md5(root_keyword)[1:8] AS BIGINT) % {BUCKETS} AS INTEGER) AS bucket, root_keyword,
       CASE WHEN p_name LIKE 'red %' AND count(*) FILTER (p_size > 25) > 0 THEN count(*) FILTER (p_size > 25) ELSE count(*) END AS rows
FROM parts GROUP BY root_keyword, p_name""")
def landing_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts land by root; then red ones above size 25 land again and replace their roots."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name", "p_size"))
    rows = part.withColumn("root_keyword", F.lower(F.concat_ws(" ", "p_brand", "p_type", "p_name")))
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/landing-{uuid.uuid4().hex}"
    landing.land(rows, path, BUCKETS)
    return landing.land(rows.where("p_name LIKE 'red %' AND p_size > 25"), path, BUCKETS).select("bucket", "root_keyword", "rows")


_STATE = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 1 END"


@query("run_ledger", f"""
WITH steps AS (
  SELECT 'user ' || user_id AS root_keyword, event_id // 4000 AS epoch, {_STATE} AS step, CAST(floor(value) AS BIGINT) % 3 AS rows FROM events),
furthest AS (SELECT root_keyword, max({{'epoch': epoch, 'step': step, 'rows': rows}}) AS f FROM steps GROUP BY root_keyword)
SELECT root_keyword, f.epoch AS epoch, ['landed', 'exported', 'cleared'][f.step] AS state, f.rows AS rows, f.step <> 3 AND f.rows > 0 AS done
FROM furthest""")
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event moves a user's run on; they come in four batches, the last first, and one batch comes twice."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    state = F.when(F.col("event_type").isin("click", "purchase"), ledger.EXPORTED).when(F.col("event_type") == "error", ledger.CLEARED).otherwise(ledger.LANDED)
    steps = events.select(
        "event_id", F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("root_keyword"), F.expr("event_id div 4000").alias("epoch"),
        state.alias("state"), (F.floor("value").cast("bigint") % 3).alias("rows"))
    known = steps.where("event_id % 4 = 3")
    for batch in (2, 0, 2, 1):
        known = ledger.fold(known, steps.where(F.col("event_id") % 4 == batch))
    return known.withColumn("done", ledger.is_done())


_ATTEMPTS = """
attempts AS (
  SELECT event_id // 5 AS request, CAST(event_id % 5 + 1 AS INTEGER) AS attempt,
         CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 WHEN 'click' THEN 429 WHEN 'view' THEN 301 ELSE 200 END AS status FROM events),
made AS (SELECT * FROM attempts WHERE attempt <= request % 5)"""


@query("next_attempts", f"""
WITH {_ATTEMPTS},
known AS (
  SELECT request, min(attempt) FILTER (status < 400 AND attempt <= 3) AS best, max(attempt) AS used FROM made GROUP BY request)
SELECT 'r' || a.request AS request_id, CAST(coalesce(any_value(used), 0) + 1 AS INTEGER) AS attempt,
       CAST(CASE WHEN any_value(used) IS NULL THEN 0 ELSE 2 ** any_value(used) END AS INTEGER) AS wait_s
FROM attempts a LEFT JOIN known k ON a.request = k.request GROUP BY a.request
HAVING any_value(best) IS NULL AND coalesce(any_value(used), 0) < 3""")
def next_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five consecutive events are the attempts of a request, of which some were made. They come in three batches."""
    status = F.create_map(*[F.lit(x) for x in ("error", 500, "signup", 404, "click", 429, "view", 301)])
    events = spread(table(spark, sf_dir, "events").select("event_id", "event_type"))
    every = events.select(
        "event_id", F.expr("event_id div 5").alias("request"), (F.col("event_id") % 5 + 1).cast("int").alias("attempt"),
        F.coalesce(status[F.col("event_type")], F.lit(200)).alias("status"),
    ).withColumn("request_id", F.concat(F.lit("r"), F.col("request").cast("string")))
    made, known = every.where("attempt <= request % 5"), None
    for batch in (2, 0, 1):
        state = attempts.state(made.where(F.col("event_id") % 3 == batch))
        known = state if known is None else attempts.merge(known, state)
    return attempts.next_attempts(every.select("request_id").distinct(), known)


_MODS = "['price','for warehouse','industrial','heavy duty','electric','hydraulic','specification','supplier']"
_HOST = "'https://{n}.' || replace(replace(root_keyword, ' ', '-'), '#', '') || '.example'"


@query("frontier_generations", f"""WITH {ROOTS_SQL},
issued AS (
  SELECT 0 AS generation, root_keyword, 'amazon' AS channel, 'suggest' AS endpoint, 0 AS query_ord, root_keyword AS query,
         'https://completion.amazon.com/api/2017/suggestions' AS url, 50331648 AS place FROM roots
  UNION ALL SELECT 0, root_keyword, 'amazon', 'suggest_ext', i - 1, root_keyword || ' ' || {_MODS}[i],
         'https://completion.amazon.com/api/2017/suggestions', 50462720 FROM roots, range(1, 9) AS n(i)
  UNION ALL SELECT 0, root_keyword, 'competitor', 'discovery', 0, root_keyword || ' manufacturer supplier', 'https://www.google.com/search', 117440512 FROM roots
  UNION ALL SELECT 1, root_keyword, 'amazon', 'suggest_legacy', 0, root_keyword, 'https://completion.amazon.com/search/complete', 50397184
         FROM roots WHERE length(root_keyword) % 2 = 1
  UNION ALL SELECT 1, root_keyword, 'competitor', 'page', 0, root_keyword, {_HOST.format(n='one')} || '/p', 117506048 FROM roots
  UNION ALL SELECT 1, root_keyword, 'competitor', 'page', 1, root_keyword, {_HOST.format(n='two')} || '/q', 117506048 FROM roots)
SELECT CAST(generation AS INTEGER) AS generation, concat_ws('/', channel, endpoint, query_ord, root_keyword) AS request_id, root_keyword, channel,
       endpoint, CAST(query_ord AS INTEGER) AS query_ord, query, url, CAST(place + query_ord AS BIGINT) AS seq FROM issued""")
def frontier_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages name two hosts for each root, one of them twice, beside skipped ones; every other primary answer is unreadable."""
    def host(n: str):
        return F.concat(F.lit(f"https://{n}."), F.replace(F.replace("root_keyword", F.lit(" "), F.lit("-")), F.lit("#"), F.lit("")), F.lit(".example"))

    page = ('<div class="g"><h3>x</h3><a href="%s/p">a</a><a href="https://www.google.com/y">s</a></div>'
            '<a href="https://outside.example/">o</a><div class="tF2Cxc"><a href="%s/z">b</a><a href="%s/q">c</a></div>')

    def answer(requests: DataFrame) -> DataFrame:
        found = F.format_string(page, host("one"), host("one"), host("two"))
        suggested = F.when(F.length("root_keyword") % 2 == 0, '{"suggestions": []}').otherwise("<html>")
        body = F.when(F.col("endpoint") == "discovery", found).when(F.col("endpoint") == "page", "<title>t</title>").otherwise(suggested)
        return requests.select(
            "request_id", "root_keyword", "channel", "endpoint", "query", "url", "attempt", F.lit(200).alias("status"), "seq", body.alias("body"))

    switches = {s: s in ("amazon_suggest", "competitor") for s in rules.DEFAULT_SWITCHES}
    return crawl.generations(roots(spark, sf_dir), answer, switches=switches)[0].select(
        "generation", "request_id", "root_keyword", "channel", "endpoint", "query_ord", "query", "url", "seq")


_Q = QUOTED.format(x="query")


# The parameters of each endpoint, stated again independently of the library's.
@query("request_params", f"""WITH {ROOTS_SQL}, forms(channel, endpoint, query, base, before, after) AS (VALUES
  ('google', 'suggest', '%', 'https://suggestqueries.google.com/complete/search', '?client=firefox&q=', '&hl=en'),
  ('google', 'serp', '%', 'https://www.google.com/search', '?q=', '&hl=en&gl=us&num=10'),
  ('bing', 'suggest', '%', 'https://api.bing.com/osjson.aspx', '?query=', '&form=OSJRLH'),
  ('bing', 'serp', '%', 'https://www.bing.com/search', '?q=', '&count=10&setlang=en'),
  ('youtube', 'suggest', '%', 'https://suggestqueries.google.com/complete/search', '?client=youtube&q=', '&hl=en&ds=yt'),
  ('youtube', 'serp', '%', 'https://www.youtube.com/results', '?search_query=', ''),
  ('amazon', 'suggest', '%', 'https://completion.amazon.com/api/2017/suggestions', '?session-id=000-0000000-0000000&customer-id=&request-id=auto'
     || '&page-type=Search&lop=en_US&site-variant=desktop&client-info=amazon-search-ui&mid=ATVPDKIKX0DER&alias=aps&b2b=0&fresh=0&ks=80&prefix=',
     '&event=onKeyPress&limit=11&fb=1&suggestion-type=KEYWORD&_=1'),
  ('alibaba', 'suggest', '%', 'https://www.alibaba.com/search/suggest_new', '?keyword=', '&country=US&lang=en'),
  ('alibaba', 'search', '%', 'https://www.alibaba.com/trade/search', '?fsb=y&IndexArea=product_en&keywords=', '&tab=all&page=1'),
  ('forum', 'reddit', '%', 'https://www.reddit.com/search.json', '?q=', '&sort=relevance&t=all&limit=25&type=link'),
  ('forum', 'quora', 'site:quora.com %', 'https://www.google.com/search', '?q=', '&hl=en&num=10'),
  ('competitor', 'discovery', '% manufacturer supplier', 'https://www.google.com/search', '?q=', '&hl=en&gl=us&num=10')),
asked AS (SELECT root_keyword, channel, endpoint, replace(forms.query, '%', root_keyword) AS query, base, before, after FROM roots, forms)
SELECT root_keyword, channel, endpoint, base || before || {_Q} || after AS request_url, len(string_split(before || after, '=')) - 1 AS n_params
FROM asked""")
def request_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole urls of the root and result page requests that have parameters, and their number."""
    found = roots(spark, sf_dir)
    asked = frontier.params(frontier.expand_root(found).unionByName(frontier.expand_pages(found)))
    asked = asked.where(F.col("params").isNotNull() & (F.col("endpoint") != "subreddit"))
    return asked.select("root_keyword", "channel", "endpoint", "request_url", F.size("params").cast("bigint").alias("n_params"))


_ROOT = "lower(p_name) || ' ' || p_partkey"


@query("extract_mixed", f"""
WITH rows AS (
  SELECT p_partkey, p_partkey % 8 AS kind, {_ROOT} AS root_keyword, p_name, unnest(CASE p_partkey % 8
    WHEN 0 THEN [{{'ep': 0, 'pos': 0, 'channel': 'google', 'keyword': lower(p_name) || ' one', 'source': 'google_suggest', 'reason': ''}},
                 {{'ep': 0, 'pos': 1, 'channel': 'google', 'keyword': lower(p_name) || ' two', 'source': 'google_suggest', 'reason': ''}}]
    WHEN 1 THEN [{{'ep': 0, 'pos': 0, 'channel': 'bing', 'keyword': '', 'source': '', 'reason': 'json'}}]
    WHEN 2 THEN [{{'ep': 0, 'pos': 0, 'channel': 'amazon', 'keyword': '', 'source': '', 'reason': 'json'}},
                 {{'ep': 1, 'pos': 0, 'channel': 'amazon', 'keyword': lower(p_name) || ' legacy', 'source': 'amazon_suggest', 'reason': ''}}]
    WHEN 3 THEN [{{'ep': 0, 'pos': 0, 'channel': 'google', 'keyword': lower(p_name) || ' found', 'source': 'google_serp_title', 'reason': ''}}]
    WHEN 4 THEN [{{'ep': 0, 'pos': 0, 'channel': 'competitor', 'keyword': '', 'source': '', 'reason': 'html'}}]
    WHEN 5 THEN [{{'ep': 0, 'pos': 0, 'channel': 'youtube', 'keyword': '', 'source': '', 'reason': 'unrouted'}}]
    WHEN 6 THEN [{{'ep': 0, 'pos': 0, 'channel': 'madeinchina', 'keyword': lower(p_name) || ' first', 'source': 'madeinchina_product_title', 'reason': ''}},
                 {{'ep': 1, 'pos': 0, 'channel': 'madeinchina', 'keyword': lower(p_name) || ' second', 'source': 'madeinchina_product_title', 'reason': ''}}]
    ELSE [{{'ep': 0, 'pos': 0, 'channel': 'alibaba', 'keyword': lower(p_name) || ' oem', 'source': 'alibaba_suggest', 'reason': ''}}] END) AS r FROM part)
SELECT CASE WHEN r.reason = '' THEN 'record' ELSE 'rejected' END AS kind, root_keyword, r.channel AS channel,
       (CAST(p_partkey AS BIGINT) * 2 + r.ep) * 67108864 + r.pos AS seq, r.keyword AS keyword, r.source AS source, r.reason AS reason FROM rows""")
def extract_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's number decides which answers it has. Every first attempt of Alibaba failed; its products page is not needed."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"))

    def one(kind: int, n: int, channel: str, endpoint: str, body: str | None, attempt: int = 1, status: int = 200):
        text = F.lit(None).cast("string") if body is None else F.replace(F.lit(body), F.lit("@"), F.col("p_name"))
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(n).alias("n"), F.lit(channel).alias("channel"), F.lit(endpoint).alias("endpoint"),
            text.alias("body"), F.lit(attempt).alias("attempt"), F.lit(status).alias("status"))

    calls = F.array(
        one(0, 0, "google", "suggest", '["q",["@ one","@ two"]]'), one(1, 0, "bing", "suggest", '["q",["@ cut'),
        one(2, 0, "amazon", "suggest", "<html>@</html>"), one(2, 1, "amazon", "suggest_legacy", '["q",["@ legacy"]]'),
        one(3, 0, "google", "serp", '<div class="g"><h3>@ found</h3></div>'), one(4, 0, "competitor", "page", None),
        one(5, 0, "youtube", "shorts", "[]"), one(6, 0, "madeinchina", "search", '<h2 class="product-name">@ first</h2>'),
        one(6, 1, "madeinchina", "search_page2", '<h2 class="product-name">@ second</h2>'),
        one(7, 0, "alibaba", "suggest", '{"result":{"list":[{"keyword":"no"}]}}', 1, 503),
        one(7, 0, "alibaba", "suggest", '{"result":{"list":[{"keyword":"@ oem"}]}}', 2),
        one(7, 1, "alibaba", "products", '<h2 class="search-card-e-title">@ unused</h2>'))
    root = F.concat_ws(" ", F.lower("p_name"), F.col("p_partkey").cast("string"))
    made = part.select("p_partkey", root.alias("root_keyword"), F.inline(F.filter(calls, lambda c: c["kind"] == F.col("p_partkey") % 8)))
    answers = made.select(
        F.concat_ws("/", "channel", "endpoint", "root_keyword").alias("request_id"), "root_keyword", "channel", "endpoint", F.lit("").alias("url"),
        "attempt", "status", (F.col("p_partkey").cast("bigint") * 2 + F.col("n")).alias("seq"), "body",
        F.lit(COLLECTED_AT).cast("timestamp_ntz").alias("collected_at"))
    found = extract(cut_lineage(answers))
    columns = ["kind", "root_keyword", "channel", "seq", "keyword", "source", "reason"]
    records = found.records.withColumn("kind", F.lit("record")).withColumn("reason", F.lit("")).select(*columns)
    rejected = found.rejected.withColumn("kind", F.lit("rejected")).withColumn("keyword", F.lit("")).withColumn("source", F.lit(""))
    return records.unionByName(rejected.select(*columns))


@query("classify_roots", f"""WITH {s.clean_cte()},
heads AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS one, CAST(p_partkey AS VARCHAR) AS two FROM part),
root_words AS (SELECT one AS word FROM heads UNION SELECT two FROM heads),
words AS (SELECT DISTINCT keyword, translate(keyword, 'ſı', 'si') AS m FROM cleaned),
core AS (
  SELECT DISTINCT keyword FROM words JOIN heads ON {s.n_words('keyword')} <= 3 AND contains(keyword, one) AND contains(keyword, two)),
shares AS (SELECT DISTINCT keyword FROM (SELECT keyword, unnest(string_split(keyword, ' ')) AS word FROM words) JOIN root_words USING (word))
SELECT keyword, CASE WHEN {s.is_low_first('m')} THEN 'Low Intent / Negative Keyword' WHEN keyword IN (FROM core) THEN 'Core Product Keyword'
  ELSE coalesce({s.rule_case('m')}, CASE WHEN {s.n_words('keyword')} >= 4 THEN 'Long Tail Keyword'
    WHEN keyword IN (FROM shares) THEN 'Core Product Keyword' ELSE 'Industrial Keyword' END) END AS keyword_type
FROM words""")
def classify_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different keyword against one root per part: the second word of its name and its number."""
    part = table(spark, sf_dir, "part").select("p_name", "p_partkey")
    given = part.select(F.concat_ws(" ", F.split("p_name", " ")[1], F.col("p_partkey").cast("string")).alias("root_keyword"))
    return root_table.classify(cut_lineage(clean(records(spark, sf_dir).select(*NARROW)).select("keyword").distinct()), given)


@query("clean_incremental", f"WITH {s.clean_cte()} SELECT {RECORD} FROM cleaned")
def clean_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of records, the last first and one of them twice."""
    every = records(spark, sf_dir)
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/cleaned-{uuid.uuid4().hex}"
    cleaned = CleanedTable(spark, path, every.schema, BUCKETS)
    for batch in (2, 0, 2, 1):
        cleaned.add(every.where(F.col("seq") % 3 == batch))
    return cleaned.keywords()


@query("export_positions", f"""WITH {s.labelled_cte()}
SELECT root_keyword, keyword, keyword_type, commercial_value, row_number() OVER (
  ORDER BY CASE commercial_value WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, keyword_type, keyword, root_keyword) AS position
FROM labelled WHERE keyword_type <> 'Low Intent / Negative Keyword'""")
def export_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of every keyword in the ordered export of the final map."""
    final = final_keyword_map(analyze(records(spark, sf_dir).select(*NARROW)), sort=False)
    wanted = final.select("root_keyword", "keyword", "keyword_type", "commercial_value")
    return with_positions(wanted, *map_order())


@query("cluster_limits", f"""WITH {s.labelled_cte()}
SELECT root_keyword, rows, CAST(CASE WHEN rows < 3 THEN 1 ELSE least(20, rows - 1, 50) END AS INTEGER) AS clusters,
       CAST(CASE WHEN rows < 3 THEN 0 ELSE least(50, rows - 1, least(20, rows - 1, 50)) END AS INTEGER) AS components
FROM (SELECT CASE WHEN length(keyword) % 7 = 0 THEN keyword ELSE root_keyword END AS root_keyword, count(*) AS rows FROM labelled GROUP BY ALL)""")
def cluster_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every root's numbers of clusters and components; keywords of some lengths are small roots of their own."""
    root = F.when(F.length("keyword") % 7 == 0, F.col("keyword")).otherwise(F.col("root_keyword"))
    return clusters.limits(analyze(records(spark, sf_dir).select(*NARROW)).withColumn("root_keyword", root))


def _cell(text: str) -> str:
    return f"""CASE WHEN {text} = '' THEN '' WHEN regexp_matches({text}, '[",\\n]') THEN '"' || replace({text}, '"', '""') || '"' ELSE {text} END"""


@query("csv_lines", f"""
WITH rows AS (
  SELECT lower(p_brand || ' ' || p_name) AS root_keyword,
         CASE p_partkey % 4 WHEN 0 THEN 'say "' || p_name || '", ' || p_brand WHEN 1 THEN p_name || ', ' || p_type WHEN 2 THEN ' ' || p_name || ' ' ELSE '' END AS title,
         p_name AS keyword FROM part)
SELECT root_keyword, replace(root_keyword, ' ', '-') AS slug,
       concat_ws(',', keyword, root_keyword, 'google_suggest', 'google', '', '', '', '', {_cell('title')}, '', '', 'en', 'US', '2024-01-01T00:00:00', '', '') AS line
FROM rows""")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the CSV exports with quotes, commas, blanks at the ends and empty cells."""
    name, kind = F.col("p_name"), F.col("p_partkey") % 4
    title = F.when(kind == 0, F.concat(F.lit('say "'), name, F.lit('", '), "p_brand")).when(kind == 1, F.concat_ws(", ", name, "p_type")).when(
        kind == 2, F.concat(F.lit(" "), name, F.lit(" "))).otherwise("")
    rows = table(spark, sf_dir, "part").select(
        name.alias("keyword"), F.lower(F.concat_ws(" ", "p_brand", name)).alias("root_keyword"), F.lit("google_suggest").alias("source"),
        F.lit("google").alias("channel"), title.alias("title"), F.lit(rules.LANGUAGE).alias("language"), F.lit(rules.COUNTRY).alias("country"),
        F.lit(COLLECTED_AT).cast("timestamp_ntz").alias("collected_at"))
    return files.csv_lines(rows)
