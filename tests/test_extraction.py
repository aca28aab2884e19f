"""One pass over mixed responses: the same records as the channels' own extractors, and what was rejected."""

from functools import reduce

from lexmine.plans.collection import ROUTES, extract, extract_all, route
from lexmine.sources import forums, markets, results, suggest, webpages
from lexmine.sources.responses import resolve
from tests.helpers import response, responses

EACH = [
    suggest.google_suggestions, results.google_results, suggest.bing_suggestions, results.bing_results, suggest.youtube_suggestions,
    results.youtube_results, suggest.amazon_suggestions, suggest.alibaba_suggestions, markets.alibaba_fallback_titles, markets.alibaba_titles,
    markets.madeinchina_titles, forums.reddit_posts, forums.subreddit_posts, forums.quora_questions, webpages.page_records,
]
COLUMNS = ["root_keyword", "seq", "keyword", "source", "channel", "title", "description", "url"]

GOOGLE = ('<div class="s75CSd">related one</div><div class="related-question-pair">What is it?</div><div class="g"><h3>Title</h3>'
          '<div class="VwiC3b">Text</div><a href="https://www.quora.com/x">l</a></div><a href="/search?q=b">linked search</a>')
BING = '<li class="b_algo"><h2><a href="/1">Bing title</a></h2><div class="b_caption"><p>D</p></div></li><li class="b_rs"><a>Related</a></li>'
VIDEO = ('var ytInitialData = {"contents":{"twoColumnSearchResultsRenderer":{"primaryContents":{"sectionListRenderer":{"contents":[{"itemSectionRenderer":'
         '{"contents":[{"videoRenderer":{"videoId":"v","title":{"runs":[{"text":"A "},{"text":"video"}]}}}]}}]}}}}};</script>')
MARKET = '<h2 class="search-card-e-title">Card title</h2><script type="application/json">{"name":"Script name"}</script>'
CHINA = '<h2 class="product-name">Engine one</h2><div class="hot-search"><a>hot</a></div><ul class="category-list"><a>abcd</a></ul>'
POSTS = '{"data":{"children":[{"data":{"title":"A post","selftext":"Is it so? Yes","url":"u"}},{"data":{"title":""}}]}}'
PAGE = ('<title>Page title</title><meta name="description" content="About it"><h1>Head</h1><h2>Sub</h2><a href="/lift">scissor lift here</a>')


def answers(root, seq, primary=True, first=True):
    amazon = '{"suggestions":[{"value":"prime"}]}' if primary else "<html>"
    alibaba = '{"result":{"list":[{"keyword":"ali"}]}}' if primary else "<html>"
    rows = [
        ("google", "suggest", '["q",["one","two"]]', ""), ("google", "suggest_alpha", '["q",["alpha"]]', ""), ("google", "suggest_modifier", '["q",["modified"]]', ""),
        ("google", "serp", GOOGLE, ""), ("bing", "suggest", '["q",["bing one"]]', ""), ("bing", "suggest_ext", '["q",["bing ext"]]', ""), ("bing", "serp", BING, ""),
        ("youtube", "suggest", 'window.x(["q",[["tube",0]]])', ""), ("youtube", "suggest_ext", 'x(["q",["tube ext"]])', ""), ("youtube", "serp", VIDEO, ""),
        ("amazon", "suggest", amazon, ""), ("amazon", "suggest_legacy", '["q",["legacy"]]', ""), ("amazon", "suggest_ext", '{"suggestions":[{"value":"ext"}]}', ""),
        ("alibaba", "suggest", alibaba, ""), ("alibaba", "products", MARKET, ""), ("alibaba", "search", MARKET, ""),
        ("madeinchina", "search_page2", CHINA, "https://m.example/2"), ("forum", "subreddit", POSTS, "https://www.reddit.com/r/logistics/search.json"),
        ("forum", "quora", GOOGLE, ""), ("competitor", "page", PAGE, "https://shop.example/scissor-lift_x"), ("competitor", "discovery", GOOGLE, ""),
    ]
    if first:
        rows += [("madeinchina", "search", CHINA, "https://m.example/1"), ("forum", "reddit", POSTS, "")]
    return [response(channel, endpoint, body, root=root, seq=seq + i, url=url) for i, (channel, endpoint, body, url) in enumerate(rows)]


def as_rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_one_pass_gives_what_each_extractor_gives(spark):
    rows = [*answers("scissor lift", 0), *answers("bad primary", 100, primary=False), *answers("second only", 200, first=False)]
    rows += [response("google", "suggest", '["q",["first try"]]', root="late", seq=300, status=503), response("google", "suggest", '["q",["second try"]]', root="late", seq=300, attempt=2)]
    captured = responses(spark, *rows)
    resolved = resolve(captured)
    want = as_rows(reduce(lambda a, b: a.unionByName(b), [each(resolved) for each in EACH]))
    assert as_rows(extract_all(captured)) == want
    routes = {k for r in ROUTES for k in r.keys}
    assert {f"{r[2]}/{r[3]}" for r in rows} - routes == {"competitor/discovery"} and routes <= {f"{r[2]}/{r[3]}" for r in rows}


def test_rejected_payloads_are_counted_and_told(spark):
    bad = [
        ("google", "suggest", "<html>", "json"), ("google", "serp", None, "html"), ("bing", "suggest", '["q",["cut', "json"), ("youtube", "suggest", "x(y)", "json"),
        ("youtube", "serp", "var ytInitialData = {x};</script>", "json"), ("amazon", "suggest", "[1]", "json"), ("alibaba", "suggest", None, "json"),
        ("forum", "reddit", "", "json"), ("competitor", "page", None, "html"), ("nobody", "nothing", "[]", "unrouted"),
    ]
    fine = [("youtube", "serp", "<html>no data</html>"), ("competitor", "discovery", None), ("bing", "suggest_ext", '["q",["Fine"]]'), ("google", "suggest_alpha", '{"a":1}')]
    rows = [response(c, e, b, seq=i) for i, (c, e, b, *_) in enumerate([*bad, *fine])]
    found = extract(responses(spark, *rows))
    told = sorted((r.channel, r.endpoint, r.reason) for r in found.rejected.collect())
    assert told == sorted((c, e, why) for c, e, _, why in bad)
    assert [r.keyword for r in found.records.collect()] == ["fine"]
    assert found.counts == {"records": 1, "rejected": len(bad)}


def test_one_scan_and_one_parse(spark, tmp_path, capsys):
    path = str(tmp_path / "responses")
    responses(spark, *answers("scissor lift", 0)).write.parquet(path)
    captured = spark.read.parquet(path)

    def scans(df):
        capsys.readouterr()
        df.explain("simple")
        plan = capsys.readouterr().out
        return plan.count("Scan parquet"), plan.count("ArrowEvalPython"), plan

    _, parses, plan = scans(route(resolve(captured)))
    # one parse in each branch of the resolution: first attempts that were good, and the best of the later ones
    assert scans(route(resolve(captured)))[0] == scans(resolve(captured))[0] and parses == 2
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    # once written, records and rejected payloads read that table alone
    found = extract(captured)
    assert "ArrowEvalPython" not in scans(found.records)[2] and path not in scans(found.rejected)[2]
