import json

import pytest
from pyspark.sql import functions as F

from lexmine.plans.collection import extract_all
from lexmine.sources import forums, frontier, markets, results, suggest, webpages
from lexmine.sources.dom import elements, first, is_a, select, texts, within
from lexmine.sources.responses import quarantine, resolve
from lexmine.sources.trends import trend_records
from tests.helpers import found, response, responses


def outline(spark, page, wanted=None):
    df = spark.createDataFrame([(page,)], "body string").select(elements(F.col("body"), wanted).alias("els"))
    return df.first().els


def test_text_is_stripped_and_joined(spark):
    els = outline(spark, '<h1>A <b>B</b>\n</h1><p class="x  y">C<!-- c -->D<br>E &amp; F&nbsp;</p><p>open')
    assert [(e.tag, e.text) for e in els] == [("h1", "AB"), ("b", "B"), ("p", "CDE & F"), ("br", ""), ("p", "open")]
    assert els[2].classes == ["x", "y"]


def test_nesting_intervals_and_stray_tags(spark):
    els = outline(spark, "<div><p><b>x<br><p>y</div></b></i><span>z</span>")
    assert [(e.tag, e.ord, e.last) for e in els] == [
        ("div", 0, 4), ("p", 1, 4), ("b", 2, 4), ("br", 3, 3), ("p", 4, 4), ("span", 5, 5)]
    assert els[0].text == "xy"


def test_script_text_counts_for_itself_only(spark):
    els = outline(spark, "<div>a<script>if (a < b) {}</script><style>p{}</style></div>")
    assert [(e.tag, e.text) for e in els] == [("div", "a"), ("script", "if (a < b) {}"), ("style", "p{}")]


def test_wanted_elements_only(spark):
    els = outline(spark, '<div class="g"><a>1</a><a href="/x">2</a></div>', [("a", None, "href")])
    assert [(e.tag, e.text, e.attrs["href"]) for e in els] == [("a", "2", "/x")]
    assert outline(spark, None) is None


def test_suggest_array(spark):
    rows = responses(
        spark,
        response("google", "suggest", '["q",["Big Lift","b","two & x"]]', seq=0),
        response("google", "suggest", '["q"]', seq=1),
        response("google", "suggest", '["q",["good",5,"lost"]]', seq=2),
        response("google", "suggest", "{broken", seq=3),
        response("google", "suggest_alpha", '["q",["alpha"]]', seq=4),
    )
    assert found(suggest.google_suggestions(rows), "keyword", "source", "url") == [
        ("big lift", "google_suggest", "https://www.google.com/search?q=Big+Lift"),
        ("two & x", "google_suggest", "https://www.google.com/search?q=two+%26+x"),
        ("good", "google_suggest", "https://www.google.com/search?q=good"),
        ("alpha", "google_suggest_alpha", ""),
    ]
    assert [r.seq for r in quarantine(rows).collect()] == [3]


def test_suggest_jsonp(spark):
    body = 'cb(["q",[["aa",0,[1]],"bb",3,["cc",1],[["x"],1]],{}])'
    rows = responses(spark, response("youtube", "suggest", body), response("youtube", "suggest_ext", "no list", seq=1))
    assert found(suggest.youtube_suggestions(rows)) == [(k, "youtube_suggest") for k in ("aa", "bb", "cc")]


def test_amazon_fallback(spark):
    good, bad = '{"suggestions":[{"value":"aa"},{"value":""},{}]}', "<html>"
    rows = responses(
        spark,
        response("amazon", "suggest", good, root="r1"), response("amazon", "suggest_legacy", '["q",["no"]]', root="r1"),
        response("amazon", "suggest", bad, root="r2"), response("amazon", "suggest_legacy", '["q",["bb"]]', root="r2"),
        response("amazon", "suggest_legacy", '["q",["cc"]]', root="r3"),
    )
    got = sorted((r.root_keyword, r.keyword) for r in suggest.amazon_suggestions(rows).collect())
    assert got == [("r1", "aa"), ("r2", "bb"), ("r3", "cc")]


def test_alibaba_fallback_needs_an_unreadable_answer(spark):
    page = '<h2 class="search-card-e-title">T1</h2><h2 class="organic-gallery-title__outter">T2</h2>'
    rows = responses(
        spark,
        response("alibaba", "suggest", '{"result":{"list":[{"keyword":"aa"}]}}', root="r1"), response("alibaba", "products", page, root="r1"),
        response("alibaba", "suggest", "<html>", root="r2"), response("alibaba", "products", page, root="r2"),
        response("alibaba", "products", page, root="r3"),
    )
    assert found(suggest.alibaba_suggestions(rows)) == [("aa", "alibaba_suggest")]
    assert [(r.root_keyword, r.keyword) for r in markets.alibaba_fallback_titles(rows).orderBy("seq").collect()] == [
        ("r2", "t1"), ("r2", "t2")]


def links(*texts):
    return "".join(f'<a href="/search?q=x">{t}</a>' for t in texts)


def spans(*texts):
    return "".join(f"<span>{t}</span>" for t in texts)


def test_related_and_questions_at_their_limits(spark):
    page = (
        '<div class="s75CSd">abc</div><div class="s75CSd">abcd</div><div data-initq="1">abcd</div>'
        + links("wxyz", "vwxyz", "l" * 99, "m" * 100, "vwxyz")
        + '<div data-q="1">is it?</div><div data-q="1">plain</div>'
        + spans("scissor 9?", "scissor 10?", "scissor" + "n" * 191 + "?", "scissor" + "n" * 192 + "?", "other words?")
    )
    got = found(results.google_results(responses(spark, response("google", "serp", page))))
    assert got == [
        ("abcd", "google_related_search"), ("vwxyz", "google_related_search"), ("l" * 99, "google_related_search"),
        ("is it?", "google_paa"), ("scissor 10?", "google_paa"), ("scissor" + "n" * 191 + "?", "google_paa")]


def test_organic_blocks(spark):
    page = (
        '<div class="g"><div class="tF2Cxc"><a>x</a><a href="/u">y</a><h3>One</h3><div class="VwiC3b">D</div></div></div>'
        '<div class="g"><span class="aCOpRe">no title</span></div>'
    )
    rows = results.google_results(responses(spark, response("google", "serp", page)))
    assert found(rows, "title", "description", "url") == [("One", "D", "/u")] * 2


def test_bing_page(spark):
    page = (
        '<li class="b_algo"><h2><a href="/1">Title</a></h2><div class="b_caption"><p>D</p></div></li>'
        '<li class="b_algo"><h2>none</h2></li><li class="b_rs"><div class="b_rs"><a>Related</a></div></li>'
    )
    rows = results.bing_results(responses(spark, response("bing", "serp", page)))
    assert found(rows, "keyword", "source", "description", "url") == [
        ("title", "bing_serp_title", "D", "/1"), ("related", "bing_related", "", "")]


def test_video_data(spark):
    def page(contents):
        data = {"contents": {"twoColumnSearchResultsRenderer": {"primaryContents": {"sectionListRenderer": {"contents": contents}}}}}
        return f"<script>var ytInitialData = {json.dumps(data)};</script>"

    video = {"videoRenderer": {"videoId": "v1", "title": {"runs": [{"text": "Big "}, {"text": "lift"}]}}}
    good = page([{"itemSectionRenderer": {"contents": [video, {"adRenderer": {}}]}}, {"other": {}}])
    rows = responses(spark, response("youtube", "serp", good), response("youtube", "serp", "var ytInitialData = {};</script>", seq=1))
    assert found(results.youtube_results(rows), "keyword", "url") == [("big lift", "https://www.youtube.com/watch?v=v1")]


def test_alibaba_page_counts_each_place(spark):
    page = (
        '<h2 class="organic-gallery-title__outter search-card-e-title">Double</h2><h2 class="search-card-e-title">12345</h2>'
        '<script type="application/json">[{"name":"N1"},{"x":1},{"name":""}]</script>'
        '<script type="application/json">{"name":"N2"}</script><script type="application/json">{oops</script>'
    )
    got = found(markets.alibaba_titles(responses(spark, response("alibaba", "search", page))))
    assert got == [("double", "alibaba_product_title")] * 2 + [("n1", "alibaba_jsonld"), ("n2", "alibaba_jsonld")]


def test_madeinchina_second_page_needs_the_first(spark):
    page1 = '<h2 class="product-name">Engine one</h2><div class="hot-search"><a>hot</a></div><ul class="category-list"><a>abc</a><a>abcd</a></ul>'
    page2 = '<a class="title">Engine two</a><div class="hot-search"><a>not read</a></div>'
    rows = responses(
        spark, response("madeinchina", "search", page1, url="u1"), response("madeinchina", "search_page2", page2, seq=1, url="u2"),
        response("madeinchina", "search_page2", page2, root="lost", seq=2),
    )
    assert found(markets.madeinchina_titles(rows), "keyword", "source", "url") == [
        ("engine one", "madeinchina_product_title", "u1"), ("hot", "madeinchina_related", ""),
        ("abcd", "madeinchina_category", ""), ("engine two", "madeinchina_product_title", "")]


def test_forum_posts(spark):
    post = {"data": {"children": [{"data": {"title": "T", "selftext": "x" * 250 + ". Is this a question? No.", "url": "u"}},
                                  {"data": {"title": "Two words", "selftext": "short?"}}]}}
    rows = responses(spark, response("forum", "reddit", json.dumps(post)))
    strict = forums.reddit_posts(rows)
    assert found(strict, "keyword", "description") == [("two words", "short?")]
    loose = forums.reddit_posts(rows, strict=False)
    assert found(loose) == [("is this a question", "reddit_question"), ("two words", "reddit_post_title")]
    body = '{"data":{"children":[{"data":{"title":"Sub title"}}]}}'
    url = "https://www.reddit.com/r/logistics/search.json"
    subs = responses(
        spark, response("forum", "reddit", "not json"), response("forum", "subreddit", body, seq=1, url=url),
        response("forum", "subreddit", body, root="lost", seq=2, url=url),
    )
    assert found(forums.subreddit_posts(subs)) == [("sub title", "reddit_logistics")]


def test_quora_needs_its_host(spark):
    page = ('<div class="g"><h3>Yes</h3><a href="https://www.Quora.com/q">l</a></div>'
            '<div class="g"><h3>Nope</h3><a href="https://x.example">l</a></div>')
    assert found(forums.quora_questions(responses(spark, response("forum", "quora", page)))) == [("yes", "quora_question")]


def test_competitor_page(spark):
    page = (
        '<title>Ti tle</title><meta name="description" content=""><meta name="description" content="late">'
        f'<h1>A <b>B</b></h1><h2>{"h" * 99}</h2><h2>{"i" * 100}</h2>'
        '<a href="x">lif</a><a href="x">lift</a><a href="/y?q=1">' + "lift" + "z" * 75 + "</a><a href='z'>" + "lift" + "z" * 76 + "</a><a>lifts</a>"
    )
    rows = webpages.page_records(responses(spark, response("competitor", "page", page, url="https://h.example/big-lift/a_b")))
    assert found(rows, "keyword", "source", "url") == [
        ("ti tle", "competitor:h.example", "https://h.example/big-lift/a_b"),
        ("ab", "competitor:h.example:h1", "https://h.example/big-lift/a_b"),
        ("h" * 99, "competitor:h.example:h2", "https://h.example/big-lift/a_b"),
        ("big lift a b", "competitor:h.example:url_slug", "https://h.example/big-lift/a_b"),
        ("lift", "competitor:h.example:anchor", "https://h.example/big-lift/x"),
        ("lift" + "z" * 75, "competitor:h.example:anchor", "https://h.example/y?q=1"),
    ]


def test_discovery_takes_the_first_five_hosts(spark):
    hosts = ["www.google.com", "a.example", "a.example", "b.example", "c.example", "d.example", "e.example", "f.example"]
    page = '<a href="https://outside.example">x</a><div class="g">' + "".join(f'<a href="https://{h}/{i}">l</a>' for i, h in enumerate(hosts)) + "</div>"
    rows = webpages.discovered(responses(spark, response("competitor", "discovery", page))).orderBy("query_ord").collect()
    assert [r.url for r in rows] == ["https://a.example/1", "https://b.example/3", "https://c.example/4", "https://d.example/5", "https://e.example/6"]


def test_attempts(spark):
    def tries(root, *statuses):
        return [response("google", "suggest", f"b{i}", root=root, attempt=i + 1, status=s) for i, s in enumerate(statuses)]

    rows = responses(spark, *tries("r1", 500, 200), *tries("r2", 404, 404, 404), *tries("r3", 500, 500, 500, 200), *tries("r4", 200, 200))
    got = sorted((r.root_keyword, r.attempt, r.body) for r in resolve(rows).collect())
    assert got == [("r1", 2, "b1"), ("r4", 1, "b0")]


def test_trends(spark):
    rows = [("r", "topic", "top", 0, "T"), ("r", "query", "rising", 0, " Q2 "), ("r", "query", "top", 0, "Q1"), ("r", "query", "top", 1, " "), ("r", "query", "other", 0, "no")]
    rows = [(*r[:4], r[4] + "x" if r[4].strip() else r[4]) for r in rows]
    df = trend_records(spark.createDataFrame(rows, "root_keyword string, kind string, rank_type string, ord int, text string"))
    assert found(df) == [("q1x", "google_trends_top"), ("q2 x", "google_trends_rising"), ("tx", "google_trends_topic_top")]


def test_roots_and_frontier(spark):
    lines = spark.createDataFrame([(0, "Scissor Lift, crane ,"), (1, "CRANE"), (2, " ")], "n int, line string")
    roots = frontier.roots_normalize(lines, "line", "n").orderBy("n", "position")
    assert [r.root_keyword for r in roots.collect()] == ["scissor lift", "crane"]
    one = roots.where("root_keyword = 'crane'").select("root_keyword")
    every = frontier.frontier(one)
    assert every.count() == 6 + 26 + 54 + 15 and every.select("seq").distinct().count() == every.count()
    assert every.select("request_id").distinct().count() == every.count()
    domains = frontier.frontier(one, domains=["d.example"])
    assert domains.where("channel = 'competitor'").count() == 2 and frontier.expand_domains(one, []).count() == 0
    off = frontier.frontier(one, switches={"reddit": False, "google_serp": False})
    assert off.where("channel = 'forum'").count() == 0 and off.where("endpoint = 'serp' and channel = 'google'").count() == 1
    assert frontier.channel_filter(every).where("endpoint = 'quora'").count() == 1
    assert frontier.channel_filter(every, strict=True).where("endpoint = 'quora'").count() == 0
    assert frontier.pending(every, one).count() == 0


def test_pages_are_parsed_once(spark):
    rows = results.google_results(responses(spark, response("google", "serp", "<p>")))
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_extract_all_and_bad_payloads(spark):
    rows = [response(c, e, "{bad <", seq=i) for i, (c, e) in enumerate([
        ("google", "suggest"), ("google", "serp"), ("bing", "suggest"), ("youtube", "serp"), ("amazon", "suggest"),
        ("alibaba", "suggest"), ("forum", "reddit")])]
    rows.append(response("bing", "suggest", '["q",["fine"]]', seq=9))
    assert found(extract_all(responses(spark, *rows))) == [("fine", "bing_suggest")]


def test_selectors_look_inside_nested_elements(spark):
    nav, link, box = is_a("nav"), is_a("a"), is_a("div", cls="b")
    page = '<a>0</a><nav><div class="b"><a>1</a></div><nav><a>2</a></nav></nav><div class="b"><p><a>3</a></div><a>4</a>'
    df = spark.createDataFrame([(page,)], "body string")
    els = elements(F.col("body"), [w for t in (nav, link, box) for w in t.wanted])
    row = df.select(els.alias("els")).select(
        texts(select(F.col("els"), within(F.col("els"), nav, link))).alias("in_nav"),
        F.transform(select(F.col("els"), box), lambda b: first(F.col("els"), link, b)["text"]).alias("in_box"),
        F.transform(select(F.col("els"), nav), lambda b: first(F.col("els"), box, b)["text"]).alias("boxes"),
    ).first()
    assert row.in_nav == ["1", "2"] and row.in_box == ["1", "3"] and row.boxes == ["1", None]
