import pytest
from pyspark.sql import functions as F

from lexmine import rules
from lexmine.operators import labels
from lexmine.operators.cleaning import clean, merge_duplicates
from lexmine.plans.analysis import analyze, final_keyword_map
from tests.helpers import found, keyword_frame

TYPES = [
    ("scissor lift", rules.CORE), ("lift scissor parts", rules.CORE), ("used scissor lift", rules.LOW_INTENT),
    ("scissor lift manufacturer", rules.CORE), ("hydraulic scissor lift manufacturer", rules.SUPPLIER),
    ("scissor lift table manufacturers", rules.LONG_TAIL), ("jig fixture", rules.PROBLEM),
    ("heavy duty platform", rules.APPLICATION), ("heavy-duty platform", rules.INDUSTRIAL), ("lift", rules.CORE),
    ("widget", rules.INDUSTRIAL), ("brand new platform", rules.BRAND), ("brand owner", rules.BRAND),
    ("tailor made table", rules.CUSTOM), ("éiso chart", rules.INDUSTRIAL), ("iso chart", rules.CERTIFICATION),
    ("10mm plate", rules.SPECIFICATION), ("2 ton jack", rules.SPECIFICATION), ("mining news", rules.INDUSTRY),
    ("whyte notes", rules.PROBLEM), ("terror movie", rules.PROBLEM), ("any good?", rules.PROBLEM),
    ("vs model", rules.SPECIFICATION), ("rival firms", rules.COMPETITOR), ("a versus b", rules.COMPETITOR),
    ("pdf booklet", rules.LOW_INTENT), ("pdf manual", rules.LOW_INTENT), ("manual download", rules.SPECIFICATION),
    ("rugged case", rules.INDUSTRIAL), ("ſex rugged case notes", rules.INDUSTRIAL),
]


def test_keyword_types(spark):
    df = keyword_frame(spark, [k for k, _ in TYPES])
    kind = labels.keyword_type(F.col("keyword"), F.col("root_keyword"))
    assert found(df.withColumn("t", kind), "keyword", "t") == TYPES


def test_several_roots_and_none(spark):
    df = keyword_frame(spark, ["red lift", "cargo crane", "widget"])
    both = labels.keyword_type(F.col("keyword"), F.lit("scissor lift"), F.lit("cargo crane"))
    assert found(df.withColumn("t", both), "t") == [(rules.CORE,), (rules.CORE,), (rules.INDUSTRIAL,)]
    assert found(df.withColumn("t", labels.keyword_type(F.col("keyword"))), "t") == [(rules.INDUSTRIAL,)] * 3


@pytest.mark.parametrize("keyword, intent, value", [
    ("acme inc. usa", "Informational", "Medium"), ("foo.co.uk", "Navigational", "Low"), ("bestprice", "Transactional", "Low"),
    ("best lift", "Commercial", "Low"), ("official page", "Navigational", "Low"), ("used industrial lift", "Informational", "High"),
    ("free lift plans", "Informational", "Low"), ("how to lift", "Informational", "Medium"), ("b2b", "Informational", "High"),
])
def test_intent_and_value(spark, keyword, intent, value):
    df = keyword_frame(spark, [keyword])
    got = df.select(labels.search_intent(F.col("keyword")), labels.commercial_value(F.col("keyword"))).first()
    assert tuple(got) == (intent, value)


def test_all_page_types():
    rows = labels.page_type_rows()
    assert len(rows) == 52 and len({r[:2] for r in rows}) == 52
    pages = {r[:2]: r[2] for r in rows}
    assert {pages[(rules.BRAND, i)] for i in rules.INTENTS} == {"Blog / General Page"}
    first = {
        rules.SUPPLIER: "Supplier Landing Page", rules.CUSTOM: "Custom Order / RFQ Page", rules.SPECIFICATION: "Product Spec Page",
        rules.APPLICATION: "Application / Use-case Page", rules.INDUSTRY: "Industry Solution Page", rules.PROBLEM: "Blog / FAQ Page",
        rules.CERTIFICATION: "Certification Page", rules.LONG_TAIL: "Blog / Guide Page", rules.COMPETITOR: "Comparison Page",
        rules.INDUSTRIAL: "Industry Blog Page", rules.LOW_INTENT: "Skip / No Page Needed", rules.CORE: "Product Page",
    }
    assert {k: pages[(k, "Navigational")] for k in first} == first


def test_cleaning_filters(spark):
    dropped = ["how to", "12345", "液压升降机", "ab", "x" * 121, " ".join("abcdefghijklmnop"), "casino lift", "*** !!!!"[:3]]
    kept = ["液压 升降机", "x" * 120, " ".join("abcdefghijklmno"), "i you this", "casinos", "foo &amp; bar"]
    got = {r.keyword for r in clean(keyword_frame(spark, dropped + kept)).collect()}
    assert got == {k.replace("&amp; ", "") for k in kept}


def test_merge_keeps_first_and_all_tags(spark):
    df = keyword_frame(spark, ["a b", "c d", "a b", "a b"]).withColumn("source", F.element_at(F.array(*[F.lit(x) for x in "zyxz"]), F.col("seq").cast("int") + 1))
    df = df.withColumn("channel", F.concat(F.lit("ch"), "seq"))
    rows = {r.keyword: r for r in merge_duplicates(df).collect()}
    assert (rows["a b"].source, rows["a b"].channel, rows["a b"].seq) == ("x|z", "ch0", 0)
    both = {r.keyword: r.channel for r in merge_duplicates(df, merge_channel=True).collect()}
    assert both["a b"] == "ch0|ch2|ch3"


def test_clean_is_idempotent_and_ignores_partitioning(spark):
    df = keyword_frame(spark, ["Foo  Bar", "foo bar", "Scissor &amp; lift", "price list", "PRICE list"])
    once = sorted(map(tuple, clean(df).collect()))
    assert sorted(map(tuple, clean(clean(df)).collect())) == once
    assert sorted(map(tuple, clean(df.repartition(7)).collect())) == once


def test_regexes_run_once(spark):
    plan = analyze(keyword_frame(spark, ["a b"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("&#?") == 1 and plan.count("tailor.?made") == 1


def test_same_keyword_under_two_roots_stays_twice(spark):
    df = keyword_frame(spark, ["big lift"]).union(keyword_frame(spark, ["big lift"], root="crane"))
    assert analyze(df).count() == 2


def test_final_map_order(spark):
    words = ["zeta lift supplier", "used scissor lift", "alpha lift supplier", "plain thing", "one two three item"]
    rows = final_keyword_map(analyze(keyword_frame(spark, words))).collect()
    assert [r.keyword for r in rows] == ["alpha lift supplier", "zeta lift supplier", "one two three item", "plain thing"]
    assert final_keyword_map(analyze(keyword_frame(spark, words)), include_low=False).count() == 3
