from urllib.parse import quote_plus, urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from lexmine.functions import urls
from lexmine.functions.text import normalize, quote_plus as quoted, split_words, strip, word_count
from lexmine.operators.features import char_ngrams


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x"))).first()[0]


@pytest.mark.parametrize("raw, tidy", [
    ("Foo &amp; bar", "foo bar"),
    ("  A 　B\tC\n", "a b c"),
    ("it’s “ok” ‘x’", "it's \"ok\" ‘x'"),
    ("a\x00b\x7fc\x9fd", "abcd"),
    ("&#233;x &Eacute;y &unknown; z", "x y z"),
    ("a & b; c", "a & b; c"),
    ("Größe ÉISO", "größe éiso"),
    ("液压 升降机", "液压 升降机"),
    ("", ""),
    ("double  space", "double space"),
    ("\x1f sep \x1c", "sep"),
])
def test_normalize(spark, raw, tidy):
    assert one(spark, raw, normalize) == tidy
    assert one(spark, tidy, normalize) == tidy


@pytest.mark.parametrize("raw", [" x y ", "\x1cx\x85", " \t\r\n", "plain"])
def test_strip_is_unicode(spark, raw):
    assert one(spark, raw, strip) == raw.strip()


def test_words(spark):
    assert one(spark, " scissor \t lift ", split_words) == ["scissor", "lift"]
    assert one(spark, "", split_words) == []
    assert one(spark, "a b c", word_count) == 3


@pytest.mark.parametrize("raw", ["a b*c~d", "é/ü?&=+", "x_y-z.", "100%"])
def test_quote_plus(spark, raw):
    assert one(spark, raw, quoted) == quote_plus(raw)


LINKS = ["/a", "//h.example/x", "?q=1", "#f", "b/c", "../d", "./e", "http://o.example/z", "", "mailto:x", "../../../g",
         "a//b", "x/./y/..", "c?d=../e", "/p/../q"]
BASES = ["https://h.example/one/two/three?q=1#f", "https://h.example", "http://h.example/dir/"]


def test_url_join(spark):
    pairs = [(base, link) for base in BASES for link in LINKS]
    df = spark.createDataFrame(pairs, "base string, link string")
    got = {(r.base, r.link): r.url for r in df.withColumn("url", urls.join(F.col("base"), F.col("link"))).collect()}
    assert got == {pair: urljoin(*pair) for pair in pairs}


@pytest.mark.parametrize("url", BASES + ["https://u@h.example:8080/a b/c;p?x", "/only/path", "h.example/x"])
def test_url_parts(spark, url):
    assert one(spark, url, urls.host) == urlparse(url).netloc
    assert one(spark, url, urls.path) == urlparse(url).path


def test_ngrams_keep_to_words(spark):
    grams = one(spark, "ab c", char_ngrams)
    assert sorted(grams) == sorted([" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "])
