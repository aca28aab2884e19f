"""The phrases put around a product name to form the captured suggestions: input data, used by both engines."""

from __future__ import annotations

from zlib import crc32

from lexmine import rules

COLLECTED_AT = "2024-01-01 00:00:00"

_ALPHA = [("google", "google_suggest_alpha", "", c) for c in "abcdefghijklmnopqrstuvwxyz"]
# The tag of an added phrase on each channel that suggests.
_TAGS = {
    "google": "google_suggest_modifier", "bing": "bing_suggest_ext", "youtube": "youtube_suggest_ext", "amazon": "amazon_suggest_ext",
}


def _of_rules(per_rule: int = 4) -> list[tuple[str, str, str, str]]:
    """A few plain phrases of every rule, those of least checksum, each on a channel that its checksum deals it to."""
    every = [rules.LOW_INTENT_FIRST, *rules.TYPE_RULES, *rules.INTENT_RULES, *rules.VALUE_RULES]
    dealt = {}
    for rule in every:
        phrases = [p for p in (*rule.words, *rule.starts, *rule.contains, *rule.ends, *rule.dotted) if p.replace(" ", "").isalpha()]
        for phrase in sorted(set(phrases), key=lambda p: crc32(p.encode()))[:per_rule]:
            channel = list(_TAGS)[crc32(phrase[::-1].encode()) % len(_TAGS)]
            dealt[channel, phrase] = (channel, _TAGS[channel], "", phrase)
    return list(dealt.values())


# Two or more added words, so that the phrase rules are reached: (before, after).
_PAIRS = [
    ("brand new", "platform"), ("trademark", "logo sticker"), ("", "factory direct price list"),
    ("bulk supplier of", "in china"), ("cheap", "manufacturer in india"), ("custom made", "parts"),
    ("tailor-made", "with private label"), ("white label", "kit for resellers"), ("iso", "approval process"),
    ("explosion proof", "for sale"), ("ce certified", "equipment"), ("2 ton", "loading table"),
    ("10mm", "stock item"), ("5 a", "fuse box"), ("electric", "motor series"), ("manual", "download page"),
    ("heavy duty", "for port"), ("big", "for cold storage rooms"), ("heavyload", "cargo handling unit"),
    ("logistics", "company contact"), ("steel", "construction market"), ("textile", "mill news today"),
    ("how to install", "at home"), ("why is my", "so loud"), ("whyte", "and sons limited"),
    ("jig", "fixture set"), ("terror", "movie list"), ("is the", "any good?"), ("best", "versus old one"),
    ("compare", "against rival products"), ("cheaper than", "similar to original"), ("free", "pdf booklet"),
    ("used", "for sale"), ("second hand", "near me"), ("who invented", "and when"), ("rental of", "prices"),
    ("rugged", "outdoor case"), ("industrial", "grade oil"), ("professional", "high-performance tools"),
    ("official", "website login"), ("acme inc. usa", "shop"), ("foo.co.uk", "catalog"), ("my inc.x", "page"),
    ("export", "to europe today"), ("definition of", "in physics"), ("guide to", "for new owners"),
    ("latest", "news and photos"), ("bestprice", "bestprice"), ("load", "chart and speed table"),
    ("spare part", "catalog"), ("manufacturers of", "and standards"), ("einzigartige", "für größe"),
    ("éiso", "isoé chart data"), ("b2b", "import rfq"), ("casino", "night"), ("cargo", "of drug free adult"),
]

SUGGESTIONS: list[tuple[str, str, str, str]] = [
    *[(channel, f"{channel}_suggest", "", "") for channel in _TAGS],
    *_ALPHA,
    *_of_rules(),
    *[("google", "google_related_search", before, after) for before, after in _PAIRS],
]

# Titles made from the other columns; {name} is the product name. (channel, source, SQL both engines read.)
TITLES: list[tuple[str, str, str]] = [
    ("alibaba", "alibaba_product_title", "concat(cast(p_size AS {str}), ' ton ', p_name, ' ', p_type)"),
    ("madeinchina", "madeinchina_product_title", "concat(p_brand, ' ', p_name, ' ', p_type)"),
    ("youtube", "youtube_serp",
     "concat(p_name, ' &amp;  ', p_type, ' “', p_brand, '” review’s', chr(9), cast(p_size AS {str}), 'mm&#39;')"),
    ("google", "google_serp_title",
     "concat('How to fix ', p_brand, ' ', p_name, ' error ', cast(p_size AS {str}), '?')"),
    ("competitor", "competitor:www.example.com:anchor", "concat(p_type, ' ', p_name, ' official site')"),
    ("bing", "bing_serp_title", "cast(p_partkey AS {str})"),
    ("bing", "bing_related", "concat('***', chr(7), '!!!')"),
    ("google", "google_paa", "concat('How', chr(160), ' to')"),
    ("forum", "reddit_post_title",
     "concat('is it worth to buy a ', p_name, ' of ', p_type, ' type with size ', cast(p_size AS {str}),"
     " ' for my small home workshop')"),
    ("forum", "quora_question", "concat(repeat(concat(p_name, ' '), 12), p_brand)"),
    ("google_trends", "google_trends_rising", "concat(p_name, ' ', p_type, ' ', p_brand, ' trend')"),
]
