"""Shared DuckDB building blocks of the expected results, written independently of the library."""

from __future__ import annotations

from workload.templates import COLLECTED_AT, SUGGESTIONS, TITLES

W = r"[\pL\pN_]"
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def norm(x: str) -> str:
    x = rf"regexp_replace({x}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{{7f}}-\x{{9f}}]', '', 'g')"
    x = rf"regexp_replace({x}, '&#?{W}+;', ' ', 'g')"
    x = f"replace(replace(replace({x}, '’', chr(39)), '“', '\"'), '”', '\"')"
    return f"lower(trim(regexp_replace({x}, '{WS}+', ' ', 'g')))"


def whole(x: str, alternatives: str) -> str:
    """x contains one of the alternatives between word edges (RE2 has no lookaround and an ASCII-only edge)."""
    return f"regexp_matches({x}, '(?:^|[^\\pL\\pN_])(?:{alternatives})(?:$|[^\\pL\\pN_])')"


def records_cte() -> str:
    suggestions = ",\n".join(
        f"({i}, {q(c)}, {q(s)}, {q(b)}, {q(a)})" for i, (c, s, b, a) in enumerate(SUGGESTIONS)
    )
    titles = " UNION ALL ".join(
        f"SELECT p_partkey, p_name, {len(SUGGESTIONS) + i} AS ord, {q(c)} AS channel, {q(s)} AS source, "
        f"{t.format(str='VARCHAR')} AS title FROM part"
        for i, (c, s, t) in enumerate(TITLES)
    )
    return f"""
templates(ord, channel, source, before, after) AS (VALUES {suggestions}),
records AS (
  SELECT lower(p_name) AS root_keyword, CAST(ord AS BIGINT) * 1099511627776 + p_partkey AS seq,
         lower(trim(before || ' ' || p_name || ' ' || after)) AS keyword, source, channel,
         '' AS title, '' AS description, '' AS url, 'en' AS language, 'US' AS country,
         TIMESTAMP '{COLLECTED_AT}' AS collected_at
  FROM part, templates
  UNION ALL
  SELECT lower(p_name), CAST(ord AS BIGINT) * 1099511627776 + p_partkey, lower(title), source, channel,
         title, '', 'https://example.com/p/' || p_partkey, 'en', 'US', TIMESTAMP '{COLLECTED_AT}'
  FROM ({titles})
)"""


STOP = (
    "['the','a','an','and','or','but','in','on','at','to','for','of','with','by','from','is','it','as','be',"
    "'was','are','were','been','have','has','had','do','does','did','will','would','could','should','may',"
    "'might','shall','can','not','no','nor','so','yet','both','either','neither','each','few','more','most',"
    "'other','some','such','than','too','very','just','then','there','these','those','what','when','where',"
    "'who','which','why','how']"
)


def n_words(x: str) -> str:
    return f"len(string_split({x}, ' '))"


def all_stop(x: str) -> str:
    return f"len(list_filter(string_split({x}, ' '), lambda w: NOT list_contains({STOP}, w))) = 0"


def low_value(x: str) -> str:
    folded = f"translate({x}, 'ſı', 'si')"
    return (
        f"({whole(folded, 'porn|sex|adult|casino|gambling|drug|illegal')} "
        f"OR regexp_matches({folded}, '^\\p{{Nd}}+$') OR regexp_matches({folded}, '^[^a-zA-Z0-9\\s\\-]+$'))"
    )


def clean_cte() -> str:
    return f"""{records_cte()},
norm AS (SELECT * REPLACE ({norm('keyword')} AS keyword) FROM records),
kept AS (
  SELECT * FROM norm
  WHERE length(keyword) BETWEEN 3 AND 120 AND {n_words('keyword')} BETWEEN 1 AND 15
    AND NOT ({all_stop('keyword')}) AND NOT {low_value('keyword')}
),
cleaned AS (
  SELECT root_keyword, min(seq) AS seq, keyword, string_agg(DISTINCT source, '|' ORDER BY source) AS source,
         arg_min(channel, seq) AS channel, arg_min(title, seq) AS title,
         arg_min(description, seq) AS description, arg_min(url, seq) AS url, arg_min(language, seq) AS language,
         arg_min(country, seq) AS country, arg_min(collected_at, seq) AS collected_at
  FROM kept GROUP BY root_keyword, keyword
)"""


LOW_FIRST = (
    "rental|rent|hire|second.?hand|used|refurbished|repair|spare part|diy|how to make|homemade|free download"
    "|pdf manual|wikipedia|history|invention|who invented|definition of"
)
SIDE = {
    "Brand Keyword": "brand|branded|trademark|logo",
    "Supplier / Factory / Manufacturer Keyword":
        "manufacturer|factory|supplier|producer|vendor|maker|brand owner|oem manufacturer|odm manufacturer"
        "|made in china|china factory|chinese manufacturer|wholesale supplier|bulk supplier",
    "Custom / OEM / ODM Keyword":
        "custom|oem|odm|bespoke|tailor.?made|customized|custom.?built|custom.?design|private label|white label"
        "|made.?to.?order",
    "Certification Keyword":
        "ce certified|iso|atex|ul listed|rohs|reach|fcc|iec|ansi|din|certification|certified|certificate"
        "|approval|compliant|standard|explosion.?proof|safety standard",
    "Specification Keyword":
        r"\p{Nd}+\s*(?:ton|kg|lb|t|kw|hp|w|v|a|rpm|hz|m|ft|inch|mm|cm)|capacity|load|speed|power|voltage"
        "|dimension|size|weight|specification|spec|model|series|type|hydraulic|electric|pneumatic|diesel|manual"
        "|automatic|semi.?auto",
    "Application Keyword":
        "for (?:warehouse|factory|construction|mining|port|shipyard|garage|workshop|loading dock|logistics"
        "|hospital|airport|cold storage)|industrial use|heavy duty|heavy.?load|warehouse use|cargo handling"
        "|material handling",
    "Industry Keyword":
        "manufacturing|logistics|warehousing|construction|mining|shipbuilding|automotive|pharmaceutical"
        "|food processing|cold chain|aerospace|oil and gas|petrochemical|steel|chemical industry|textile",
}


def rule_case(x: str) -> str:
    """The eleven phrase rules in order, ELSE NULL (x is the folded keyword).

    Their patterns are fixed values, stated here independently of the library's.
    """
    arms = [f"WHEN {whole(x, alternatives)} THEN {q(label)}" for label, alternatives in SIDE.items()]
    problem = (
        "^(?:how to|how do|what is|what are|why|when to|where to|can i|should i|is it|which is better|vs"
        "|comparison)|\\?$|problem|issue|fail|broken|repair|troubleshoot|fix|error|fault"
    )
    arms.append(f"WHEN regexp_matches({x}, '{problem}') THEN 'Problem Solving Keyword'")
    competitor = (
        "vs|versus|alternative|compare|comparison|instead of|better than|competitor|competing|rival|similar to"
    )
    arms.append(f"WHEN {whole(x, competitor)} THEN 'Competitor Keyword'")
    low = (
        "rental|rent|hire|second.?hand|used|refurbished|repair|spare part|diy|how to make|homemade|free download"
        "|pdf|manual download|wikipedia|history|invention|who invented|definition of"
    )
    arms.append(f"WHEN {whole(x, low)} THEN 'Low Intent / Negative Keyword'")
    industrial = (
        "industrial|heavy industrial|commercial|professional|heavy.?duty|high.?capacity|high.?performance|robust"
        "|rugged|durable"
    )
    arms.append(f"WHEN {whole(x, industrial)} THEN 'Industrial Keyword'")
    return "CASE " + "\n".join(arms) + " END"


def is_low_first(x: str) -> str:
    return whole(x, LOW_FIRST)


def is_core(kw: str, root: str) -> str:
    return (
        f"({n_words(kw)} <= 3 AND (contains({kw}, {root}) OR "
        f"len(list_filter(string_split({root}, ' ')[1:2], lambda w: NOT contains({kw}, w))) = 0))"
    )


def type_case(kw: str, x: str, root: str) -> str:
    return f"""CASE
  WHEN {is_low_first(x)} THEN 'Low Intent / Negative Keyword'
  WHEN {is_core(kw, root)} THEN 'Core Product Keyword'
  ELSE coalesce({rule_case(x)},
    CASE WHEN {n_words(kw)} >= 4 THEN 'Long Tail Keyword'
         WHEN len(list_intersect(string_split({kw}, ' '), string_split({root}, ' '))) > 0 THEN 'Core Product Keyword'
         ELSE 'Industrial Keyword' END) END"""


def intent_case(x: str) -> str:
    buy = (
        "buy|purchase|order|quote|price|pricing|cost|get a quote|rfq|request for quotation|buy now|add to cart"
        "|shop|wholesale|bulk order|for sale|stock|in stock|delivery|shipping|lead time|moq"
    )
    look = (
        "best|top|review|reviews|rating|compare|vs|versus|alternative|recommendation|suggest|which|choose"
        "|selection|brand|brands|manufacturer|supplier|factory|oem|odm|custom|certified"
    )
    go = "official|website|login|contact|about us|company|corporation|group|homepage|site"
    return f"""CASE
  WHEN {whole(x, buy)} OR ends_with({x}, 'price') THEN 'Transactional'
  WHEN {whole(x, look)} THEN 'Commercial'
  WHEN {whole(x, go)} OR regexp_matches({x}, '(?:^|[^\\pL\\pN_])(?:inc|ltd|co)\\.[\\pL\\pN_]') THEN 'Navigational'
  ELSE 'Informational' END"""


def value_case(x: str) -> str:
    high = (
        "manufacturer|factory|supplier|oem|odm|custom|wholesale|bulk|quote|price|buy|for sale|rfq|heavy duty"
        "|industrial|certification|certified|export|import|b2b"
    )
    low = (
        "free|diy|homemade|how to make|history|definition|wikipedia|invention|who invented|what is|rental"
        "|second.?hand|used"
    )
    return f"""CASE WHEN {whole(x, high)} THEN 'High' WHEN {whole(x, low)} THEN 'Low'
  WHEN {n_words(x)} >= 3 THEN 'Medium' ELSE 'Low' END"""


# (type, intent) -> page, written out for all 52 pairs: T, C, N, I.
PAGES = {
    "Core Product Keyword":
        ("Product Page", "Category / Collection Page", "Product Page", "Product Detail Page"),
    "Supplier / Factory / Manufacturer Keyword":
        ("Supplier Landing Page", "About / Company Page", "Supplier Landing Page", "About / Company Page"),
    "Custom / OEM / ODM Keyword":
        ("Custom Order / RFQ Page", "OEM Service Page", "Custom Order / RFQ Page", "Blog / Guide Page"),
    "Specification Keyword":
        ("Product Spec Page", "Product Comparison Page", "Product Spec Page", "Technical Datasheet Page"),
    "Application Keyword":
        ("Product Category Page", "Solution Page", "Application / Use-case Page", "Application / Use-case Page"),
    "Industry Keyword":
        ("Industry Solution Page", "Industry Landing Page", "Industry Solution Page", "Industry Solution Page"),
    "Problem Solving Keyword":
        ("Blog / FAQ Page", "FAQ / Troubleshooting Page", "Blog / FAQ Page", "Blog / FAQ Page"),
    "Certification Keyword":
        ("Certification Page", "Quality Assurance Page", "Certification Page", "Certification Page"),
    "Long Tail Keyword":
        ("Product / Category Page", "Landing Page", "Blog / Guide Page", "Blog / Guide Page"),
    "Competitor Keyword":
        ("Comparison Page", "Comparison Page", "Comparison Page", "Blog / Comparison Article"),
    "Industrial Keyword":
        ("Product Category Page", "Category Page", "Industry Blog Page", "Industry Blog Page"),
    "Low Intent / Negative Keyword":
        ("Skip / No Page Needed", "Skip / No Page Needed", "Skip / No Page Needed", "Skip / No Page Needed"),
    "Brand Keyword":
        ("Blog / General Page", "Blog / General Page", "Blog / General Page", "Blog / General Page"),
}


def pages_cte() -> str:
    intents = ("Transactional", "Commercial", "Navigational", "Informational")
    rows = ", ".join(
        f"({q(kind)}, {q(intent)}, {q(page)})" for kind, pages in PAGES.items() for intent, page in zip(intents, pages)
    )
    return f"pages_by_label(keyword_type, search_intent, page_type) AS (VALUES {rows})"


def labelled_cte() -> str:
    return f"""{clean_cte()},
folded AS (SELECT *, translate(keyword, 'ſı', 'si') AS m FROM cleaned),
typed AS (
  SELECT * EXCLUDE (m), {type_case('keyword', 'm', 'root_keyword')} AS keyword_type,
         {intent_case('m')} AS search_intent, {value_case('m')} AS commercial_value
  FROM folded
),
{pages_cte()},
labelled AS (SELECT typed.*, page_type FROM typed JOIN pages_by_label USING (keyword_type, search_intent))"""
