"""Word lists, phrase rules, endpoints and labels that decide the results.

These are data, kept together and in their natural order. The operators give them meaning.
"""

from __future__ import annotations

from lexmine.functions.patterns import Rule

# ---- Fixed values: cleaning -------------------------------------------------------------------

MIN_LENGTH, MAX_LENGTH = 3, 120
MIN_WORDS, MAX_WORDS = 1, 15

STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "it", "as",
    "be", "was", "are", "were", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "shall", "can", "not", "no", "nor", "so", "yet", "both", "either", "neither", "each", "few",
    "more", "most", "other", "some", "such", "than", "too", "very", "just", "then", "there", "these", "those", "what",
    "when", "where", "who", "which", "why", "how",
]

BLOCKED_WORDS = ["porn", "sex", "adult", "casino", "gambling", "drug", "illegal"]

# ---- Fixed values: keyword types --------------------------------------------------------------

BRAND = "Brand Keyword"
SUPPLIER = "Supplier / Factory / Manufacturer Keyword"
CUSTOM = "Custom / OEM / ODM Keyword"
CERTIFICATION = "Certification Keyword"
SPECIFICATION = "Specification Keyword"
APPLICATION = "Application Keyword"
INDUSTRY = "Industry Keyword"
PROBLEM = "Problem Solving Keyword"
COMPETITOR = "Competitor Keyword"
LONG_TAIL = "Long Tail Keyword"
LOW_INTENT = "Low Intent / Negative Keyword"
CORE = "Core Product Keyword"
INDUSTRIAL = "Industrial Keyword"

KEYWORD_TYPES = [
    BRAND, SUPPLIER, CUSTOM, CERTIFICATION, SPECIFICATION, APPLICATION, INDUSTRY, PROBLEM, COMPETITOR,
    LONG_TAIL, LOW_INTENT, CORE, INDUSTRIAL,
]

CORE_MAX_WORDS = 3
LONG_TAIL_MIN_WORDS = 4

LOW_INTENT_FIRST = Rule(LOW_INTENT, words=[
    "rental", "rent", "hire", "second.?hand", "used", "refurbished", "repair", "spare part", "diy",
    "how to make", "homemade", "free download", "pdf manual", "wikipedia", "history", "invention",
    "who invented", "definition of",
])

TYPE_RULES = [
    Rule(BRAND, words=["brand", "branded", "trademark", "logo"]),
    Rule(SUPPLIER, words=[
        "manufacturer", "factory", "supplier", "producer", "vendor", "maker", "brand owner", "oem manufacturer",
        "odm manufacturer", "made in china", "china factory", "chinese manufacturer", "wholesale supplier",
        "bulk supplier",
    ]),
    Rule(CUSTOM, words=[
        "custom", "oem", "odm", "bespoke", "tailor.?made", "customized", "custom.?built", "custom.?design",
        "private label", "white label", "made.?to.?order",
    ]),
    Rule(CERTIFICATION, words=[
        "ce certified", "iso", "atex", "ul listed", "rohs", "reach", "fcc", "iec", "ansi", "din",
        "certification", "certified", "certificate", "approval", "compliant", "standard", "explosion.?proof",
        "safety standard",
    ]),
    Rule(SPECIFICATION, words=[
        r"\p{Nd}+\s*(?:ton|kg|lb|t)", r"\p{Nd}+\s*(?:kw|hp|w|v|a|rpm|hz)", r"\p{Nd}+\s*(?:m|ft|inch|mm|cm)",
        "capacity", "load", "speed", "power", "voltage", "dimension", "size", "weight", "specification", "spec",
        "model", "series", "type", "hydraulic", "electric", "pneumatic", "diesel", "manual", "automatic",
        "semi.?auto",
    ]),
    Rule(APPLICATION, words=[
        "for warehouse", "for factory", "for construction", "for mining", "for port", "for shipyard",
        "for garage", "for workshop", "for loading dock", "for logistics", "for hospital", "for airport",
        "for cold storage", "industrial use", "heavy duty", "heavy.?load", "warehouse use", "cargo handling",
        "material handling",
    ]),
    Rule(INDUSTRY, words=[
        "manufacturing", "logistics", "warehousing", "construction", "mining", "shipbuilding", "automotive",
        "pharmaceutical", "food processing", "cold chain", "aerospace", "oil and gas", "petrochemical", "steel",
        "chemical industry", "textile",
    ]),
    Rule(
        PROBLEM,
        starts=[
            "how to", "how do", "what is", "what are", "why", "when to", "where to", "can i", "should i",
            "is it", "which is better", "vs", "comparison",
        ],
        contains=["problem", "issue", "fail", "broken", "repair", "troubleshoot", "fix", "error", "fault"],
        ends=[r"\?"],
    ),
    Rule(COMPETITOR, words=[
        "vs", "versus", "alternative", "compare", "comparison", "instead of", "better than", "competitor",
        "competing", "rival", "similar to",
    ]),
    Rule(LOW_INTENT, words=[
        "rental", "rent", "hire", "second.?hand", "used", "refurbished", "repair", "spare part", "diy",
        "how to make", "homemade", "free download", "pdf", "manual download", "wikipedia", "history",
        "invention", "who invented", "definition of",
    ]),
    Rule(INDUSTRIAL, words=[
        "industrial", "heavy industrial", "commercial", "professional", "heavy.?duty", "high.?capacity",
        "high.?performance", "robust", "rugged", "durable",
    ]),
]

# ---- Fixed values: intent and commercial value ------------------------------------------------

TRANSACTIONAL, COMMERCIAL = "Transactional", "Commercial"
NAVIGATIONAL, INFORMATIONAL = "Navigational", "Informational"
INTENTS = [TRANSACTIONAL, COMMERCIAL, NAVIGATIONAL, INFORMATIONAL]

INTENT_RULES = [
    Rule(TRANSACTIONAL, words=[
        "buy", "purchase", "order", "quote", "price", "pricing", "cost", "get a quote", "rfq",
        "request for quotation", "buy now", "add to cart", "shop", "wholesale", "bulk order", "for sale",
        "stock", "in stock", "delivery", "shipping", "lead time", "moq",
    ], ends=["price"]),
    Rule(COMMERCIAL, words=[
        "best", "top", "review", "reviews", "rating", "compare", "vs", "versus", "alternative",
        "recommendation", "suggest", "which", "choose", "selection", "brand", "brands", "manufacturer",
        "supplier", "factory", "oem", "odm", "custom", "certified",
    ]),
    Rule(NAVIGATIONAL, words=[
        "official", "website", "login", "contact", "about us", "company", "corporation", "group", "homepage",
        "site",
    ], dotted=["inc", "ltd", "co"]),
]  # everything else is informational

HIGH_VALUE, MEDIUM_VALUE, LOW_VALUE = "High", "Medium", "Low"
VALUES = [HIGH_VALUE, MEDIUM_VALUE, LOW_VALUE]
MEDIUM_MIN_WORDS = 3

VALUE_RULES = [
    Rule(HIGH_VALUE, words=[
        "manufacturer", "factory", "supplier", "oem", "odm", "custom", "wholesale", "bulk", "quote", "price",
        "buy", "for sale", "rfq", "heavy duty", "industrial", "certification", "certified", "export", "import",
        "b2b",
    ]),
    Rule(LOW_VALUE, words=[
        "free", "diy", "homemade", "how to make", "history", "definition", "wikipedia", "invention",
        "who invented", "what is", "rental", "second.?hand", "used",
    ]),
]

# ---- Fixed values: page types -----------------------------------------------------------------
# For each keyword type its pages by intent; the first one listed also serves the intents not listed.

PAGE_TYPES = {
    CORE: {
        TRANSACTIONAL: "Product Page",
        COMMERCIAL: "Category / Collection Page",
        INFORMATIONAL: "Product Detail Page",
        NAVIGATIONAL: "Product Page",
    },
    SUPPLIER: {
        TRANSACTIONAL: "Supplier Landing Page",
        COMMERCIAL: "About / Company Page",
        INFORMATIONAL: "About / Company Page",
    },
    CUSTOM: {
        TRANSACTIONAL: "Custom Order / RFQ Page",
        COMMERCIAL: "OEM Service Page",
        INFORMATIONAL: "Blog / Guide Page",
    },
    SPECIFICATION: {
        TRANSACTIONAL: "Product Spec Page",
        INFORMATIONAL: "Technical Datasheet Page",
        COMMERCIAL: "Product Comparison Page",
    },
    APPLICATION: {
        INFORMATIONAL: "Application / Use-case Page",
        COMMERCIAL: "Solution Page",
        TRANSACTIONAL: "Product Category Page",
    },
    INDUSTRY: {INFORMATIONAL: "Industry Solution Page", COMMERCIAL: "Industry Landing Page"},
    PROBLEM: {INFORMATIONAL: "Blog / FAQ Page", COMMERCIAL: "FAQ / Troubleshooting Page"},
    CERTIFICATION: {INFORMATIONAL: "Certification Page", COMMERCIAL: "Quality Assurance Page"},
    LONG_TAIL: {
        INFORMATIONAL: "Blog / Guide Page",
        COMMERCIAL: "Landing Page",
        TRANSACTIONAL: "Product / Category Page",
    },
    COMPETITOR: {COMMERCIAL: "Comparison Page", INFORMATIONAL: "Blog / Comparison Article"},
    INDUSTRIAL: {
        INFORMATIONAL: "Industry Blog Page",
        COMMERCIAL: "Category Page",
        TRANSACTIONAL: "Product Category Page",
    },
    LOW_INTENT: {
        INFORMATIONAL: "Skip / No Page Needed",
        COMMERCIAL: "Skip / No Page Needed",
        TRANSACTIONAL: "Skip / No Page Needed",
    },
}
DEFAULT_PAGE = "Blog / General Page"

# ---- Fixed values: channels and requests ------------------------------------------------------
# Channel order decides which record of a keyword is "first".

CHANNELS = ["google", "bing", "youtube", "amazon", "alibaba", "madeinchina", "forum", "competitor", "google_trends"]

# The switch each channel listens to; other switch names have no effect.
CHANNEL_SWITCH = {
    "google": "google_suggest",
    "bing": "bing_suggest",
    "youtube": "youtube_suggest",
    "amazon": "amazon_suggest",
    "alibaba": "alibaba_suggest",
    "madeinchina": "madeinchina",
    "forum": "reddit",
    "competitor": "competitor",
    "google_trends": "google_trends",
}
DEFAULT_SWITCHES = {
    "google_suggest": True, "google_related": True, "google_paa": True, "google_serp": True,
    "bing_suggest": True, "bing_serp": True, "youtube_suggest": True, "youtube_serp": True,
    "amazon_suggest": True, "alibaba_suggest": True, "alibaba_titles": True, "madeinchina": True,
    "reddit": True, "quora": False, "competitor": True, "google_trends": True,
}

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
MODIFIERS = {
    "google": [
        "price", "manufacturer", "factory", "supplier", "custom", "oem", "wholesale", "specification",
        "for sale", "quote", "cost", "buy", "china", "how to", "what is", "types of", "best", "top", "vs",
        "alternative", "certified",
    ],
    "bing": [
        "price", "manufacturer", "supplier", "factory", "custom", "oem", "buy", "for sale", "specification",
        "quote", "china", "how", "what", "best", "vs", "certified",
    ],
    "youtube": [
        "how to", "installation", "working", "review", "demo", "vs", "price", "china factory", "manufacturer",
    ],
    "amazon": [
        "price", "for warehouse", "industrial", "heavy duty", "electric", "hydraulic", "specification", "supplier",
    ],
}
SUBREDDITS = ["manufacturing", "engineering", "industrial", "logistics", "warehousing"]

GOOGLE_SUGGEST_URL = "https://suggestqueries.google.com/complete/search"
GOOGLE_SEARCH_URL = "https://www.google.com/search"
BING_SUGGEST_URL = "https://api.bing.com/osjson.aspx"
BING_SEARCH_URL = "https://www.bing.com/search"
YOUTUBE_SEARCH_URL = "https://www.youtube.com/results"
AMAZON_SUGGEST_URL = "https://completion.amazon.com/api/2017/suggestions"
AMAZON_LEGACY_URL = "https://completion.amazon.com/search/complete"
ALIBABA_SUGGEST_URL = "https://www.alibaba.com/search/suggest_new"
ALIBABA_SEARCH_URL = "https://www.alibaba.com/trade/search"
ALIBABA_PRODUCTS_URL = "https://www.alibaba.com/Products/"
MADEINCHINA_URL = "https://www.made-in-china.com/multi-search/"
REDDIT_URL = "https://www.reddit.com/"

# Parameters of each endpoint in their order; QUERY stands for the request's query. Other endpoints have none.
QUERY = "{query}"
PARAMS = {
    "google/suggest": {"client": "firefox", "q": QUERY, "hl": "en"},
    "google/suggest_alpha": {"client": "firefox", "q": QUERY, "hl": "en"},
    "google/suggest_modifier": {"client": "firefox", "q": QUERY, "hl": "en"},
    "google/serp": {"q": QUERY, "hl": "en", "gl": "us", "num": "10"},
    "bing/suggest": {"query": QUERY, "form": "OSJRLH"},
    "bing/suggest_ext": {"query": QUERY, "form": "OSJRLH"},
    "bing/serp": {"q": QUERY, "count": "10", "setlang": "en"},
    "youtube/suggest": {"client": "youtube", "q": QUERY, "hl": "en", "ds": "yt"},
    "youtube/suggest_ext": {"client": "youtube", "q": QUERY, "hl": "en", "ds": "yt"},
    "youtube/serp": {"search_query": QUERY},
    "amazon/suggest": {
        "session-id": "000-0000000-0000000", "customer-id": "", "request-id": "auto", "page-type": "Search",
        "lop": "en_US", "site-variant": "desktop", "client-info": "amazon-search-ui", "mid": "ATVPDKIKX0DER",
        "alias": "aps", "b2b": "0", "fresh": "0", "ks": "80", "prefix": QUERY, "event": "onKeyPress", "limit": "11",
        "fb": "1", "suggestion-type": "KEYWORD", "_": "1",
    },
    "amazon/suggest_legacy": {
        "method": "completion", "q": QUERY, "search-alias": "aps", "client": "amazon-search-ui", "mkt": "1",
    },
    "amazon/suggest_ext": {
        "session-id": "000-0000000-0000000", "prefix": QUERY, "alias": "aps", "mid": "ATVPDKIKX0DER", "limit": "11",
        "suggestion-type": "KEYWORD",
    },
    "alibaba/suggest": {"keyword": QUERY, "country": "US", "lang": "en"},
    "alibaba/search": {"fsb": "y", "IndexArea": "product_en", "keywords": QUERY, "tab": "all", "page": "1"},
    "forum/reddit": {"q": QUERY, "sort": "relevance", "t": "all", "limit": "25", "type": "link"},
    "forum/subreddit": {"q": QUERY, "restrict_sr": "1", "sort": "relevance", "limit": "10"},
    "forum/quora": {"q": QUERY, "hl": "en", "num": "10"},
    "competitor/discovery": {"q": QUERY, "hl": "en", "gl": "us", "num": "10"},
}

# Endpoints of each channel in the order in which their answers count.
ENDPOINTS = {
    "google": ["suggest", "suggest_alpha", "suggest_modifier", "serp"],
    "bing": ["suggest", "suggest_ext", "serp"],
    "youtube": ["suggest", "suggest_ext", "serp"],
    "amazon": ["suggest", "suggest_legacy", "suggest_ext"],
    "alibaba": ["suggest", "products", "search"],
    "madeinchina": ["search", "search_page2"],
    "forum": ["reddit", "subreddit", "quora"],
    "competitor": ["discovery", "page"],
    "google_trends": ["trends"],
}

MAX_ATTEMPTS = 3
COMPETITORS_PER_ROOT = 5
COMPETITOR_SKIP = ["google.com", "youtube.com", "wikipedia.org", "amazon.com", "alibaba.com"]
TRENDS_ROOT_LENGTH = 100
LANGUAGE, COUNTRY = "en", "US"

# ---- Fixed values: clustering, reports, files -------------------------------------------------

N_CLUSTERS, N_COMPONENTS, MAX_CLUSTERS = 20, 50, 50
NGRAM_MIN, NGRAM_MAX, MAX_FEATURES = 2, 4, 20000
KMEANS_STARTS, KMEANS_ITERATIONS, SEED = 10, 300, 42
TOP_KEYWORDS, TOP_CLUSTERS, SAMPLE_KEYWORDS = 20, 10, 5

OUTPUT_COLUMNS = [
    "keyword", "root_keyword", "source", "channel", "keyword_type", "search_intent", "page_type",
    "commercial_value", "title", "description", "url", "language", "country", "collected_at", "cluster_id",
    "cluster_label",
]
