"""Fixed values.  Every name, pattern and threshold here has to equal the
published data contract for results to agree, so they are kept as plain text
in one place; nothing in this module is logic."""

CATEGORIES = [
    "headphones_earbuds", "speakers", "streaming_devices", "smart_home",
    "cables_adapters", "chargers_batteries", "phone_accessories",
    "computer_peripherals", "storage_media", "cameras_accessories",
    "tv_accessories", "gaming_accessories", "wearables", "other_electronics",
]
FALLBACK_CATEGORY = "other_electronics"
# spellings seen in free-form labels, tried after the names above
CATEGORY_VARIANTS = {
    "camera_accessories": "cameras_accessories",
    "tablet": "computer_peripherals",
    "networking": "computer_peripherals",
}

THEMES = [
    "battery_life", "build_quality", "sound_quality", "connectivity",
    "comfort", "value_for_money", "customer_service", "durability",
    "ease_of_use", "other",
]
FALLBACK_THEME = "other"

CATEGORY_ALIASES = {
    "headphones": "headphones_earbuds", "earbuds": "headphones_earbuds",
    "cables": "cables_adapters", "adapters": "cables_adapters",
    "chargers": "chargers_batteries", "batteries": "chargers_batteries",
    "phones": "phone_accessories", "phone": "phone_accessories",
    "computers": "computer_peripherals", "peripherals": "computer_peripherals",
    "storage": "storage_media", "cameras": "cameras_accessories",
    "tv": "tv_accessories", "gaming": "gaming_accessories",
    "smart home": "smart_home", "smarthome": "smart_home",
    "streaming": "streaming_devices",
}
THEME_ALIASES = {
    "battery": "battery_life", "build": "build_quality",
    "sound": "sound_quality", "audio": "sound_quality",
    "connection": "connectivity", "bluetooth": "connectivity", "wifi": "connectivity",
    "price": "value_for_money", "value": "value_for_money", "cost": "value_for_money",
    "support": "customer_service", "service": "customer_service",
    "durable": "durability",
    "ease of use": "ease_of_use", "usability": "ease_of_use",
}
BRAND_ALIASES = {
    "amazon basics": "amazonbasics", "amazon-basics": "amazonbasics",
    "amazonbasic": "amazonbasics", "amazon-basic": "amazonbasics",
}

PRODUCT_ID_PATTERN = r"\bB0[A-Z0-9]{8,}\b"

# redaction rules, applied in this order
REDACTIONS = [
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
    (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "[PHONE_REDACTED]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN_REDACTED]"),
    (r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "[CARD_REDACTED]"),
    (r"https?://\S+", "[URL_REMOVED]"),
]

# cleaning rules, applied in this order: (pattern, replacement)
BASIC_CLEANING = [(r"<[^>]+>", " "), (r"https?://\S+", " "), (r"\s+", " ")]
FULL_CLEANING = [
    (r"<br\s*/?>", " "), (r"&#[0-9]+", ""),
    (r"\[\[VIDEOID:[^\]]*\]\]", ""), (r"\[\[ASIN:[^\]]*\]\]", ""),
    (r"https?://\S+", ""), (r"www\.\S+", ""), (r"\s{2,}", " "),
]
REMNANTS = ["<br", "[[ASIN", "[[VIDEOID"]

INJECTION_PATTERNS = [
    r"ignore (all |your |previous |the above)", r"forget (all |your |previous )",
    r"disregard (all |your |previous )", r"you are now", r"act as",
    r"pretend (to be|you)", r"new instructions", r"override", r"system prompt",
    r"</?(system|assistant|user)", r"<\|", r"\bDAN\b", r"jailbreak", r"bypass",
]
ABUSE_PATTERNS = [
    r"(write|generate|create|make).*(fake|false|fabricat).*(review|complaint|rating)",
    r"(say|write|generate).*(offensive|racist|sexist|demeaning|hateful|discriminat)",
    r"(insult|attack|defame|slander|harass)",
    r"(hate speech|racial slur|ethnic slur)",
    r"(worst|terrible|stupid).*(race|gender|ethnicity|religion|nationality|people from)",
    r"(how to|ways to).*(manipulat|deceiv|trick|scam|cheat)",
    r"(fake|forge|fabricat).*(data|statistic|number|metric)",
]
TOPIC_WORDS = [
    "review", "rating", "sentiment", "product", "category", "brand",
    "complaint", "theme", "quality", "customer", "asin",
    "negative", "positive", "worst", "best", "recommend", "buy", "worth",
    "compare", "comparison", "analysis", "trend", "monthly",
    "average", "count", "total", "price", "value", "feature",
    "people say", "people think", "what about", "how is", "tell me",
    "suggest", "find", "search", "show", "list",
    "electronic", "device", "accessory", "wireless", "bluetooth",
]
BRAND_STOPWORDS = [
    "make", "made", "the", "one", "all", "now", "go", "can", "get", "has",
    "had", "was", "are", "and", "not", "set", "run",
]

FOLLOWUP_SIGNALS = [
    "it", "they", "them", "this", "that", "those", "the same", "how about",
    "what about", "and the", "also", "its", "their", "both", "each of them",
    "all of them",
]
# intent keyword groups, highest priority first; no match means the last one
INTENT_SIGNALS = {
    "synthesis": ["and what", "numbers and", "full analysis", "complete picture",
                  "stats and", "data and examples"],
    "semantic": ["what do people say", "tell me about", "what problems", "recommend",
                 "worth buying", "what do people think", "experiences",
                 "what do customers", "what do reviews", "how do people"],
    "structured": ["how many", "average", "rank", "top ", "worst", "best", "highest",
                   "lowest", "percentage", "trend", "compare", "count",
                   "which category", "which product", "number of", "total"],
}
KNOWN_BRANDS = ["amazon", "logitech", "sony", "samsung", "anker", "bose",
                "apple", "senso", "jbl", "canon", "panasonic", "ring"]

# overlapping complaint groups: a negative review may fall into several
COMPLAINT_GROUPS = {
    "hardware": ["sound", "speaker", "audio", "volume", "build", "broke", "broken", "quality"],
    "software": ["wifi", "connect", "bluetooth", "pair", "app", "software", "update"],
    "durability": ["last", "durable", "stopped working", "died", "month"],
    "value": ["price", "expensive", "worth", "cheap", "overpriced"],
    "service": ["customer service", "support", "return", "refund", "warranty"],
}

PRICE_CUTS = [15, 30, 60]
PRICE_LABELS = ["budget (under $15)", "mid-range ($15-$30)", "premium ($30-$60)",
                "high-end ($60+)"]

METADATA_DROP = ["similar_item", "imageURL", "imageURLHighRes"]
COST_PER_CALL = 0.003
QUESTION_TYPES = {"cat": "category", "prod": "product", "theme": "theme"}
