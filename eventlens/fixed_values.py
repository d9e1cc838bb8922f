# -*- coding: utf-8 -*-
"""Fixed values.

Everything in this module is data that must equal the behaviour being
reproduced: keyword lexicons, label maps, captions, message texts and the
numeric thresholds of the scoring rules.  They are listed plainly, in their
natural order.  Library code never hard-wires them: every operator takes the
value as a parameter whose default comes from here, and the lists are turned
into small lexicon DataFrames / literal arrays at call time.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — relevance lexicons (tiers)
# ---------------------------------------------------------------------------
TIER_A_STRONG = [
    "السودان", "سودان", "الخرطوم", "أمدرمان", "بحري", "دارفور", "الفاشر", "نيالا", "زالنجي",
    "الجنينة", "كردفان", "جنوب كردفان", "شمال كردفان", "النيل الأزرق", "بورسودان", "كسلا",
    "سنار", "مدني", "الجزيرة", "القضارف", "الدمازين", "دنقلا", "حلفا", "كوستي", "ربك", "أبوحمد",
    "الجيش السوداني", "القوات المسلحة السودانية", "قوات الدعم السريع", "الدعم السريع",
    "البرهان", "عبدالفتاح البرهان", "حميدتي", "محمد حمدان دقلو", "محمد حمدان", "هيثم برهان",
]

TIER_A_DEFINITIVE = [
    "السودان", "الخرطوم", "أم درمان", "نيالا", "بورتسودان", "الفاشر", "الجنينة", "دارفور",
    "الدعم السريع", "البرهان", "حميدتي", "حمدوك", "القوات المسلحة السودانية",
    "مجلس السيادة السوداني", "RSF", "SAF", "Sudan", "Khartoum", "Darfur",
]

EXCLUSION_KEYWORDS = [
    "غزة", "فلسطين", "لبنان", "أوكرانيا", "روسيا", "الاحتلال",
    "Gaza", "Ukraine", "Palestine", "Israel", "Hezbollah",
]

TIER_B_CONTEXT = [
    "الجيش", "اشتباكات", "نزاع", "مفاوضات", "جنيف", "جدة",
    "الإيغاد", "النزوح", "المجاعة", "اللاجئين",
]

# Relevance scoring: weight of a tier-B hit in the title / in the body, and
# the minimum score for an international article without a tier-A hit.
TITLE_WEIGHT = 3
BODY_WEIGHT = 1
MIN_CONTEXT_SCORE = 4

# ---------------------------------------------------------------------------
# FIXED VALUES — feed registry: source urls whose category is 'international'
# ---------------------------------------------------------------------------
INTERNATIONAL_SOURCES = [
    "https://arabic.cnn.com",
    "https://www.skynewsarabia.com",
    "https://aawsat.com",
    "https://www.aljazeera.net",
    "https://www.almashhad.news",
    "https://www.france24.com",
    "https://arabic.euronews.com",
    "https://alalam.ir",
    "https://arabic.rt.com",
    "https://www.alsumaria.tv",
    "https://alhiwar.tv",
    "https://www.almasryalyoum.com",
    "https://www.elkhabar.com",
]

# ---------------------------------------------------------------------------
# FIXED VALUES — clustering and scoring parameters (defaults)
# ---------------------------------------------------------------------------
SIMILARITY_THRESHOLD = 0.5        # join a cluster when cosine > threshold
TIME_WINDOW_HOURS = 300           # active while t - last_updated <= window
BEST_CLUSTER_WINDOW_HOURS = 72    # window of the best-existing-cluster lookup
IDEAL_SHARE = 33.33               # balance score reference share (percent)
BLINDSPOT_MAJORITY = 70           # one side above this ...
BLINDSPOT_MINORITY = 15           # ... and the other below this
NEUTRAL_ONLY_SHARE = 80           # neutral above this with total > 2
NEUTRAL_ONLY_MIN_TOTAL = 2
PARTISAN_NEUTRAL_SHARE = 20       # neutral below this with total > 3
PARTISAN_MIN_TOTAL = 3
RECENT_HOURS = 6                  # coverage velocity: recent window
PREVIOUS_HOURS = 12               # coverage velocity: end of previous window
TRENDING_VELOCITY = 1.5           # trending when velocity > this ...
TRENDING_MIN_SOURCES = 3          # ... and number_of_sources >= this
TRENDING_LOOKBACK_HOURS = 48
POPULAR_SCAN_LIMIT = 100
POPULAR_MIN_ARTICLES = 2
POPULAR_TOP = 10
TOKEN_EXPIRY_DAYS = 90
APP_TIMEZONE = "Africa/Khartoum"

# Blindspot type names, in rule order.
PRO_SAF_BLINDSPOT = "PRO_SAF_BLINDSPOT"
OPPOSE_SAF_BLINDSPOT = "OPPOSE_SAF_BLINDSPOT"
NEUTRAL_ONLY = "NEUTRAL_ONLY"
PARTISAN_STORY = "PARTISAN_STORY"
BALANCED = "BALANCED"

# ---------------------------------------------------------------------------
# FIXED VALUES — label maps
# ---------------------------------------------------------------------------
# UI topic key -> stored topic label (unknown keys pass through).
TOPIC_MAP = {
    "politics": "سياسة",
    "economy": "اقتصاد",
    "sports": "رياضة",
    "security": "أمن وعسكر",
    "culture": "مجتمع وثقافة",
    "opinion": "مقالات رأي",
}

# Static topic list served to clients.
TOPIC_LIST = ["سياسة", "أمن وعسكر", "اقتصاد", "رياضة", "مجتمع وثقافة", "مقالات رأي"]

# Bias value -> display label; anything else -> BIAS_LABEL_UNKNOWN.
BIAS_LABELS = {
    "Neutral": "محايد",
    "Pro-SAF": "مؤيد - القوات المسلحة",
    "Oppose-SAF": "معارض - القوات المسلحة",
    "neutral": "محايد",
    "pro-saf": "مؤيد - القوات المسلحة",
    "oppose-saf": "معارض - القوات المسلحة",
}
BIAS_LABEL_UNKNOWN = "غير محدد"

# Bias value -> css class (exact match), else 'unknown'.
BIAS_CSS = {"Oppose-SAF": "oppose", "Neutral": "neutral", "Pro-SAF": "pro"}

# Blindspot type -> caption (three of the five types have one).
BLINDSPOT_CAPTIONS = {
    "PRO_SAF_BLINDSPOT": "⚠️ نقطة عمياء: تجاهل من المصادر المؤيدة",
    "OPPOSE_SAF_BLINDSPOT": "⚠️ نقطة عمياء: تجاهل من المصادر المعارضة",
    "BALANCED": "✅ تغطية متوازنة",
}

# Dominant-side labels in tie-break order (first wins).
SIDE_LABELS = [("pro", "مؤيد"), ("neutral", "محايد"), ("oppose", "معارض")]

# Category labels of a cluster without topics.
LABEL_LOCAL = "محلي"
LABEL_INTERNATIONAL = "دولي"
LABEL_BOTH = "محلي ودولي"
LANGUAGE_AR_LABEL = "عربي"

# ---------------------------------------------------------------------------
# FIXED VALUES — relative time texts (server side)
# ---------------------------------------------------------------------------
AGO_NOW = "الآن"
AGO_MINUTE_1 = "منذ دقيقة"
AGO_MINUTE_2 = "منذ دقيقتين"
AGO_MINUTES = "منذ {} دقائق"
AGO_HOUR_1 = "منذ ساعة"
AGO_HOUR_2 = "منذ ساعتين"
AGO_HOURS = "منذ {} ساعات"
AGO_DAY_1 = "قبل يوم"
AGO_DAY_2 = "قبل يومين"
AGO_DAYS = "قبل {} أيام"

# Relative time texts (client side): unit seconds and labels, largest first.
CLIENT_AGO_UNITS = [
    (31536000, "سنة"),
    (2592000, "شهر"),
    (86400, "يوم"),
    (3600, "ساعة"),
    (60, "دقيقة"),
]
CLIENT_AGO_PREFIX = "منذ "
CLIENT_AGO_NOW = "منذ لحظات"

# ---------------------------------------------------------------------------
# FIXED VALUES — notification texts
# ---------------------------------------------------------------------------
NEW_CLUSTER_TITLE = "خبر جديد"
NEW_CLUSTER_BODY_PREFIX = "تم نشر مجموعة أخبار جديدة: "
POPULAR_BODY_PREFIX = "خبر متطور: "
POPULAR_BODY_SOURCES = " مصادر - "
POPULAR_FALLBACK_PREFIX = "مجموعة أخبار تحتوي على "
POPULAR_FALLBACK_SUFFIX = " مقالة"
TRUNCATE_TITLE = 50

# ---------------------------------------------------------------------------
# FIXED VALUES — extraction response keys (8 entity lists + topic)
# ---------------------------------------------------------------------------
ENTITY_LIST_KEYS = [
    "people", "cities", "regions", "countries", "organizations",
    "political_parties_and_militias", "brands", "job_titles",
]
ENTITY_CATEGORY_KEY = "category"
