"""Words, labels, patterns and limits that results depend on."""

# Link rules per shop platform. A page has at most one container
# per rule; the rules of a platform are tried in order, the first hit wins.
# (platform, tag or None, attribute, how the attribute is compared, values)
CONTAINER_RULES = (
    ("shopify", None, "id", "equals", ("product-grid",)),
    ("shopify", None, "class", "contains",
     ("product-grid", "collection-grid", "products-grid", "product-list")),
    ("woocommerce", "ul", "class", "contains", ("products",)),
    ("woocommerce", None, "class", "contains",
     ("products", "product-grid", "woocommerce-loop")),
    ("shopyy", None, "class", "contains",
     ("product-list", "goods-list", "product-grid")),
    ("odoo", None, "id", "equals", ("products",)),
    ("odoo", None, "class", "contains", ("o_wsale",)),
)

# Bit of each platform in the `scopes` masks of the page job.
PLATFORM_BITS = {"shopify": 1, "woocommerce": 2, "shopyy": 4, "odoo": 8}

# A link is a product link when it contains one of these.
HREF_PARTS = {
    "shopify": ("/products/",),
    "woocommerce": ("/product/", "?product="),
    "shopyy": ("/product/", "/goods/"),
    "odoo": ("/shop/",),
    "unknown": ("/product", "/goods", "/item", "/detail"),
}

# Fixed values: (platform, html markers in lower case, url marker), first hit wins.
PLATFORM_MARKERS = (
    ("shopify", ("shopify",), "/collections/"),
    ("woocommerce", ("woocommerce", "wp-content"), None),
    ("shopyy", ("shopyy",), None),
    ("odoo", ("odoo",), "/shop"),
)

# Name of the paging parameter.
PAGE_PARAM = "page"
PAGE_PARAM_WOOCOMMERCE = "paged"

# Limits.
MAX_LISTING_PAGES = 20
MAX_PRODUCTS = 30
MAX_BODY_CHARS = 8000
GENERATION_TIMEOUT_MS = 300_000
PREVIEW_ROWS = 5

# Elements removed before page facts are read.
STRIPPED_TAGS = ("script", "style", "nav", "footer", "header", "iframe", "noscript", "svg")

# Position of each role in bundles, queues and context texts.
ROLE_NO = {"brand": 1, "collection": 2, "product": 3, "competitor": 4}

# Fields a request must fill.
REQUIRED_FIELDS = (
    "brand_name", "website_url", "collection_url", "collection_topic",
    "target_market", "keywords", "output_language",
)

# Generation settings sent with each request.
TEMPERATURE = 0.7
MAX_OUTPUT_TOKENS = 65536
TOP_P = 0.95

# Where the text sits in an answer, and how stream lines look.
ANSWER_TEXT_PATH = "$.candidates[0].content.parts[0].text"
LINE_PREFIX = "data: "
END_LINE = "[DONE]"
RELAY_TYPES = ("chunk", "done", "error")

# Context labels.
BRAND_HEADING = "品牌官网内容"
COLLECTION_HEADING = "集合页内容"
PRODUCTS_HEADING = "产品详情页内容"
COMPETITORS_HEADING = "竞品集合页内容"
PRODUCT_ITEM = "产品"
COMPETITOR_ITEM = "竞品"
TYPED_LINKS_HEADING = "产品链接列表（手动输入）"
OVERRIDE_MARK = "手动补充"
TITLE_LABEL = "标题："
META_LABEL = "Meta描述："
H1_LABEL = "H1："
BODY_LABEL = "正文摘要："
LINK_COUNT_LABEL = "共 {n} 个产品："

# What the prompt says when an optional field is missing.
NO_COMPETITORS = "未提供（考虑到是集合页文案规划，不需要提及过多竞对信息）"
NOT_GIVEN = "未提供"
DEFAULT_LANGUAGE = "English"

# Headings that divide a generated text.
PAGE_COPY_HEADING = "Collection Page Copy"
CHINESE_HEADING = "中文对照版"
MODULE_HEADINGS = (
    "📝 Collection Page Copy",
    "📝 中文对照版",
    "📚 数据来源列表",
    "✅ 最终自检清单",
)

# Flags.
LANGUAGE_FLAGS = {
    "English": "🇺🇸",
    "Spanish": "🇪🇸",
    "French": "🇫🇷",
    "German": "🇩🇪",
    "Italian": "🇮🇹",
    "Portuguese": "🇵🇹",
    "Japanese": "🇯🇵",
    "Korean": "🇰🇷",
    "Arabic": "🇸🇦",
    "Dutch": "🇳🇱",
    "Russian": "🇷🇺",
}
OTHER_FLAG = "🌐"

# Words a page copy must not use.
BANNED_WORDS = {
    "marketing": ("Transform", "Elevate", "Upgrade", "Revamp", "Boost", "Unleash",
                  "Unlock", "Enhance"),
    "lead-in": ("Discover", "Explore", "Dive", "Uncover", "Delve", "Unravel", "Find",
                "Get", "Join", "Enjoy", "Experience"),
    "modifier": ("Vibrant", "Rich", "Tapestry", "Fabric", "Multifaceted", "Intricacies",
                 "Insightful", "Delicate Dance", "Interplay", "Unfold"),
}
BANNED_OPENER = "Moreover"
BANNED_FIRST_PHRASES = ("Welcome to", "Are you looking for")

# Copy limits.
MAX_KEYWORD_USES = 3
MAX_KEYWORD_BOLD = 3
MIN_FAQ, MAX_FAQ = 8, 10
MIN_ANSWER_WORDS, MAX_ANSWER_WORDS = 40, 80
MIN_KEYWORDS, MAX_KEYWORDS = 5, 10
FAQ_HEADING = "Frequently Asked Questions"
FAQ_TABLE_TITLE = "FAQ Coverage Check"
FAQ_CATEGORIES = (
    "Compatibility",
    "Installation & Usage",
    "Purchase Decision",
    "Use Cases",
    "Competitor Comparison",
    "Trust & Safety",
)
UNVERIFIED_MARK = "[Unverified]"
