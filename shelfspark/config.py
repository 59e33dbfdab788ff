"""Job parameters and the fixed values the results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# They decide results, so they are stated as they are.
# ---------------------------------------------------------------------------

#: Column order of the product table and its CSV form.
PRODUCT_FIELDS = (
    "name", "category", "subcategory", "image_url", "mrp", "asp", "product_url",
)

#: Money type of every price column.
MONEY = "decimal(28,10)"

#: Path segments that never belong to a product link.
NON_PRODUCT_SEGMENTS = (
    "cart", "checkout", "login", "signin", "signup", "register", "account", "me",
    "help", "help-center", "support", "faq", "contact", "about", "privacy", "terms",
    "policy", "blog", "news", "press", "careers", "search", "wishlist", "orders",
    "track", "returns", "sitemap",
)

#: Crumbs that name a site's root.
ROOT_CRUMBS = ("home", "homepage", "index", "main", "start", "shop", "all")

#: Separators of a category path, tried in this order.
PATH_SEPARATORS = (">", "›", "|", "/")

#: Texts that are crumb separators rather than crumbs.
CRUMB_SEPARATORS = (">", "/", "|", "›", "»", "-", "—")

#: Containers of a breadcrumb trail, most explicit first.
BREADCRUMB_SELECTORS = (
    "[itemtype$='BreadcrumbList']",
    "nav[aria-label*='breadcrumb' i]",
    "[class*='breadcrumb' i]",
    "[id*='breadcrumb' i]",
)

#: Nodes that show a price, and the sources trusted over position on the page.
PRICE_SELECTOR = "[itemprop='price'], [data-price], [class*='price' i]"
STRUCTURED_PRICE_SELECTORS = (
    "[itemprop='price']", "meta[itemprop='price']", "[data-price]",
)

#: Tags that can wrap a price as a product card, how far up, and how much text.
CARD_TAGS = ("li", "article", "div", "td", "tr", "section")
CARD_MAX_DEPTH = 4
CARD_MAX_TEXT = 300

#: Image addresses with these words are page furniture.
IMAGE_NOISE = ("logo", "icon", "sprite", "placeholder", "avatar", "banner", "pixel")

#: Next-page hooks, most certain first, and the exact labels of a next link.
NEXT_PAGE_SELECTORS = (
    "link[rel='next']",
    "a[rel='next']",
    "a[aria-label*='next' i]",
    "li.next > a",
    ".next > a",
    ".pagination a.next",
    "a.pagination__next",
)
NEXT_PAGE_LABELS = ("next", "next page", "next →", "›", "»", ">")
CURRENT_PAGE_SELECTOR = (
    '[aria-current="page"], .pagination .current, .pagination .active, .pager .current'
)
LOAD_MORE_SELECTOR = (
    '[data-load-more], .load-more, .js-load-more, button[class*="load-more" i]'
)
LOAD_MORE_LABEL = r"(?i)^(load|show|view|see)\s+more\b"

#: Class or id of a pagination container.
PAGER_NAME = r"(?i)pag(er|ination)?\b|\bpages?\b"

#: Where a page names its main image, and the attribute that holds it.
IMAGE_HINTS = (
    ("meta[property='og:image']", "content"),
    ("meta[name='twitter:image']", "content"),
    ("link[rel='image_src']", "href"),
    ("[itemprop='image']", "content"),
)

#: The key in front of a product page's embedded detail object.
DETAIL_KEY = '"/n/api/trade/intention/item/detail"'

#: Category ids of the listing feed's shop.
TAXONOMY_LEVEL2 = {
    9: "Accessories", 10: "Jewelry", 11: "Bags", 12: "Clothing", 14: "Beauty",
    83: "Loungewear", 729: "Lingerie", 750: "Denim",
}
TAXONOMY_LEVEL3 = {
    43: "Eyewear", 51: "Phone Cases", 54: "Tote Bags", 57: "Backpacks",
    61: "Necklaces", 62: "Earrings", 63: "Bracelets", 64: "Rings",
    67: "Nose Rings", 68: "Tops", 69: "Co-ord Sets", 70: "T-Shirts",
    74: "Skirts", 76: "Pants", 79: "Dresses", 80: "Blouses",
    101: "Hair Accessories", 102: "Artificial Nails", 103: "Makeup Bags",
    730: "Bras", 734: "Briefs", 751: "Jeans", 903: "Lounge Sets",
    1086: "Lounge Bottoms", 1141: "Intimate Accessories",
}
UNKNOWN_CATEGORY_PREFIX = "cat:"

#: Sampling and walk bounds: they are part of the results' definition.
MAX_CANDIDATE_CLUSTERS = 4
SAMPLE_SIZE = 3
MIN_CLUSTER_SIZE = 3
#: What a run request may ask for; others are refused. Runs themselves know no upper bound.
MAX_REQUESTED_PRODUCTS = 5_000
DEFAULT_REQUESTED_PRODUCTS = 200
PREVIEW_ROWS = 10

#: Names a caller may force as the source of a run.
EXPLICIT_SOURCES = ("api", "browser", "generic", "sitemap")


@dataclass(frozen=True)
class Selectors:
    """CSS selectors of the configured-selector strategy."""

    product_link: str = "a[href*='/details/']"
    name: str = "h1, [data-testid='product-name'], [class*='goodsName'], [class*='title']"
    image: str = "meta[property='og:image'], img[data-main-image], .product-image img"
    mrp: str = "[data-mrp], .price--original, .mrp, del .price, s .price"
    asp: str = "[data-asp], [data-sale-price], .price--sale, .price--current, .selling-price"


@dataclass(frozen=True)
class JobConfig:
    """Everything a run may be tuned by."""

    base_url: str = "https://shop.example"
    user_agent: str = "Mozilla/5.0 (X11; Linux x86_64)"
    crawl_site: bool = True
    max_listings: int = 0            # 0 = no cap
    max_pages_per_listing: int = 0   # 0 = no cap
    max_listing_pages: int = 0       # 0 = no cap
    max_sitemap_docs: int = 0        # 0 = no cap
    max_sitemap_urls: int = 0        # 0 = no cap
    with_categories: bool = True
    selectors: Selectors = field(default_factory=Selectors)
