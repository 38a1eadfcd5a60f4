"""SRC-4: site knowledge as data.

A site profile holds hosts, URL patterns, selector lists, label aliases,
block phrases and messages.  A new site is a new ``SiteProfile``, not new
code.  ``rule_tables`` turns a profile into small DataFrames with a
``priority`` column; they are broadcast where joined (their size is fixed by
the profile, never by the data).

The default profile points at a neutral example host; pass the real host(s)
of the site you process.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the behaviour being reproduced; they are
# listed plainly and in their natural order.
# ---------------------------------------------------------------------------

# Metadata keys and their label aliases, in key order (key order matters:
# one label may fill several keys, first key first).
LABEL_ALIASES: list[tuple[str, list[str]]] = [
    ("date_posted", ["date posted", "posted date", "posted on", "date published",
                     "publish date", "published date", "date", "publish on", "created date"]),
    ("category", ["category", "tender category", "category type", "category/type"]),
    ("province", ["province", "province / area", "province/area", "region", "province area"]),
    ("location", ["location", "tender location", "place", "area", "city"]),
    ("subcategory", ["subcategory", "sub category", "sub-category", "type"]),
    ("sector", ["sector", "industry", "sector type", "sector/industry"]),
    ("newspaper", ["newspaper", "news paper", "daily", "publication", "published in"]),
    ("last_date", ["last date", "closing date", "deadline", "due date",
                   "submission date", "last date of submission", "bid submission date",
                   "last date to submit", "closing", "late date"]),
]
METADATA_KEYS = [k for k, _ in LABEL_ALIASES]

IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp"]
IMAGE_STOP_PATTERNS = [
    "logo", "favicon", "avatar", "spinner", "loading", "tracking",
    "pixel", "social_icon", "share_icon", "facebook_icon",
    "banner", "advertisement", "promotion", "promo_banner",
    "google_adsense", "captcha", "thumbnail_",
]
DESCRIPTION_MAX_CHARS = 50000
TRUNCATION_NOTE = "\n\nThe description was truncated."

# Subtrees removed from the body before any extraction.
STRIP_SELECTORS = [
    "script", "style", "noscript", "template", "svg",
    '[style*="display:none"]', '[style*="display: none"]',
    "[hidden]", ".hidden",
    ".nav", ".navbar", ".navigation", "nav",
    ".footer", "footer",
    ".sidebar", "aside",
    ".social-share", ".share-buttons",
    ".related-tenders", ".related-jobs",
    ".breadcrumb", ".breadcrumbs",
    ".advertisement", ".ad-container", ".google-ads",
    ".signup", ".login-form", ".newsletter", ".subscribe",
    ".comments", "#comments",
]
MAIN_CONTENT_SELECTORS = [
    "#tender-detail", ".tender-detail", ".detail-content",
    ".tender-details", "#content", ".content-area", ".main-content",
    "#main", "main", ".post-content", ".entry-content",
    ".page-content", ".detail-page", "#detail",
]
DESCRIPTION_SELECTORS = [
    ".tender-description", "#tender-description", ".description-content",
    ".description", "#description", ".detail-description",
    ".tender-detail-description", ".full-description",
]
DESCRIPTION_HEADING_TAGS = ["h2", "h3", "h4", "h5", "strong"]
DESCRIPTION_HEADING_WORDS = ["description", "tender details", "details"]
LABEL_SPAN_SELECTORS = ["span.label", "strong.label", ".field-label", ".detail-label"]
PAIR_DIV_CLASS_WORDS = ["row", "field", "item", "detail"]

# Listing pages.
SECTION_HEADING_KEYWORDS = ["tenders", "pakistan"]
SECTION_HEADING_TAGS = ["h1", "h2", "h3", "h4", "legend", "caption"]
SECTION_SIBLING_SELECTORS = [
    "table", "div.tender-listing", "div.listing-table", "div.table-responsive",
    "section", "div.first_big_4col",
]
ROW_SELECTORS = [
    "table > tbody > tr", "table tr", "div.tender-item", "div.listing-item",
    "li.tender-item", "li.listing-item", "div.row", "div.row_container",
]
HEADER_ROW_SELECTORS = ["tr th", "tr.header", "thead tr", "div.row_container .bold"]
HEADER_WORDS = ["title", "city", "date", "location", "posted"]
CITY_SELECTORS = ["td:nth-child(2)", "td.city", "span.city", "div.city", ".tender-city",
                  ".location", "td:nth-child(3)", "div.cell32"]
DATE_SELECTORS = ["td:nth-child(3)", "td.date", "span.date", "div.date", ".tender-date",
                  ".posting-date", "td:nth-child(4)", "div.cell33"]
PAGINATION_CONTAINERS = [
    'nav[aria-label*="pagination" i]', '[role="navigation"][aria-label*="pagination" i]',
    ".pagination", ".pager", ".paging", ".page-numbers", "ul.pagination", "ol.pagination",
]
PAGINATION_INDICATORS = ['[aria-current="page"]', ".active", ".current", ".selected", "strong"]
PAGINATION_ITEMS = ["li.active", "li.current", "li.selected"]
FATAL_WARNING_PATTERNS = ["could not be found", "no valid tender listings"]
WARN_NO_SECTION = "The tender listing section could not be found. The webpage structure may have changed."
WARN_NO_ROWS = "The tender section was found, but no valid tender listings were detected."

# Capture gate.
BLOCK_PHRASES = [
    "captcha", "verify you are human", "access denied", "forbidden",
    "login required", "sign in to continue", "unusual traffic", "rate limit",
]
HTML_CONTENT_TYPES = ["text/html", "application/xhtml+xml"]
REJECTED_SCHEMES = ["javascript:", "mailto:", "tel:", "data:", "file:", "chrome:", "edge:", "about:"]
ERROR_MESSAGES: list[tuple[str, str]] = [
    ("INVALID_TENDER_URL", "The selected tender URL is invalid."),
    ("FETCH_TIMEOUT", "The request timed out. Please try again."),
    ("HTTP_ERROR", "The server returned an error response."),
    ("ACCESS_RESTRICTED", "The tender page could not be accessed normally."),
    ("UNEXPECTED_REDIRECT", "The tender URL redirected to an unexpected page."),
    ("NETWORK_ERROR", "Could not connect to the server. Please check your internet connection."),
    ("EMPTY_HTML", "The response contained no content."),
    ("UNEXPECTED_CONTENT_TYPE", "The response was not HTML."),
    ("HTML_PARSE_FAILED", "Failed to parse the tender HTML."),
    ("NO_TENDER_CONTENT", "The parsed tender page has no recognizable content."),
    ("INVALID_HTML", "The HTML input was invalid."),
    ("UNKNOWN_ERROR", "An unexpected error occurred."),
]

# Records, statuses, documents.
NOT_AVAILABLE = "Not available"
UNKNOWN_TITLE = "Unknown Tender"
STATUS_PENDING = "Pending"
STATUS_PARSED = "Parsed - Download Pending"
STATUS_PARSE_FAILED = "Parse Failed"
STATUS_PENDING_RETRY = "Pending Retry"
STATUS_DOWNLOADED = "Downloaded"
STATUS_DOWNLOAD_FAILED = "Download Failed"
FINAL_STATUSES = [STATUS_PARSE_FAILED, STATUS_DOWNLOADED, STATUS_DOWNLOAD_FAILED]
IMAGE_SUCCEEDED = "Succeeded"
IMAGE_FAILED = "Failed"
BATCH_STATUSES = ["Idle", "Processing", "Completed", "Failed"]
WINDOWS_RESERVED_NAMES = [
    "CON", "PRN", "AUX", "NUL", "CLOCK$",
    "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
    "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9",
]
RETRY_MAX_DEFAULT = 1
RETRY_BASE_DELAY_MS = 2000
RETRY_CAP_MS = 30000
RETRY_JITTER_MS = 1000
IMAGE_WAIT_MS = 30000
DOC_HEADER = "=== Tender Details ==="


@dataclass(frozen=True)
class SiteProfile:
    """Per-site rule values.  Hosts are lower case."""

    main_host: str = "www.tenders.example"
    hosts: tuple[str, ...] = ("www.tenders.example", "tenders.example")
    image_hosts: tuple[str, ...] = ("www.tenders.example", "tenders.example")
    site_names: tuple[str, ...] = ("Tenders", "Free Classifieds")
    detail_path_regex: str = r"_tenders-(\d+)\.html$"
    detail_link_marker: str = "_tenders-"
    listing_path_regex: str = r"^/tenders(?:-(\d+))?/?$"
    image_path_marker: str = "/images/tenders/"
    image_container_id: str = "ad-pic-cont"
    image_container_class: str = "ad-pic-cont"
    details_block_class: str = "job_detail"
    details_row_class: str = "row_job_detail"
    details_key_class: str = "job_detail_cell1"
    details_value_class: str = "job_detail_cell2"
    alias_match: str = "contains"  # or "exact"
    description_max_chars: int | None = DESCRIPTION_MAX_CHARS  # None: whole descriptions
    block_scan_chars: int | None = 2000  # block phrases are looked for in the start of a page; None: in all of it
    label_aliases: tuple = field(default_factory=lambda: tuple((k, tuple(v)) for k, v in LABEL_ALIASES))

    @property
    def base_url(self) -> str:
        return f"https://{self.main_host}/"


DEFAULT_PROFILE = SiteProfile()


def rule_tables(spark: SparkSession, profile: SiteProfile = DEFAULT_PROFILE) -> dict[str, DataFrame]:
    """The profile's rule lists as small DataFrames with a priority column."""
    alias_rows = []
    for key_rank, (key, aliases) in enumerate(profile.label_aliases, start=1):
        for a in aliases:
            alias_rows.append((key, key_rank, a))
    s = T.StructType
    f = T.StructField
    return {
        "aliases": spark.createDataFrame(
            alias_rows, s([f("key", T.StringType()), f("key_rank", T.IntegerType()), f("alias", T.StringType())])
        ),
        "errors": spark.createDataFrame(
            ERROR_MESSAGES, s([f("code", T.StringType()), f("message", T.StringType())])
        ),
        "block_phrases": spark.createDataFrame(
            [(i + 1, p) for i, p in enumerate(BLOCK_PHRASES)],
            s([f("priority", T.IntegerType()), f("phrase", T.StringType())]),
        ),
        "strip_selectors": spark.createDataFrame(
            [(i + 1, p) for i, p in enumerate(STRIP_SELECTORS)],
            s([f("priority", T.IntegerType()), f("selector", T.StringType())]),
        ),
        "main_selectors": spark.createDataFrame(
            [(i + 1, p) for i, p in enumerate(MAIN_CONTENT_SELECTORS)],
            s([f("priority", T.IntegerType()), f("selector", T.StringType())]),
        ),
    }
