"""Values that results depend on: word lists, patterns, limits and formats."""

# --- fixed values: row classification -------------------------------------
STATES = ("NEW_ROLE", "ROLE_UPDATED", "ROLE_CLOSED", "NO_OP")
DEFAULT_TTL_SECONDS = 90 * 24 * 60 * 60
JOB_TYPES = ("internship", "new_grad")
JOB_TYPE_ALIASES = {"intern": "internship", "newgrad": "new_grad"}
CLOSED_WORDS = ("true", "1", "yes", "closed")
OPEN_WORDS = ("false", "0", "no", "open", "")
SEASONS = (2026, 2027)

# --- fixed values: table rows ----------------------------------------------
DEFAULT_COLUMNS = ("company", "title", "location", "apply_url", "date")
REQUIRED_COLUMNS = ("company", "title", "location", "apply_url")
HEADER_ALIASES = {
    "company": ("company", "employer"),
    "title": ("role", "title", "position", "job title"),
    "location": ("location", "locations"),
    "apply_url": ("application", "application link", "apply", "link"),
    "date": ("date", "date posted", "posted", "posting date"),
}
CONTINUATION_MARK = "↳"
NOT_A_ROW = "not a valid job row"
DUPLICATE_IDENTITY = "duplicate base identity in run"

# --- fixed values: captured responses ---------------------------------------
RELEVANT_URL_PATTERNS = ("/api/", "graphql")
SECRET_QUERY_KEYS = (
    "access_token", "api_key", "apikey", "authorization", "key", "secret", "token",
)
REDACTED = "[REDACTED]"
MAX_PAYLOADS = 100
MAX_PAYLOAD_BYTES = 10 * 1024 * 1024

# --- fixed values: envelopes of captured boards and portals ------------------
CONTAINER_KEYS = ("jobs", "results", "searchResults", "data")
UNSPECIFIED = "Unspecified"

# --- fixed values: endpoint and source health ---------------------------------
TRANSIENT_STATUS = (408, 425, 429, 500, 502, 503, 504)
COOLING_STATUS = (403, 429, 503)
ENDPOINT_SCHEMES = ("http", "https", "socks5")
BASE_COOLDOWN_SECONDS = 30.0
MAX_COOLDOWN_SECONDS = 900.0
MAX_FAILURES = 5
RECENT_ERRORS = 100

# --- fixed values: events ------------------------------------------------------
EVENT_VERSION = 1
EVENT_CREATED = "JOB_CREATED"
EVENT_UPDATED = "JOB_UPDATED"

# --- fixed values: audit codes ----------------------------------------------------
AUDIT_CODES = (
    "orphan_job_postings",
    "duplicate_base_hash",
    "duplicate_content_hash",
    "closed_without_status_log",
    "stale_closed_status",
)

# --- fixed values: patterns of table cells ------------------------------------------
SEPARATOR_CELL = r"^:?-{3,}:?$"
DIFF_FILE_HEADER = r"^(\+\+\+|---)\s"
TABLE_CELL = r"(?is)<td\b[^>]*>(.*?)</td\s*>"
TAG = r"<[^<>]*>"
IMAGE = r"!\[[^]\r\n]*]\([^\r\n)]*\)"
BARE_URL = r"(?i)https?://[^\s<>\"']+"
ANCHOR = r"(?i)<a\b[^<>]*?\bhref\s*=\s*(['\"])(https?://.*?)\1"
LOCK = "\U0001f512"
LOCK_ICON = "\U0001f512[︎️]?️?"
STRUCK = r"~~(?=\S)[^\r\n~]*(?<=\S)~~"
BREAK_TAG = r"(?i)<br\s*/?>"
PLACE_SEPARATOR = r"\s*(?:[•·]|\n+)\s*"
BADGES = "🔥⭐🆕"
CLOSED_STATUS = r"(?i)[\s*_`~]*(?:closed)[\s*_`~]*"
README_NAMES = ("readme.md", "readme.mdx")
MARKDOWN_SUFFIX = r"\.mdx?$"

# --- fixed values: keys read from board and portal records ----------------------------
BOARD_A = "greenhouse"
BOARD_A_METADATA = (
    "id", "updated_at", "requisition_id", "content", "metadata", "departments", "offices",
)
BOARD_B = "lever"
CARDS = "workday"
PLACE_KEYS = ("name", "city", "display_name")
PORTALS = {
    "amazon_jobs": {
        "company": "Amazon",
        "base": "https://www.amazon.jobs",
        "id": ("id", "job_id", "jobId"),
        "title": ("title", "job_title"),
        "url": ("job_path", "url", "apply_url"),
        "location": ("location", "location_name", "locations"),
    },
    "meta_careers": {
        "company": "Meta",
        "base": "https://www.metacareers.com",
        "id": ("id", "job_id"),
        "title": ("title", "name"),
        "url": ("url", "apply_url", "job_url"),
        "location": ("locations", "location"),
    },
}
