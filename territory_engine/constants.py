"""Fixed values.

These values must equal the behaviour being reproduced for results to agree: labels,
window lengths, the cooldown, limits, patterns and age units. They are stated plainly,
together and in natural order; nothing else in the package hard-codes them.
"""

# --- fixed values: time windows (label, length in seconds; None = unbounded) ---
HOUR_SECS = 60 * 60
DAY_SECS = 24 * HOUR_SECS
WEEK_SECS = 7 * DAY_SECS
MONTH_SECS = 30 * DAY_SECS

HOURLY = "hourly"
DAILY = "daily"
WEEKLY = "weekly"
MONTHLY = "monthly"
ALL_TIME = "all-time"

TIME_WINDOWS: list[tuple[str, int | None]] = [
    (HOURLY, HOUR_SECS),
    (DAILY, DAY_SECS),
    (WEEKLY, WEEK_SECS),
    (MONTHLY, MONTH_SECS),
    (ALL_TIME, None),
]
WINDOW_SECS: dict[str, int | None] = dict(TIME_WINDOWS)

# --- fixed values: territory types, in the order rankings are published ---
TERRITORY_TYPES: list[str] = ["colo", "region", "country"]

# --- fixed values: claim columns and the cooldown upsert ---
CLAIM_COLUMNS: list[str] = ["ip", "name", "asn", "colo", "country", "region", "metro", "city", "time_ms"]
COOLDOWN_MS = 900 * 1000

# --- fixed values: admission ---
NAME_MAX_LEN = 40
NAME_PATTERN = r"^[a-zA-Z0-9@:.^+!/\-_\*]+$"
NAME_RATE_LIMIT = 10  # claims per (address, name) per period
IP_RATE_LIMIT = 20  # claims per address per period
RATE_PERIOD_SECS = 10
IPV6_PREFIX_BITS = 48  # fixed: the prefix argument is ignored, 48 bits are always kept

# --- fixed values: batching of accepted claims ---
BATCH_MAX_CLAIMS = 100
BATCH_INTERVAL_MS = 2000

# --- fixed values: publication ---
RECENTS_WINDOW_MS = 86_400_000
RECENTS_LIMIT = 100
IPV4_MASK_PATTERN = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
IPV4_MASK_SUFFIX = ".x.x.x"
TOP_ROWS = 10  # rows shown per leaderboard / recents table
SCORES_MAX_AGE_SECS = 60
CLAIMS_MAX_AGE_SECS = 300

# --- fixed values: relative age (unit, upper bound of now - t in ms, ms per unit) ---
AGE_UNITS: list[tuple[str, int | None, int]] = [
    ("second", 1000 * 120, 1000),
    ("minute", 1000 * 60 * 60, 1000 * 60),
    ("hour", 1000 * 60 * 60 * 24, 1000 * 60 * 60),
    ("day", 1000 * 60 * 60 * 24 * 7, 1000 * 60 * 60 * 24),
    ("week", 1000 * 60 * 60 * 24 * 30 * 2, 1000 * 60 * 60 * 24 * 7),
    ("month", None, 1000 * 60 * 60 * 24 * 30),
]

# --- fixed values: colour hash shifts (fill and stroke) ---
COLOUR_SHIFT_FILL = 5
COLOUR_SHIFT_STROKE = 8

# --- fixed values: geometry ---
ANTIMERIDIAN_THRESHOLD = 1.0
CHINA_SUFFIX = ", China"
MAINLAND_CHINA_REGION = "Mainland China"
