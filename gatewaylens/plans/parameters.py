"""Parameters of the registered queries, shared with their SQL twins."""

from __future__ import annotations

import datetime as dt

# Fixed values.
AS_OF = dt.datetime(2024, 1, 31)
LAST_DAY = dt.date(2024, 1, 30)  # last day of the 7-day usage window
IDLE_SINCE = dt.datetime(2024, 1, 24)  # keys without a request since then are idle
SNAPSHOT_AT = dt.datetime(2024, 1, 20, 12)
LOOKUP_TTL_S = 6 * 3600
# Capacity 2, one token per 28,800 s: requests of one key are hours apart in the given events.
BUCKET_RATE = 2
BUCKET_UNIT_S = 57_600
CACHE_LIMIT = 100_000_000
BODY_LIMIT = 1_048_576
LOG_KEEP = 1000
RECENT_ROWS = 1000
TARGET_RPS = 500.0
PROGRESS_STEP_S = 3600
EXCLUDED_USER = "supplier#000000004"
POST_DAYS = 3  # days of requests in one batch of the ledger
