"""Scalar rules as Column expressions (no Python runs per row)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatewaylens.schemas import HEADERS

# Fixed values.
API_BASE = "https://api.github.com/"
API_SCHEME = "https"
API_HOST = "api.github.com"
PROXY_PREFIX = "/gh/"
CATEGORIES = ("core", "search", "code_search", "graphql")
CACHEABLE_METHODS = ("GET", "HEAD")
HOP_BY_HOP_HEADERS = (
    "connection", "keep-alive", "proxy-authenticate", "proxy-authorization",
    "te", "trailer", "transfer-encoding", "upgrade",
)
BLOCKED_HEADERS = ("set-cookie", "strict-transport-security", "public-key-pins", "content-length")
STATS_ZONE = "America/New_York"
DEFAULT_RATE = 10
MASKED_SHORT_KEY = "***"


# --- requests and targets ---------------------------------------------------------------------

def api_category(url: Column) -> Column:
    """Quota category of a URL; the first match wins, so the order matters."""
    return (
        F.when(url.contains("/graphql"), "graphql")
        .when(url.contains("/search/code"), "code_search")
        .when(url.contains("/search/"), "search")
        .otherwise("core")
    )


def target_url(base: Column, rest: Column, raw_query: Column) -> Column:
    """Base and path, with the query joined by `?`, or by `&` where a query is already there."""
    target = F.concat(base, rest)
    joint = F.when(target.contains("?"), "&").otherwise("?")
    has_query = F.coalesce(raw_query, F.lit("")) != ""
    return F.when(has_query, F.concat(target, joint, raw_query)).otherwise(target)


def proxied_target(path: Column, raw_query: Column | None = None) -> Column:
    """The upstream URL behind a logged path such as `/gh/repos/a/b`."""
    rest = F.regexp_replace(path, f"^{PROXY_PREFIX}", "")
    return target_url(F.lit(API_BASE), rest, F.lit("") if raw_query is None else raw_query)


def is_cacheable(method: Column) -> Column:
    return method.isin(*CACHEABLE_METHODS)


def url_host(url: Column) -> Column:
    """Host with its port and without user info; null where the URL cannot be parsed."""
    authority = F.try_parse_url(url, F.lit("AUTHORITY"))
    return F.regexp_replace(authority, "^.*@", "")


def allowed_target(url: Column) -> Column:
    """True only for the upstream API over https; the scheme ignores case, the host does not."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    return F.coalesce((scheme == API_SCHEME) & (url_host(url) == API_HOST), F.lit(False))


# --- response headers and bodies --------------------------------------------------------------

def header_map(headers_json: Column) -> Column:
    return F.from_json(headers_json, HEADERS)


def first_header(headers: Column, name: str) -> Column:
    """First value of a header, '' where it is missing."""
    return F.coalesce(F.get(F.try_element_at(headers, F.lit(name)), 0), F.lit(""))


def forbids_storing(headers: Column) -> Column:
    control = F.lower(first_header(headers, "Cache-Control"))
    return control.contains("no-cache") | control.contains("no-store")


def scrub_headers(headers: Column) -> Column:
    """Drop hop-by-hop and blocked response headers, ignoring case."""
    dropped = HOP_BY_HOP_HEADERS + BLOCKED_HEADERS
    return F.map_filter(headers, lambda name, _: ~F.lower(name).isin(*dropped))


def is_bad_credential(status: Column, body: Column) -> Column:
    """401 always; 403 only where the JSON message speaks of bad credentials."""
    message = F.lower(F.coalesce(F.get_json_object(body, "$.message"), F.lit("")))
    return (status == 401) | ((status == 403) & message.contains("bad credentials"))


# --- client keys ------------------------------------------------------------------------------

def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def trimmed(value: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def mask_key(key: Column) -> Column:
    """First six and last four characters; keys of six bytes or fewer are hidden whole."""
    text = trimmed(key)
    masked = F.concat(F.left(text, F.lit(6)), F.lit("…"), F.right(text, F.lit(4)))
    return F.when(F.octet_length(text) <= 6, MASKED_SHORT_KEY).otherwise(masked)


def key_hint(key: Column) -> Column:
    """First six characters after the last underscore; '' without an underscore."""
    tail = F.when(key.contains("_"), F.substring_index(key, "_", -1)).otherwise("")
    return F.left(tail, F.lit(6))


def key_prefix(key: Column) -> Column:
    return F.left(key, F.lit(5))


def key_display(user: Column, app: Column, machine: Column, hint: Column) -> Column:
    base = F.concat(user, F.lit("_"), app, F.lit("_"), machine)
    has_hint = F.coalesce(hint, F.lit("")) != ""
    return F.when(has_hint, F.concat(base, F.lit("_"), hint)).otherwise(base)


def rate_or_default(text: Column, default: int = DEFAULT_RATE) -> Column:
    """A whole number above zero, else the default."""
    number = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))
    return F.when(number > 0, number).otherwise(F.lit(default).cast("int"))


# --- rates and labels -------------------------------------------------------------------------

def hit_rate(cached: Column, total: Column) -> Column:
    """Cached share in percent, 0 where nothing was counted."""
    share = F.try_divide(cached.cast("double"), total.cast("double")) * 100
    return F.when(total > 0, share).otherwise(F.lit(0.0))


def share_pct(part: Column, whole: Column) -> Column:
    """`part * 100 / whole`, 0 where the whole is zero."""
    return F.when(whole > 0, F.try_divide(part.cast("double") * 100.0, whole.cast("double"))).otherwise(F.lit(0.0))


def pct_label(pct: Column) -> Column:
    """Display label such as `41.3%`."""
    return F.format_string("%.1f%%", pct)


# --- time -------------------------------------------------------------------------------------

def instant(at: dt.datetime | dt.date) -> Column:
    """A UTC timestamp without zone, whatever the zone of the driver's machine."""
    return F.lit(str(at)).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    """Epoch microseconds of a timestamp; the session zone is UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def age_seconds(ts: Column, as_of: Column) -> Column:
    return F.floor((micros(as_of) - micros(ts)) / 1_000_000).cast("bigint")


def humanize_age(seconds: Column) -> Column:
    """Age in words: minutes, hours, days, months of 30 days, years of 12 months."""
    minutes = F.floor(seconds / 60)
    hours = F.floor(seconds / 3600)
    days = F.floor(seconds / 86400)
    months = F.floor(days / 30)
    years = F.floor(months / 12)

    def words(count: Column, unit: str) -> Column:
        return F.concat(count.cast("string"), F.lit(f" {unit} ago"))

    return (
        F.when(seconds < 60, "just now")
        .when(seconds < 3600, words(minutes, "minutes"))
        .when(seconds < 86400, words(hours, "hours"))
        .when(days < 30, words(days, "days"))
        .when(months < 12, words(months, "months"))
        .when(seconds.isNotNull(), words(years, "years"))
    )


def short_age(ts: Column, as_of: Column) -> Column:
    """`12s ago`, `3m ago`, `5h ago`, `2d ago`; at least one second."""
    seconds = F.greatest(F.lit(1).cast("bigint"), age_seconds(ts, as_of))

    def label(size: int, unit: str) -> Column:
        return F.concat(F.floor(seconds / size).cast("string"), F.lit(f"{unit} ago"))

    return (
        F.when(seconds < 60, label(1, "s"))
        .when(seconds < 3600, label(60, "m"))
        .when(seconds < 86400, label(3600, "h"))
        .otherwise(label(86400, "d"))
    )


def ny_date(ts: Column) -> Column:
    """Calendar date in New York of a UTC timestamp without zone."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(STATS_ZONE), ts))


def epoch_to_ntz(seconds: Column) -> Column:
    """UTC timestamp without zone of epoch seconds."""
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def expires_at(stored: Column, ttl_s: int) -> Column:
    """End of life of a stored response; a lifetime of zero or less never ends."""
    if ttl_s <= 0:
        return F.lit(None).cast("timestamp_ntz")
    return stored + F.make_dt_interval(secs=F.lit(ttl_s))


def is_live(expires: Column, at: Column) -> Column:
    """Not expired at a time: the end itself no longer counts."""
    return expires.isNull() | (expires > at)


def duration_ms(text: Column) -> Column:
    """Milliseconds of a duration such as `1h2m3.5s`, `250ms` or `0s`; its parts are found by one match."""
    def value(part: Column) -> Column:
        def times(unit: str, factor: int) -> Column:
            return F.substr(part, F.lit(1), F.length(part) - len(unit)).try_cast("double") * factor

        return F.coalesce(
            F.when(part.endswith("ms"), times("ms", 1)).when(part.endswith("s"), times("s", 1000))
            .when(part.endswith("m"), times("m", 60_000)).otherwise(times("h", 3_600_000)), F.lit(0.0))

    total = F.aggregate(F.regexp_extract_all(text, F.lit("[0-9.]+(?:ms|[hms])"), 0), F.lit(0.0), lambda sum_, part: sum_ + value(part))
    return F.when(text != "", F.round(total).cast("bigint"))
