"""Usage reports over the request log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewaylens.functions import columns as C


def enrich_log(log: DataFrame) -> DataFrame:
    """One row per request with its date, target URL, category and key hash (a narrow map)."""
    query = F.col("raw_query") if "raw_query" in log.columns else None
    url = C.proxied_target(F.col("path"), query)
    return log.select(
        "id",
        F.to_date("created_at").alias("log_date"),
        url.alias("url"),
        C.api_category(url).alias("category"),
        C.is_cacheable(F.col("method")).alias("cacheable"),
        C.sha256_hex(C.trimmed(F.col("api_key"))).alias("key_hash"),
    )


def category_usage(log: DataFrame) -> DataFrame:
    """Requests, cache hits and failed requests per category and day."""
    query = F.col("raw_query") if "raw_query" in log.columns else None
    category = C.api_category(C.proxied_target(F.col("path"), query))
    return log.groupBy(category.alias("category"), F.to_date("created_at").alias("log_date")).agg(
        F.count("*").alias("requests"),
        F.count_if("cache_hit").alias("hits"),
        F.count_if(F.col("status") >= 400).alias("bad_status"),
    )


def daily_totals(log: DataFrame) -> DataFrame:
    """Requests and hits per New York date: the mergeable state behind the system totals."""
    return log.groupBy(C.ny_date(F.col("created_at")).alias("ny_date")).agg(
        F.count("*").alias("requests"), F.count_if("cache_hit").alias("cached")
    )


def totals_from_daily(daily: DataFrame) -> DataFrame:
    """The one-row system totals from per-date counts."""
    latest = F.max(F.struct("ny_date", "requests"))
    total, cached = F.coalesce(F.sum("requests"), F.lit(0)), F.coalesce(F.sum("cached"), F.lit(0))
    return daily.agg(
        total.alias("total_requests"),
        cached.alias("total_cached"),
        latest["ny_date"].alias("today_date"),
        F.coalesce(latest["requests"], F.lit(0)).alias("today_requests"),
        C.share_pct(cached, total).alias("hit_pct"),
    )


def system_totals(log: DataFrame) -> DataFrame:
    """Totals, hit share and the count on the newest New York date.

    Counts per date are formed on the map side, so what is shuffled is one row per task and date.
    Totals must come from the whole log or from their own kept table, never from a pruned log.
    """
    return totals_from_daily(daily_totals(log))


def stats_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """How far the counters moved between two system totals."""
    both = before.select(F.lit(-1).alias("sign"), "total_requests", "total_cached").unionByName(
        after.select(F.lit(1).alias("sign"), "total_requests", "total_cached")
    )
    return both.agg(
        F.sum(F.col("sign") * F.col("total_requests")).alias("total_requests"),
        F.sum(F.col("sign") * F.col("total_cached")).alias("total_cached"),
    )


def key_totals(log: DataFrame) -> DataFrame:
    """Requests, hits and last use per key."""
    return log.groupBy("api_key").agg(
        F.count("*").alias("total"),
        F.count_if("cache_hit").alias("cached"),
        F.max("created_at").alias("last_used"),
    )


def key_report(keys: DataFrame, log: DataFrame) -> DataFrame:
    """Every registered key with its totals. Sort by `created_at`, newest first, where it is written out.

    The log is reduced to one row per key before the join; that hot keys collapse on the map side
    keeps the join even.
    """
    total = F.coalesce(F.col("total"), F.lit(0).cast("bigint"))
    cached = F.coalesce(F.col("cached"), F.lit(0).cast("bigint"))
    joined = keys.join(key_totals(log), F.col("key_hash") == F.col("api_key"), "left")
    return joined.select(
        "id",
        C.key_display(F.col("hc_username"), F.col("app_name"), F.col("machine"), F.col("key_hint")).alias("display"),
        total.alias("total"),
        C.hit_rate(cached, total).alias("hit_rate"),
        "last_used",
        "disabled",
        "created_at",
    )


def _window_days(last_day: dt.date, days: int) -> list[dt.date]:
    return [last_day - dt.timedelta(days=back) for back in range(days - 1, -1, -1)]


def usage_series(log: DataFrame, keys: DataFrame, last_day: dt.date, days: int = 7) -> DataFrame:
    """Per key the day counts of the window as one array, zero-filled.

    The window is a handful of days, so each becomes a conditional count: one hash aggregation over
    the log (reduced on the map side) and one join on the key, with no grid of keys and days to build.
    """
    window = _window_days(last_day, days)
    day = F.to_date("created_at")
    inside = log.where(
        (F.col("created_at") >= C.instant(window[0])) & (F.col("created_at") < C.instant(last_day + dt.timedelta(days=1)))
    )
    counts = inside.groupBy("api_key").agg(
        *[F.count_if(day == F.lit(d)).alias(f"day{i}") for i, d in enumerate(window)]
    )
    joined = keys.select("id", "key_hash").join(counts, F.col("key_hash") == F.col("api_key"), "left")
    points = [
        F.struct(F.lit(d).alias("day"), F.coalesce(F.col(f"day{i}"), F.lit(0).cast("bigint")).alias("c"))
        for i, d in enumerate(window)
    ]
    return joined.select("id", F.array(*points).alias("series"))


def key_usage(log: DataFrame, keys: DataFrame, last_day: dt.date, days: int = 7) -> DataFrame:
    """One row per key and day of the window, zero-filled."""
    series = usage_series(log, keys, last_day, days)
    return series.select("id", F.inline("series"))


def key_usage_nested(log: DataFrame, keys: DataFrame, last_day: dt.date, days: int = 7) -> DataFrame:
    """One row per key with its ordered series as `day=count,...`."""
    point = lambda p: F.concat(p["day"].cast("string"), F.lit("="), p["c"].cast("string"))
    series = usage_series(log, keys, last_day, days)
    return series.select("id", F.concat_ws(",", F.transform("series", point)).alias("series"))


def usage_sparkline(log: DataFrame, keys: DataFrame, last_day: dt.date, days: int = 7) -> DataFrame:
    """Each day's count as a share of the key's largest day (of 1 where all are zero)."""
    series = usage_series(log, keys, last_day, days)
    peak = F.greatest(F.lit(1).cast("bigint"), F.array_max(F.transform("series", lambda p: p["c"])))
    rows = series.select("id", peak.alias("peak"), F.inline("series"))
    return rows.select("id", "day", (F.col("c").cast("double") / F.col("peak").cast("double")).alias("scaled"))


def recent_activity(log: DataFrame, keys: DataFrame, as_of: Column, n: int = 1000) -> DataFrame:
    """The newest n requests with the display name of their key ('' for an unknown key).

    The top-n runs first, so that only n rows of the log meet the key table.
    """
    columns = ("id", "api_key", "method", "path", "status", "created_at")
    newest = log.select(*columns).orderBy(F.desc("id")).limit(n)
    return with_display(newest, keys, as_of)


def with_display(newest: DataFrame, keys: DataFrame, as_of: Column) -> DataFrame:
    """Log rows with the display name of their key and their age."""
    names = keys.select(
        "key_hash",
        C.key_display(F.col("hc_username"), F.col("app_name"), F.col("machine"), F.col("key_hint")).alias("name"),
    )
    return newest.join(names, F.col("api_key") == F.col("key_hash"), "left").select(
        "id", "method", "path", "status", "created_at",
        F.coalesce("name", F.lit("")).alias("display"),
        C.short_age(F.col("created_at"), as_of).alias("age"),
    )


def retain_log(log: DataFrame, keep: int = 1000) -> DataFrame:
    """Rows whose id is above the newest id minus `keep`: by id value, not by row count.

    The bound is a scalar subquery as a whole, so the comparison is a plain filter that reaches the scan.
    """
    zero = F.lit(0).cast("bigint")
    below = log.select(F.greatest(F.coalesce(F.max("id"), zero) - F.lit(keep), zero)).scalar()
    return log.where(F.col("id") > below)
