"""The response cache as tables: entries, admission, snapshot, lookup, trimming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewaylens.functions import columns as C
from gatewaylens.operators.ordered import prefix_cutoff
from gatewaylens.operators.sweep import best_live

ENTRY_KEY = ("method", "url", "content_hash")  # what two requests must share to share a response


def _store_block(headers: Column) -> Column:
    """The first rule that keeps a response out of the cache, 'ok' where none does."""
    return (
        F.when(~C.is_cacheable(F.col("method")), "method")
        .when(F.col("status") != 200, "status")
        .when(C.forbids_storing(headers), "directive")
        .otherwise("ok")
    )


def cache_admission(responses: DataFrame) -> DataFrame:
    """Whether each response may be stored, and the first rule that decided it."""
    reason = _store_block(C.header_map(F.col("resp_headers")))
    return responses.select(
        "id",
        C.is_cacheable(F.col("method")).alias("cacheable"),
        (reason == "ok").alias("admitted"),
        reason.alias("reason"),
    )


def build_cache_entries(responses: DataFrame, ttl_s: int) -> DataFrame:
    """Cache entries of the admitted responses: what is served again, body hash, size and end of life.

    `resp_headers` is JSON text. The size is that of headers and body in bytes.
    """
    admitted = responses.where(_store_block(C.header_map(F.col("resp_headers"))) == "ok")
    headers, body = (F.coalesce(F.octet_length(c), F.lit(0)) for c in ("resp_headers", "resp_body"))
    return admitted.select(
        "id", "method", "url",
        C.sha256_hex(F.col("req_body")).alias("content_hash"),
        "status", "resp_headers", "resp_body",
        (headers + body).cast("bigint").alias("resp_bytes"),
        "created_at",
        C.expires_at(F.col("created_at"), ttl_s).alias("expires_at"),
    )


def scrubbed_headers(responses: DataFrame) -> DataFrame:
    """One row per header value that may be passed on."""
    kept = C.scrub_headers(C.header_map(F.col("resp_headers")))
    names = responses.select("id", F.explode(kept).alias("header", "list"))
    return names.select("id", "header", F.explode("list").alias("value"))


def target_verdicts(targets: DataFrame) -> DataFrame:
    """Targets by host and verdict: allowed, foreign or malformed."""
    host = C.url_host(F.col("url"))
    verdict = (
        F.when(C.allowed_target(F.col("url")), "allowed").when(host.isNull(), "malformed").otherwise("foreign")
    )
    return targets.groupBy(host.alias("host"), verdict.alias("verdict")).agg(F.count("*").alias("n"))


def cache_snapshot(entries: DataFrame, at: Column, keys: Sequence[str] = ENTRY_KEY) -> DataFrame:
    """The newest live entry of each (method, URL, body hash) at a time.

    Both results are primitive aggregates, so the plan stays a hash aggregation with a map-side step.
    """
    known = entries.where((F.col("created_at") < at) & C.is_live(F.col("expires_at"), at))
    return known.groupBy(*keys).agg(
        F.max("id").alias("entry_id"), F.max_by("expires_at", "id").alias("expires_at")
    )


def _entry_key(keys: Sequence[str]) -> Column:
    """One text for all keys, null where one of them is."""
    parts = [F.col(k).cast("string") for k in keys]
    return F.concat(*[part for k in parts for part in (F.length(k).cast("string"), F.lit(":"), k)])


def cache_lookup(requests: DataFrame, entries: DataFrame, keys: Sequence[str] = ENTRY_KEY, partitions: int | None = None) -> DataFrame:
    """The entry each cacheable request finds: stored before it, still live, newest id; entries may end at any time or never.

    Needs `id, created_at` and the `keys` on both sides. One sweep in (key, time) order: a row per request and entry is shuffled, and
    what is remembered are the live entries that no entry with a larger id outlives. A busy key is spread over chunks.
    """
    asked = requests.where(C.is_cacheable(F.col("method"))).select("id", *keys, "created_at")
    found = best_live(
        asked, entries, lambda: _entry_key(keys), "created_at", F.col("created_at"), F.col("expires_at"), F.col("id"),
        F.struct(F.col("id"), C.micros(F.col("created_at")).alias("at")), "entry", partitions)
    age = F.floor((C.micros(F.col("created_at")) - F.col("entry.at")) / 1_000_000).cast("bigint")
    return found.select("id", F.col("entry.id").alias("entry_id"), age.alias("age_s"))


HOUR_US = 3_600_000_000


def trim_cache(entries: DataFrame, limit_bytes: int, mode: str = "pass") -> DataFrame:
    """Entries left after trimming by size (`resp_bytes`), oldest first (ties by id, rows without a time before all others).

    `pass`: where the cache is over its limit, one pass drops the oldest tenth, at least one row.
    `budget`: drops the oldest rows until what is left fits the limit. A limit of zero or less trims nothing.
    Both find one cutoff row exactly and turn the trim into a filter: one scan gives rows and bytes per hour, and
    the row is looked for inside the hour that holds it.
    """
    if mode not in ("pass", "budget"):
        raise ValueError(f"unknown trim mode {mode!r}")
    if limit_bytes <= 0:
        return entries
    size = F.coalesce(F.col("resp_bytes").cast("bigint"), F.lit(0).cast("bigint"))
    at_us = C.micros(F.col("created_at"))
    # A row per hour of the cache's age, whatever its number of entries.
    hours = entries.groupBy(F.expr(f"floor(unix_micros(CAST(created_at AS TIMESTAMP)) / {HOUR_US})").alias("hour")).agg(
        F.sum(size).alias("bytes"), F.count("*").alias("rows"), F.min(at_us).alias("low"), F.max(at_us).alias("high")).collect()
    total, rows = sum(h["bytes"] for h in hours), sum(h["rows"] for h in hours)
    if total <= limit_bytes:
        return entries
    weight, need = (F.lit(1).cast("bigint"), max(1, rows // 10)) if mode == "pass" else (size, total - limit_bytes)
    for hour in sorted(hours, key=lambda h: (h["hour"] is not None, h["hour"])):
        inside = hour["rows"] if mode == "pass" else hour["bytes"]
        if inside >= need:
            break
        need -= inside
    if hour["hour"] is None:
        cut = prefix_cutoff(entries.where("created_at IS NULL"), ["id"], weight, need)
        return entries.where(F.col("created_at").isNotNull() | (F.col("id") > cut["id"]))
    cut = prefix_cutoff(entries, ["created_at", "id"], weight, need, known=(hour["low"], hour["high"]))
    at = F.timestamp_micros(F.lit(cut["created_at"])).cast("timestamp_ntz")
    return entries.where((F.col("created_at") > at) | ((F.col("created_at") == at) & (F.col("id") > cut["id"])))
