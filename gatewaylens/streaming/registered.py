"""The stream queries: they work through the events table as a file stream and return what they wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewaylens.functions import columns as C
from gatewaylens.operators import usage
from gatewaylens.plans.parameters import AS_OF, BUCKET_RATE, BUCKET_UNIT_S, LOOKUP_TTL_S, RECENT_ROWS
from gatewaylens.sources.streams import fresh_paths
from gatewaylens.sources.views import Tables
from gatewaylens.streaming import decisions, totals


def _totals(t: Tables) -> DataFrame:
    return totals.stream_system_totals(t.streaming("request_log"), *fresh_paths(t.spark, "totals"))


def _key_totals(t: Tables) -> DataFrame:
    return totals.stream_key_totals(t.streaming("request_log"), *fresh_paths(t.spark, "key-totals"))


def _recent(t: Tables) -> DataFrame:
    newest = totals.stream_recent(t.streaming("request_log"), *fresh_paths(t.spark, "recent"), n=RECENT_ROWS)
    return usage.with_display(newest, t["api_keys"], C.instant(AS_OF))


def _rate_limit(t: Tables) -> DataFrame:
    log = t.streaming("request_log").select("id", "api_key", "created_at")
    return decisions.rate_limit_in_batches(log, F.lit(BUCKET_RATE), BUCKET_UNIT_S, *fresh_paths(t.spark, "limits"))


def _cache_replay(t: Tables) -> DataFrame:
    return decisions.cache_replay_in_batches(t.streaming("request_log"), LOOKUP_TTL_S, *fresh_paths(t.spark, "replay"))


def _token_status(t: Tables) -> DataFrame:
    return totals.stream_token_status(
        t.streaming("token_events"), t["donated_tokens"], *fresh_paths(t.spark, "token-status")
    )


STREAMS: dict[str, Callable[[Tables], DataFrame]] = {
    "stream_totals": _totals,
    "stream_key_totals": _key_totals,
    "stream_recent": _recent,
    "stream_rate_limit": _rate_limit,
    "stream_cache_replay": _cache_replay,
    "stream_token_status": _token_status,
}
