"""The registered queries: each runs one operator over the whole of its input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewaylens.functions import columns as C
from gatewaylens.operators import cache, keys, ledger, limiter, logs, replay, tokens, usage
from gatewaylens.plans.parameters import (
    AS_OF, BODY_LIMIT, BUCKET_RATE, BUCKET_UNIT_S, CACHE_LIMIT, EXCLUDED_USER, IDLE_SINCE, LAST_DAY, LOG_KEEP,
    LOOKUP_TTL_S, POST_DAYS, PROGRESS_STEP_S, SNAPSHOT_AT, TARGET_RPS,
)
from gatewaylens.session import new_path
from gatewaylens.sources import tables
from gatewaylens.sources.views import Tables

Query = Callable[[SparkSession, str], DataFrame]


def _lookup_requests(t: Tables) -> DataFrame:
    """Requests with the target their path stands for; the stored entries carry it without a query."""
    body = F.concat(F.lit("h"), (F.col("id") % 2).cast("string"))
    return t["request_log"].select(
        "id", "method", C.proxied_target(F.col("path")).alias("url"), body.alias("content_hash"), "created_at")


def _categorised(t: Tables) -> DataFrame:
    url = C.proxied_target(F.col("path"), F.col("raw_query"))
    return t["request_log"].select("id", C.api_category(url).alias("category"), "created_at")


def _allocated(t: Tables) -> DataFrame:
    return tokens.allocate_requests(_categorised(t), t["donated_tokens"], t["token_rate_limits"])


def _migrated(t: Tables) -> DataFrame:
    return tokens.migrate_tokens(t["donated_tokens"], t["prod_tokens"], EXCLUDED_USER)


def _rate_of_day() -> Column:
    """A rate that differs by key and day, none on some days."""
    return (F.dayofmonth("created_at") + F.length("api_key")) % 4


def _appended(t: Tables) -> DataFrame:
    """The log as it is served: appended in two goes, and read back."""
    path = new_path(t.spark, "request-log")
    rows = tables.log_rows(t["request_log"])
    for part in (0, 1):
        tables.append_log(rows.where(F.col("id") % 2 == part), path)
    return tables.read_log(t.spark, path)


def _posted(t: Tables) -> DataFrame:
    """The ledger after batches of some days each. After every batch the log is pruned to its newest rows, all that is left of it."""
    path, log = new_path(t.spark, "ledger"), t["request_log"].select("id", "api_key", "cache_hit", "created_at")
    first, last = (d[0] for d in (log.agg(F.min(F.to_date("created_at"))).first(), log.agg(F.max(F.to_date("created_at"))).first()))
    number, left = F.floor(F.datediff(F.to_date("created_at"), F.lit(first)) / POST_DAYS), None
    batches = (last - first).days // POST_DAYS + 1 if first else 0
    for n in range(batches):
        arrived = log.where(number == n)
        ledger.post(arrived, n, path)
        kept = new_path(t.spark, "pruned-log")
        usage.retain_log(arrived if left is None else left.unionByName(arrived), LOG_KEEP).write.parquet(kept)
        left = t.spark.read.parquet(kept)
    return ledger.read(t.spark, batches, path) if batches else ledger.merged(ledger.deltas(log))


def _reported(t: Tables) -> DataFrame:
    """The key report as JSON lines, read back."""
    report, path = usage.key_report(t["api_keys"], t["request_log"]), new_path(t.spark, "report")
    tables.to_json_report(report, path)
    return tables.read_json_report(t.spark, path, report.schema)


def _from_text(t: Tables) -> DataFrame:
    """Access-log lines from text files."""
    path = new_path(t.spark, "access-log")
    t["access_log_lines"].select("line").write.text(path)
    return logs.parse_access_log(tables.read_log_lines(t.spark, path))


def _moved(t: Tables) -> DataFrame:
    earlier = t["request_log"].where(F.col("created_at") < C.instant(SNAPSHOT_AT))
    return usage.stats_delta(usage.system_totals(earlier), usage.system_totals(t["request_log"]))


def _labels(t: Tables) -> DataFrame:
    report = usage.key_report(t["api_keys"], t["request_log"])
    return report.select("id", C.pct_label(F.col("hit_rate")).alias("label"))


def _disabled(t: Tables) -> DataFrame:
    registry = t["api_keys"]
    idle = keys.idle_keys(registry, t["request_log"], IDLE_SINCE)
    return keys.disable_keys(registry, idle).select("id", "disabled", "newly_disabled")


BATCH: dict[str, Callable[[Tables], DataFrame]] = {
    # usage
    "key_usage_7d": lambda t: usage.key_usage(t["request_log"], t["api_keys"], LAST_DAY),
    "request_log_enriched": lambda t: usage.enrich_log(t["request_log"]),
    "category_usage": lambda t: usage.category_usage(t["request_log"]),
    "system_totals": lambda t: usage.system_totals(t["request_log"]),
    "key_report": lambda t: usage.key_report(t["api_keys"], t["request_log"]),
    "recent_activity": lambda t: usage.recent_activity(t["request_log"], t["api_keys"], C.instant(AS_OF)),
    "key_usage_nested": lambda t: usage.key_usage_nested(t["request_log"], t["api_keys"], LAST_DAY),
    "usage_sparkline": lambda t: usage.usage_sparkline(t["request_log"], t["api_keys"], LAST_DAY),
    "log_retention": lambda t: usage.retain_log(t["request_log"].select("id", "api_key", "created_at"), LOG_KEEP),
    "log_append": _appended,
    "ledger_totals": lambda t: ledger.system_totals(_posted(t)),
    "ledger_key_totals": lambda t: ledger.key_totals(_posted(t)),
    "key_report_json": _reported,
    "totals_delta": _moved,
    "hit_rate_labels": _labels,
    # cache
    "cache_entries": lambda t: cache.build_cache_entries(t["responses"], LOOKUP_TTL_S),
    "cache_admission": lambda t: cache.cache_admission(t["responses"]),
    "cache_snapshot": lambda t: cache.cache_snapshot(t["cached_responses"], C.instant(SNAPSHOT_AT)),
    "cache_lookup": lambda t: cache.cache_lookup(_lookup_requests(t), t["cached_responses"]),
    "cache_lookup_mixed": lambda t: cache.cache_lookup(_lookup_requests(t), t["cached_mixed"]),
    "cache_trim": lambda t: cache.trim_cache(
        t["cached_responses"].select("id", "created_at", "resp_bytes"), CACHE_LIMIT, "pass"),
    "cache_trim_budget": lambda t: cache.trim_cache(
        t["cached_responses"].select("id", "created_at", "resp_bytes"), CACHE_LIMIT, "budget"),
    "header_scrub": lambda t: cache.scrubbed_headers(t["responses"]),
    "target_allowlist": lambda t: cache.target_verdicts(t["target_urls"]),
    # tokens
    "token_ranking": lambda t: tokens.rank_tokens(t["donated_tokens"], t["token_rate_limits"]),
    "token_choice": lambda t: tokens.choose_token(t["donated_tokens"], t["token_rate_limits"]),
    "request_allocation": _allocated,
    "rate_limit_snapshot": lambda t: tokens.ingest_rate_limits(t["rate_limit_snapshots"]),
    "rate_limit_merge": lambda t: tokens.merge_rate_limits(t["token_rate_limits"], t["rate_limit_snapshots"]),
    "token_touch": lambda t: tokens.touch_last_ok(t["donated_tokens"], t["rate_limit_snapshots"]),
    "token_upsert": lambda t: tokens.upsert_tokens(t["donated_tokens"], t["donations"]),
    "token_status": lambda t: tokens.token_status(t["token_events"], t["donated_tokens"]),
    "token_intervals": lambda t: tokens.token_intervals(t["token_events"]),
    "token_choice_as_of": lambda t: tokens.choose_token_as_of(_categorised(t), t["donated_tokens"], t["quota_reads"]),
    "token_age": lambda t: tokens.token_age(t["donated_tokens"], C.instant(AS_OF)),
    "donor_summary": lambda t: tokens.donor_summary(t["donated_tokens"], C.instant(AS_OF)),
    "donor_attribution": lambda t: tokens.donor_attribution(_allocated(t), t["donated_tokens"]),
    "token_migration": _migrated,
    "token_reconcile": lambda t: tokens.reconcile_tokens(t["donated_tokens"], _migrated(t), EXCLUDED_USER),
    "migration_sample": lambda t: tokens.migration_sample(_migrated(t), EXCLUDED_USER),
    # keys and ordered state
    "key_onboarding": lambda t: keys.onboard_keys(t["plain_keys"]),
    "key_masking": lambda t: keys.mask_collisions(t["plain_keys"]),
    "key_disable": _disabled,
    "rate_limit_decisions": lambda t: limiter.rate_limit(
        t["request_log"].select("id", "api_key", "created_at"), F.lit(BUCKET_RATE), BUCKET_UNIT_S
    ).select("id", "api_key", "allowed"),
    "rate_limit_changing": lambda t: limiter.rate_limit(
        t["request_log"].select("id", "api_key", "created_at"), _rate_of_day(), BUCKET_UNIT_S
    ).select("id", "api_key", "allowed"),
    "admission_outcomes": lambda t: limiter.admission_outcomes(
        t["request_log"], t["api_keys"], BUCKET_UNIT_S, BODY_LIMIT),
    "cache_replay": lambda t: replay.cache_replay(t["request_log"], LOOKUP_TTL_S),
    # logs and load tests
    "access_log_parse": lambda t: logs.parse_access_log(t["access_log_lines"]),
    "access_log_files": _from_text,
    "log_unparsed": lambda t: logs.unparsed_lines(t["access_log_lines"]),
    "log_errors": lambda t: logs.log_errors(t["access_log_lines"]),
    "log_key_counts": lambda t: logs.log_key_counts(t["access_log_lines"]),
    "latency_profile": lambda t: logs.latency_profile(logs.parse_access_log(t["access_log_lines"])),
    "load_summary": lambda t: logs.load_summary(t["load_results"], TARGET_RPS),
    "load_progress": lambda t: logs.load_progress(t["load_results"], PROGRESS_STEP_S),
}


def _on_tables(build: Callable[[Tables], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return build(Tables(spark, sf_dir))
    return run


def registered() -> dict[str, Query]:
    from gatewaylens.streaming.registered import STREAMS

    batch = {name: _on_tables(build) for name, build in BATCH.items()}
    return {**batch, **{name: _on_tables(build) for name, build in STREAMS.items()}}
