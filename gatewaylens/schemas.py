"""Table schemas of the gateway data model."""

from __future__ import annotations

from pyspark.sql import types as T

REQUEST_LOG = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("api_key", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("cache_hit", T.BooleanType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

API_KEYS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("key_hash", T.StringType()),
    T.StructField("key_prefix", T.StringType()),
    T.StructField("key_hint", T.StringType()),
    T.StructField("hc_username", T.StringType()),
    T.StructField("app_name", T.StringType()),
    T.StructField("machine", T.StringType()),
    T.StructField("rate_limit_per_sec", T.IntegerType()),
    T.StructField("disabled", T.BooleanType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("last_used_at", T.TimestampNTZType()),
    T.StructField("total_requests", T.LongType()),
    T.StructField("total_cached_requests", T.LongType()),
])

DONATED_TOKENS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("github_user", T.StringType()),
    T.StructField("token", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("revoked", T.BooleanType()),
    T.StructField("last_ok_at", T.TimestampNTZType()),
    T.StructField("scopes", T.StringType()),
])

TOKEN_RATE_LIMITS = T.StructType([
    T.StructField("token_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("rate_limit", T.IntegerType()),
    T.StructField("remaining", T.IntegerType()),
    T.StructField("reset", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

CACHED_RESPONSES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("method", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("resp_headers", T.StringType()),
    T.StructField("resp_body", T.StringType()),
    T.StructField("resp_bytes", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("expires_at", T.TimestampNTZType()),
    T.StructField("content_hash", T.StringType()),
])

# Body of a quota snapshot: one entry per category; `reset` in epoch seconds.
QUOTA_SNAPSHOT = T.StructType([
    T.StructField("resources", T.MapType(T.StringType(), T.StructType([
        T.StructField("limit", T.IntegerType()),
        T.StructField("used", T.IntegerType()),
        T.StructField("remaining", T.IntegerType()),
        T.StructField("reset", T.LongType()),
    ]))),
])

HEADERS = T.MapType(T.StringType(), T.ArrayType(T.StringType()))

# The given `events` table, needed as a declared schema by the file stream source.
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
