"""Gateway tables derived from the given star-schema tables, as SQL both Spark and DuckDB accept.

The same text feeds the Spark queries (as temp views' common table expressions) and the SQL twins.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gatewaylens.schemas import EVENTS
from gatewaylens.sources.streams import BYTES_PER_BATCH, file_stream

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# One SELECT per derived table, in dependency order.
VIEWS: dict[str, str] = {
    "request_log": r"""
SELECT event_id AS id, CAST(user_id AS STRING) AS api_key,
  CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'HEAD' ELSE 'GET' END AS method,
  CASE k % 8 WHEN 0 THEN '/gh/graphql' WHEN 1 THEN '/gh/search/code' WHEN 2 THEN '/gh/search/repositories'
             WHEN 3 THEN '/gh/search/issues'
             ELSE '/gh/repos/o' || CAST(k % 5 AS STRING) || '/r' || CAST(k AS STRING) END AS path,
  CASE WHEN k % 3 = 0 THEN 'page=' || CAST(k AS STRING) ELSE '' END AS raw_query,
  CASE WHEN event_type <> 'error' THEN 200
       ELSE CASE k % 4 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 404 ELSE 500 END END AS status,
  (event_type IN ('view','click','signup') AND value < 20) AS cache_hit,
  ts AS created_at, value AS latency_ms, CAST(k * 20000 AS BIGINT) AS body_bytes, k
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e
""",
    "api_keys": r"""
SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 9 THEN 'other' ELSE '' END || CAST(c_custkey AS STRING) AS key_hash,
  lower(c_mktsegment) AS hc_username,
  'app' || CAST(c_custkey % 7 AS STRING) AS app_name, 'm' || CAST(c_nationkey AS STRING) AS machine,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE substr(c_name, length(c_name) - 5, 6) END AS key_hint,
  CAST(c_custkey % 10 + 1 AS INT) AS rate_limit_per_sec, (c_acctbal < 0) AS disabled, f.first_order AS created_at
FROM customer
LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY o_custkey) f
  ON f.o_custkey = c_custkey
""",
    "plain_keys": r"""
SELECT c_custkey AS id, lower(c_mktsegment) || '_app' || CAST(c_custkey % 7 AS STRING) || '_m'
    || CAST(c_nationkey AS STRING) || '_' || substr(md5(c_name), 1, 24) AS plain_key,
  CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN '-5'
       ELSE CAST(c_custkey % 50 + 1 AS STRING) END AS rate_text,
  lower(c_mktsegment) AS hc_username, 'app' || CAST(c_custkey % 7 AS STRING) AS app_name,
  'm' || CAST(c_nationkey AS STRING) AS machine, (SELECT min(ts) FROM events) AS created_at
FROM customer
""",
    "donated_tokens": r"""
SELECT s_suppkey AS id, lower(replace(s_name, ' ', '_')) AS github_user, 'tok' || CAST(s_suppkey AS STRING) AS token,
  m.first_ship AS created_at, (s_acctbal < 0) AS revoked,
  CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE m.last_ship END AS last_ok_at,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'read:user' END AS scopes
FROM supplier
LEFT JOIN (SELECT l_suppkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
           FROM lineitem GROUP BY l_suppkey) m ON m.l_suppkey = s_suppkey
""",
    "token_rate_limits": r"""
SELECT token_id, category, 5000 AS rate_limit,
  CAST(round(sum(l_quantity)) AS BIGINT) % 50 AS remaining, max(l_shipdate) AS reset
FROM (SELECT l_suppkey + CASE WHEN l_suppkey % 6 = 0 THEN 1000000 ELSE 0 END AS token_id,
        CASE l_partkey % 5 WHEN 0 THEN 'core' WHEN 1 THEN 'search' WHEN 2 THEN 'code_search' WHEN 3 THEN 'graphql'
          ELSE 'dependency_snapshots' END AS category,
        l_quantity, l_shipdate FROM lineitem) x
GROUP BY token_id, category
""",
    "rate_limit_snapshots": r"""
SELECT o_orderkey AS snap_id, o_custkey % (SELECT count(*) FROM supplier) AS token_id, o_orderdate AS fetched_at,
  '{"resources":{"core":{"limit":5000,"used":' || CAST(o_orderkey % 5000 AS STRING) || ',"remaining":'
  || CAST(5000 - o_orderkey % 5000 AS STRING) || ',"reset":' || CAST(1691591363 + o_orderkey AS STRING)
  || '},"search":{"limit":30,"used":' || CAST(o_orderkey % 30 AS STRING) || ',"remaining":'
  || CAST(30 - o_orderkey % 30 AS STRING) || ',"reset":' || CAST(1691591091 + o_orderkey AS STRING) || '}}}' AS body
FROM orders
""",
    "donations": r"""
SELECT o_orderkey AS donation_id,
  COALESCE(lower(replace(s_name, ' ', '_')), 'new_' || CAST(o_custkey % 200 AS STRING)) AS github_user,
  'don' || CAST(o_orderkey AS STRING) AS token, 'read:user' AS scopes, o_orderdate AS donated_at
FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey % 200 AND o_custkey % 200 < 120
""",
    "prod_tokens": r"""
SELECT id + 1000000 AS id,
  CASE WHEN id % 9 = 0 OR id % 3 <> 0 THEN 'prod_only_' || CAST(id AS STRING) ELSE github_user END AS github_user,
  'old' || CAST(id AS STRING) AS token, created_at, (id % 2 = 0) AS revoked, last_ok_at, 'repo' AS scopes
FROM donated_tokens
""",
    "token_events": r"""
SELECT id, CAST(api_key AS BIGINT) % (SELECT count(*) FROM supplier) AS token_id, created_at,
  CASE WHEN method = 'HEAD' AND k % 10 = 0 THEN 'donation' ELSE 'response' END AS kind, status,
  CASE WHEN status = 403 AND k % 3 = 0 THEN '{"message":"Bad credentials"}'
       WHEN status = 403 AND k % 3 = 1 THEN '{"message":"API rate limit exceeded"}'
       WHEN status = 403 THEN 'oops' ELSE '{}' END AS body
FROM request_log
""",
    "quota_reads": r"""
SELECT id AS snap_id, CAST(api_key AS BIGINT) % (SELECT count(*) FROM supplier) AS token_id, created_at AS fetched_at,
  '{"resources":{"core":{"limit":5000,"used":0,"remaining":' || CAST(id * 7919 % 500 AS STRING) || ',"reset":'
  || CAST(1691591363 + id % 97 AS STRING) || '}' || CASE WHEN k % 2 = 0 THEN ',"search":{"limit":30,"used":0,"remaining":'
  || CAST(id * 31 % 30 AS STRING) || ',"reset":' || CAST(1691591091 + id % 89 AS STRING) || '}' ELSE '' END || '}}' AS body
FROM request_log
""",
    "responses": r"""
SELECT id, method, 'https://api.github.com' || substr(path, 4) AS url, status, created_at, '' AS req_body,
  CASE k % 6 WHEN 5 THEN '{"Etag":["e' || CAST(k AS STRING) || '"],"Transfer-Encoding":["chunked"]}'
       ELSE '{"Cache-Control":["' || CASE k % 6 WHEN 0 THEN 'No-Cache' WHEN 1 THEN 'private, no-store'
            WHEN 2 THEN 'public, max-age=60' ELSE 'private' END
            || '"],"Set-Cookie":["s=1"],"Connection":["close"],"Etag":["e' || CAST(k AS STRING) || '"]}' END AS resp_headers,
  '{"k":' || CAST(k AS STRING) || ',"o":"é' || repeat('x', k) || '"}' AS resp_body
FROM request_log
""",
    "cached_responses": r"""
SELECT id, method, 'https://api.github.com' || substr(path, 4) AS url, 'h' || CAST(id % 2 AS STRING) AS content_hash, status,
  created_at, created_at + INTERVAL '6' HOUR AS expires_at, CAST(round(latency_ms * 1000) AS BIGINT) AS resp_bytes
FROM request_log WHERE method IN ('GET','HEAD') AND status = 200 AND NOT cache_hit
""",
    "cached_mixed": r"""
SELECT id % 7 * 1000000000000 + id AS id, method, url, content_hash, created_at,
  CASE WHEN id % 50 = 0 THEN NULL WHEN id % 3 = 0 THEN created_at + INTERVAL '37' HOUR
       WHEN id % 3 = 1 THEN expires_at ELSE created_at + INTERVAL '95' MINUTE END AS expires_at
FROM cached_responses
""",
    "target_urls": r"""
SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN 'https://api.github.com/repos/p' || CAST(page_id AS STRING)
  WHEN 1 THEN 'http://api.github.com/user' WHEN 2 THEN 'not a url' ELSE url END AS url
FROM pages
""",
    "load_results": r"""
SELECT id, created_at AS ts, latency_ms, (status >= 200 AND status < 300) AS ok,
  CASE WHEN cache_hit THEN 'hit' WHEN method = 'POST' THEN NULL ELSE 'miss' END AS cache_status
FROM request_log
""",
    "access_log_lines": r"""
SELECT id, CASE WHEN k % 40 = 7 THEN 'restart: could not read status (1s), will fail' ELSE
  replace(substr(CAST(created_at AS STRING), 1, 19), '-', '/') || ' ' || method || ' ' || path
  || CASE k % 9 WHEN 1 THEN '/a b' WHEN 2 THEN '/a' || chr(1) || 'b' WHEN 3 THEN '/q"uo' WHEN 4 THEN '/x 200 (1s) ua="u" key=v'
       WHEN 5 THEN '/é' ELSE '' END || ' '
  || CAST(status AS STRING) || ' ('
  || CASE k % 5 WHEN 0 THEN CAST(k + 1 AS STRING) || 'ms' WHEN 1 THEN CAST(k % 50 AS STRING) || '.25s'
       WHEN 2 THEN '1m' || CAST(k % 60 AS STRING) || 's' WHEN 3 THEN '0s' ELSE '12.5s' END
  || ') ua="curl/8.' || CAST(k % 4 AS STRING) || '" key='
  || CASE WHEN k % 20 = 0 THEN '***' ELSE 'usr_ap…' || lpad(api_key, 4, '0') END END AS line
FROM request_log
""",
}


def _needed(name: str, found: dict[str, None]) -> None:
    for word in re.findall(r"[a-z_]+", VIEWS[name]):
        if word in VIEWS and word != name and word not in found:
            _needed(word, found)
    found[name] = None


def ctes(*names: str) -> str:
    """`name AS (SELECT ...), ...` for the named views and those they build on."""
    found: dict[str, None] = {}
    for name in names:
        if name not in found:
            _needed(name, found)
    return ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in found)


def with_views(body: str, *names: str) -> str:
    """`body` with the named views in front, as one SQL text."""
    return f"WITH {ctes(*names)}\n{body.strip()}"


class Tables:
    """The given tables of one folder and the derived views over them, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._read: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._read:
            reader = self.spark.read.schema(EVENTS) if name == "events" else self.spark.read
            self._read[name] = reader.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._read[name]

    def __getitem__(self, view: str) -> DataFrame:
        return self._view(view, self.base)

    def streaming(self, view: str, bytes_per_batch: int = BYTES_PER_BATCH) -> DataFrame:
        """A view over the events table read as a file stream."""
        def source(name: str) -> DataFrame:
            if name != "events":
                return self.base(name)
            return file_stream(self.spark, self._events_path(), EVENTS, bytes_per_batch=bytes_per_batch)
        return self._view(view, source)

    def _events_path(self) -> str:
        """The folder, or for a table that is one file a pattern of just that name, as the stream source takes no file."""
        path = f"{self.sf_dir}/events.parquet"
        listed = self.spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
        return f"{self.sf_dir}/events.parque[t]" if listed and listed[0]["path"].endswith("/events.parquet") else path

    def _view(self, view: str, source: Callable[[str], DataFrame]) -> DataFrame:
        text = with_views(f"SELECT * FROM {view}", view)
        for table in BASE_TABLES:
            if re.search(rf"\b{table}\b", text):
                source(table).createOrReplaceTempView(table)
        return self.spark.sql(text)
