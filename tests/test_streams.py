"""Streams give what the batch form gives, however the input is split; repeated batches change nothing."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gatewaylens.functions import columns as C
from gatewaylens.operators import limiter, replay, tokens, usage
from gatewaylens.schemas import REQUEST_LOG
from gatewaylens.sources import streams, tables
from gatewaylens.sources.views import Tables
from gatewaylens.streaming import decisions, totals

COLUMNS = REQUEST_LOG.names


@pytest.fixture(scope="module")
def log(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return Tables(spark, "/root/testdata/sf0.001")["request_log"].select(*COLUMNS)


@pytest.fixture(scope="module")
def parts(spark, log, tmp_path_factory):
    """The log in five files, in time order."""
    folder = tmp_path_factory.mktemp("log")
    rows = log.withColumn("part", F.ntile(5).over(Window.orderBy("id")))
    for n in range(1, 6):
        made = folder / f"made-{n}"
        rows.where(F.col("part") == n).drop("part").coalesce(1).write.parquet(str(made))
        file = next(made.glob("*.parquet"))
        target = folder / f"part-{n}.parquet"
        target.write_bytes(file.read_bytes())
        os.utime(target, (1_700_000_000 + n, 1_700_000_000 + n))
    return str(folder / "part-*.parquet")


def same(a, b):
    columns = sorted(a.columns)
    assert sorted(b.columns) == columns
    key = lambda row: tuple((v is None, str(v)) for v in row)
    left = sorted((tuple(r[c] for c in columns) for r in a.collect()), key=key)
    assert left == sorted((tuple(r[c] for c in columns) for r in b.collect()), key=key)


def source(spark, parts, each):
    return streams.file_stream(spark, parts, REQUEST_LOG, files_per_batch=each)


def paths(tmp_path):
    return str(tmp_path / "rows"), str(tmp_path / "checkpoint")


@pytest.mark.parametrize("each", [1, 2, 5])
def test_totals(spark, log, parts, tmp_path, each):
    same(totals.stream_system_totals(source(spark, parts, each), *paths(tmp_path)), usage.system_totals(log))


def test_key_totals_and_a_restart(spark, log, parts, tmp_path):
    first = totals.stream_key_totals(source(spark, parts, 2), *paths(tmp_path))
    same(first, usage.key_totals(log))
    same(totals.stream_key_totals(source(spark, parts, 2), *paths(tmp_path)), usage.key_totals(log))
    streams.compact_changes(spark, paths(tmp_path)[0], str(tmp_path / "compact"), ["api_key"])
    same(spark.read.parquet(str(tmp_path / "compact")).drop("batch"), usage.key_totals(log))


def test_recent_and_a_restart(spark, log, parts, tmp_path):
    newest = log.drop("cache_hit").orderBy(F.desc("id")).limit(300)
    same(totals.stream_recent(source(spark, parts, 1), *paths(tmp_path), n=300), newest)
    same(totals.stream_recent(source(spark, parts, 1), *paths(tmp_path), n=300), newest)


@pytest.mark.parametrize("each", [1, 5])
def test_limiter(spark, log, parts, tmp_path, each):
    path, checkpoint = paths(tmp_path)
    streams.append_decisions(decisions.stream_rate_limit(source(spark, parts, each), F.lit(2), 57_600), path, checkpoint)
    batch = limiter.rate_limit(log.select("id", "api_key", "created_at"), F.lit(2), 57_600)
    same(spark.read.parquet(path), batch.select("id", "api_key", "allowed"))


@pytest.mark.parametrize("each", [1, 5])
def test_cache_replay(spark, log, parts, tmp_path, each):
    path, checkpoint = paths(tmp_path)
    streams.append_decisions(decisions.stream_cache_replay(source(spark, parts, each), 21_600), path, checkpoint)
    same(spark.read.parquet(path), replay.cache_replay(log, 21_600))


@pytest.mark.parametrize("each", [2])
def test_large_batches_and_a_restart(spark, log, parts, tmp_path, each):
    path, checkpoint = paths(tmp_path)
    for _ in range(2):
        got = decisions.rate_limit_in_batches(source(spark, parts, each), F.lit(2), 57_600, path, checkpoint)
    batch = limiter.rate_limit(log.select("id", "api_key", "created_at"), F.lit(2), 57_600)
    same(got, batch.select("id", "api_key", "allowed"))
    got = decisions.cache_replay_in_batches(source(spark, parts, each), 21_600, path + "-replay", checkpoint + "-replay")
    same(got, replay.cache_replay(log, 21_600))


def test_files_in_any_order(spark, log, tmp_path):
    """Ten files that come in another order than their rows' times."""
    rows = log.withColumn("part", F.ntile(10).over(Window.orderBy("id")))
    for place, n in enumerate((7, 2, 10, 1, 5, 9, 3, 8, 6, 4)):
        rows.where(F.col("part") == n).drop("part").coalesce(1).write.parquet(str(tmp_path / f"made-{n}"))
        target = tmp_path / f"part-{place}.parquet"
        target.write_bytes(next((tmp_path / f"made-{n}").glob("*.parquet")).read_bytes())
        os.utime(target, (1_700_000_000 + place, 1_700_000_000 + place))
    path, checkpoint = paths(tmp_path)
    source_ = source(spark, str(tmp_path / "part-*.parquet"), 4)
    delay = dt.timedelta(days=60)
    batch = limiter.rate_limit(log.select("id", "api_key", "created_at"), F.lit(2), 57_600).select("id", "api_key", "allowed")
    same(decisions.rate_limit_in_batches(source_, F.lit(2), 57_600, path, checkpoint, delay), batch)
    got = decisions.cache_replay_in_batches(source_, 21_600, path + "-replay", checkpoint + "-replay", delay)
    same(got, replay.cache_replay(log, 21_600))


def test_token_status(spark, log, parts, tmp_path):
    def events(rows):
        body = F.when(F.col("status") == 403, '{"message":"Bad credentials"}').otherwise("{}")
        kind = F.when(F.col("method") == "HEAD", "donation").otherwise("response")
        return rows.select("id", (F.col("api_key").cast("long") % 10).alias("token_id"), "created_at", kind.alias("kind"), "status", body.alias("body"))
    pool = Tables(spark, "/root/testdata/sf0.001")["donated_tokens"]
    got = totals.stream_token_status(events(source(spark, parts, 2)), pool, *paths(tmp_path))
    same(got, tokens.token_status(events(log), pool))


def test_log_is_appended_by_date_from_table_and_stream(spark, log, parts, tmp_path):
    path = str(tmp_path / "log")
    tables.append_log(tables.log_rows(log.where("id < 500")), path)
    tables.append_log(tables.log_rows(log.where("id >= 500")), path)
    kept = tables.read_log(spark, path)
    assert kept.count() == log.count()
    assert kept.where("api_key = '1'").count() == 0
    day = kept.where("log_date = DATE '2024-01-05'")
    assert "PartitionFilters: [isnotnull(log_date" in day._jdf.queryExecution().executedPlan().toString()
    streamed = str(tmp_path / "streamed")
    tables.append_log(tables.log_rows(source(spark, parts, 2)), streamed, str(tmp_path / "streamed-checkpoint")).awaitTermination()
    same(tables.read_log(spark, streamed), kept)
    hashed = log.select(C.sha256_hex(F.col("api_key")).alias("api_key")).distinct()
    assert hashed.join(kept, "api_key", "left_anti").count() == 0


def test_versions_and_reports(spark, tmp_path):
    pool = Tables(spark, "/root/testdata/sf0.001")["donated_tokens"]
    root = str(tmp_path / "pool")
    tables.write_version(pool, root, 1)
    tables.write_version(tables.read_version(spark, root, 1).where("id > 3"), root, 2)
    assert tables.read_version(spark, root, 1).count() > tables.read_version(spark, root, 2).count()
    report = str(tmp_path / "report")
    tables.to_json_report(pool.select("github_user", "revoked"), report)
    assert spark.read.json(report).count() == pool.count()
