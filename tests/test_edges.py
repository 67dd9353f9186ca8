"""Hand-made tables: nulls, ties, empty input, unknown keys, exact boundaries."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from gatewaylens.functions import columns as C
from gatewaylens.operators import cache, keys, ledger, limiter, logs, replay, sweep, tokens, usage

LOG = "id long, api_key string, method string, path string, status int, cache_hit boolean, created_at timestamp_ntz, body_bytes long"
KEYS = "id long, key_hash string, hc_username string, app_name string, machine string, key_hint string, rate_limit_per_sec int, disabled boolean, created_at timestamp_ntz"
POOL = "id long, github_user string, token string, created_at timestamp_ntz, revoked boolean, last_ok_at timestamp_ntz, scopes string"
T0 = dt.datetime(2024, 3, 1, 12)


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def log(spark, *rows):
    return spark.createDataFrame(
        [(i, key, method, path, status, hit, when, body) for i, key, method, path, status, hit, when, body in rows], LOG
    )


def req(i, key="a", when=T0, method="GET", path="/gh/user", status=200, hit=False, body=0):
    return (i, key, method, path, status, hit, when, body)


def values(spark, column, *args):
    names = [f"c{n}" for n in range(len(args[0]))]
    kinds = ", ".join(f"{n} string" for n in names)
    df = spark.createDataFrame([tuple(a) for a in args], kinds)
    return [r[0] for r in df.select(column(*[F.col(n) for n in names])).collect()]


def test_scalars_on_text(spark):
    assert values(spark, C.mask_key, ["  "], ["abcdef"], [" abcdefg\n"], ["ünïcode"], ["ab\tcdefgh"]) == [
        "***", "***", "abcdef…defg", "ünïcod…code", "ab\tcde…efgh"]
    assert values(spark, C.key_hint, ["u_app_m_0123456789"], ["nothing"], ["ends_"], ["a_b"]) == ["012345", "", "", "b"]
    assert values(spark, C.rate_or_default, ["7"], [""], ["abc"], ["-5"], ["0"], ["+3"], [" 4"], ["99999999999"], [None]) == [
        7, 10, 10, 10, 10, 3, 10, 10, 10]
    assert values(spark, C.duration_ms, ["123ms"], ["1.5s"], ["1m2s"], ["0s"], ["1h2m3.5s"], ["2m"], [""]) == [
        123, 1500, 62_000, 0, 3_723_500, 120_000, None]
    assert values(spark, C.api_category, ["x/search/code?q=/graphql"], ["x/search/code"], ["x/search/issues"], ["x/searchy"]) == [
        "graphql", "code_search", "search", "core"]
    assert values(spark, C.target_url, ["b/", "p", ""], ["b/", "p", "q=1"], ["b/", "p?x=1", "q=1"], ["b/", "p", None]) == [
        "b/p", "b/p?q=1", "b/p?x=1&q=1", "b/p"]
    display = values(spark, C.key_display, ["u", "a", "m", "h"], ["u", "a", "m", ""], ["u", "a", "m", None])
    assert display == ["u_a_m_h", "u_a_m", "u_a_m"]


def test_target_allowlist_follows_url_parsing(spark):
    urls = ["https://api.github.com/x", "HTTPS://api.github.com/x", "https://API.github.com/x", "https://api.github.com:443/x",
            "https://u@api.github.com/x", "https://api.github.com.evil.io/", "http://api.github.com/", "not a url", "/relative", None]
    allowed = values(spark, C.allowed_target, *[[u] for u in urls])
    assert allowed == [True, True, False, False, True, False, False, False, False, False]


def test_ages(spark):
    seconds = [0, 59, 60, 3599, 3600, 86_399, 86_400, 29 * 86_400, 30 * 86_400, 359 * 86_400, 360 * 86_400, 800 * 86_400]
    df = spark.createDataFrame([(s,) for s in seconds], "s long")
    words = [r[0] for r in df.select(C.humanize_age(F.col("s"))).collect()]
    assert words == ["just now", "just now", "1 minutes ago", "59 minutes ago", "1 hours ago", "23 hours ago", "1 days ago",
                     "29 days ago", "1 months ago", "11 months ago", "1 years ago", "2 years ago"]
    short = df.select(C.short_age(C.instant(T0) - F.make_dt_interval(secs=F.col("s")),
                                  C.instant(T0)))
    assert [r[0] for r in short.collect()][:6] == ["1s ago", "59s ago", "1m ago", "59m ago", "1h ago", "23h ago"]


def test_percent_label(spark):
    labels = spark.createDataFrame([(0.0,), (41.26,), (100.0,)], "p double").select(C.pct_label(F.col("p"))).collect()
    assert [r[0] for r in labels] == ["0.0%", "41.3%", "100.0%"]


def test_new_york_dates_on_both_clock_changes(spark):
    stamps = {  # UTC time: date in New York
        dt.datetime(2024, 3, 10, 4, 59): dt.date(2024, 3, 9), dt.datetime(2024, 3, 10, 5, 0): dt.date(2024, 3, 10),
        dt.datetime(2024, 3, 11, 3, 59): dt.date(2024, 3, 10), dt.datetime(2024, 3, 11, 4, 0): dt.date(2024, 3, 11),
        dt.datetime(2024, 11, 3, 3, 59): dt.date(2024, 11, 2), dt.datetime(2024, 11, 3, 4, 0): dt.date(2024, 11, 3),
        dt.datetime(2024, 11, 4, 4, 59): dt.date(2024, 11, 3), dt.datetime(2024, 11, 4, 5, 0): dt.date(2024, 11, 4),
    }
    df = spark.createDataFrame([(t,) for t in stamps], "t timestamp_ntz")
    assert [r[0] for r in df.select(C.ny_date(F.col("t"))).collect()] == list(stamps.values())


def test_empty_log(spark):
    empty = log(spark)
    totals = usage.system_totals(empty).first()
    assert (totals["total_requests"], totals["total_cached"], totals["today_date"], totals["today_requests"], totals["hit_pct"]) == (
        0, 0, None, 0, 0.0)
    assert usage.retain_log(empty).count() == 0
    assert limiter.rate_limit(empty, F.lit(2)).count() == 0
    assert replay.cache_replay(empty, 60).count() == 0
    registry = spark.createDataFrame([(1, "a", "u", "ap", "m", None, 2, False, T0)], KEYS)
    row = usage.key_report(registry, empty).first()
    assert (row["display"], row["total"], row["hit_rate"], row["last_used"]) == ("u_ap_m", 0, 0.0, None)
    assert [r["c"] for r in usage.key_usage(empty, registry, dt.date(2024, 3, 1)).collect()] == [0] * 7
    assert {r["scaled"] for r in usage.usage_sparkline(empty, registry, dt.date(2024, 3, 1)).collect()} == {0.0}


def test_unknown_key_has_no_display_and_usage_ignores_it(spark):
    rows = log(spark, req(1, "a", at(0)), req(2, "nobody", at(5), hit=True))
    registry = spark.createDataFrame([(1, "a", "u", "ap", "m", "", 2, False, T0)], KEYS)
    as_of = C.instant(at(65))
    shown = {r["id"]: (r["display"], r["age"]) for r in usage.recent_activity(rows, registry, as_of).collect()}
    assert shown == {1: ("u_ap_m", "1m ago"), 2: ("", "1m ago")}
    assert sum(r["c"] for r in usage.key_usage(rows, registry, dt.date(2024, 3, 1)).collect()) == 1


def test_retention_goes_by_id_value_and_keeps_totals(spark):
    rows = log(spark, *[req(i, when=at(i)) for i in (0, 1, 500, 1400, 1500, 2400)])
    kept = sorted(r["id"] for r in usage.retain_log(rows, 1000).collect())
    assert kept == [1500, 2400]
    few = log(spark, req(0), req(1), req(7))
    assert sorted(r["id"] for r in usage.retain_log(few, 1000).collect()) == [1, 7]
    delta = usage.stats_delta(usage.system_totals(few), usage.system_totals(rows)).first()
    assert tuple(delta) == (3, 0)


ENTRY = "id long, method string, url string, content_hash string, created_at timestamp_ntz, expires_at timestamp_ntz, resp_bytes long"
ASK = "id long, method string, url string, content_hash string, created_at timestamp_ntz"


def test_lookup_boundaries(spark):
    entries = spark.createDataFrame([
        (1, "GET", "u", "h", at(0), at(60), 1), (2, "GET", "u", "h", at(10), at(70), 1), (3, "GET", "u", "other", at(10), at(70), 1),
    ], ENTRY)
    asks = spark.createDataFrame([
        (10, "GET", "u", "h", at(0)), (11, "GET", "u", "h", at(1)), (12, "GET", "u", "h", at(11)),
        (13, "GET", "u", "h", at(70)), (14, "GET", "u", "h", at(69.5)), (15, "HEAD", "u", "h", at(20)), (16, "POST", "u", "h", at(20)),
        (17, "GET", "u", "h", at(10)),
    ], ASK)
    got = {r["id"]: (r["entry_id"], r["age_s"]) for r in cache.cache_lookup(asks, entries).collect()}
    assert got == {10: (None, None), 11: (1, 1), 12: (2, 1), 13: (None, None), 14: (2, 59), 15: (None, None), 17: (1, 10)}


def test_lookup_with_mixed_lifetimes_takes_the_newest_live_entry(spark):
    entries = spark.createDataFrame([
        (1, "GET", "u", "h", at(0), None, 1), (2, "GET", "u", "h", at(10), at(20), 1), (3, "GET", "u", "h", at(12), at(112), 1),
        (4, "GET", "u", "h", at(15), at(25), 1),
    ], ENTRY)
    asks = spark.createDataFrame([(10 + n, "GET", "u", "h", at(s)) for n, s in enumerate((5, 11, 14, 16, 30, 200))], ASK)
    got = {r["id"]: r["entry_id"] for r in cache.cache_lookup(asks, entries).collect()}
    assert got == {10: 1, 11: 2, 12: 3, 13: 4, 14: 3, 15: 1}


def test_snapshot_keeps_the_newest_live_duplicate(spark):
    entries = spark.createDataFrame([
        (1, "GET", "u", "h", at(0), None, 1), (2, "GET", "u", "h", at(1), at(50), 1), (3, "GET", "u", "h", at(2), at(30), 1),
        (4, "GET", "u", "h", at(40), at(90), 1),
    ], ENTRY)
    row = cache.cache_snapshot(entries, C.instant(at(30))).collect()
    assert [(r["entry_id"], r["expires_at"]) for r in row] == [(2, at(50))]


def test_trim_modes(spark):
    rows = [(i, "GET", "u", "h", at(i // 3), None, 10) for i in range(25)]
    entries = spark.createDataFrame(rows, ENTRY)
    left = lambda limit, mode: sorted(r["id"] for r in cache.trim_cache(entries, limit, mode).collect())
    assert left(0, "pass") == list(range(25)) and left(250, "pass") == list(range(25))
    assert left(249, "pass") == list(range(2, 25))
    assert left(200, "budget") == list(range(5, 25)) and left(195, "budget") == list(range(6, 25))
    one = spark.createDataFrame(rows[:1], ENTRY)
    assert cache.trim_cache(one, 5, "pass").count() == 0


def test_lookup_takes_the_newest_id_of_any_lives(spark):
    draw = random.Random(3)
    entries = [(n, "GET", f"u{draw.randrange(3)}", "h", at(a := draw.uniform(-1e5, 1e5)), None if draw.random() < 0.1 else at(a + draw.uniform(-5, 5e4)), 1)
               for n in draw.sample(range(1000), 120)]
    asks = [(5000 + n, "GET", f"u{draw.randrange(4)}", "h", at(draw.uniform(-1e5, 1.5e5))) for n in range(200)]
    asks += [(6000 + n, "GET", e[2], "h", e[4] + dt.timedelta(microseconds=n % 2)) for n, e in enumerate(entries)]
    got = {r["id"]: r["entry_id"] for r in cache.cache_lookup(
        spark.createDataFrame(asks, ASK), spark.createDataFrame(entries, ENTRY)).collect()}
    assert got == {i: max((e[0] for e in entries if e[2] == url and e[4] < t and (e[5] is None or e[5] > t)), default=None)
                   for i, _, url, _, t in asks}


def test_skyline_equals_a_list_of_all_live_spans():
    draw = random.Random(8)
    sky, kept, now = sweep.Skyline(), [], 0
    for n in range(3000):
        now += draw.randrange(4)
        if draw.random() < 0.6:
            span = (draw.randrange(40), now + draw.randrange(1, 60), n)
            sky.add(*span)
            kept.append(span)
        else:
            live = [s for s in kept if s[1] > now]
            best = max(live, key=lambda s: s[:2], default=None)
            found = sky.best(now)
            assert (found is None) == (best is None) and (best is None or [s for s in live if s[2] == found][0][:2] == best[:2])
    assert len(sky.ranks) < 41 and sky.ranks == sorted(sky.ranks) and sky.ends == sorted(sky.ends, reverse=True)


def test_sweep_carries_the_skyline_over_many_chunks(spark):
    draw = random.Random(5)
    spans = [(n, draw.choice(["a", "a", "a", "b", None]), at(b := draw.uniform(0, 5000)), None if n % 40 == 0 else at(b + draw.uniform(-1, 3000)), [draw.randrange(30), n])
             for n in range(400)]
    probes = [(n, draw.choice(["a", "a", "b", "c", None]), at(draw.uniform(-10, 9000)) if n % 50 else None) for n in range(500)]
    found = sweep.best_live(
        spark.createDataFrame(probes, "id long, k string, t timestamp_ntz"),
        spark.createDataFrame(spans, "n long, k string, b timestamp_ntz, e timestamp_ntz, r array<long>"),
        lambda: F.col("k"), "t", F.col("b"), F.col("e"), F.col("r"), F.col("n"), "best", partitions=20).collect()
    assert {r["id"]: r["best"] for r in found} == {
        i: max(((s[4], s[0]) for s in spans if t and k and s[1] == k and s[2] < t and (s[3] is None or s[3] > t)), default=(0, None))[1]
        for i, k, t in probes}
    assert len(found) == 500


def test_trim_with_rows_without_a_time_or_size(spark):
    rows = [(1, "GET", "u", "h", None, None, 100), (2, "GET", "u", "h", at(0), None, 10), (3, "GET", "u", "h", at(9999), None, 10)]
    left = lambda rows, limit, mode: sorted(r["id"] for r in cache.trim_cache(spark.createDataFrame(rows, ENTRY), limit, mode).collect())
    assert left(rows, 110, "budget") == [2, 3] and left(rows, 15, "budget") == [3] and left(rows, 110, "pass") == [2, 3]
    assert left(rows[:1], 5, "budget") == [] and left([], 5, "pass") == []
    empty = [(n, "GET", "u", "h", at(n), None, 0) for n in range(5)] + [(9, "GET", "u", "h", None, None, 50), (8, "GET", "u", "h", None, None, 50)]
    assert left(empty, 60, "budget") == [0, 1, 2, 3, 4, 9]


def test_entries_compose_with_lookup_and_trim(spark):
    rows = [(n, "GET", "u", 200, at(n), "", "{}", "b" * n) for n in range(1, 6)]
    entries = cache.build_cache_entries(spark.createDataFrame(rows, RESPONSE), 60)
    assert {r["id"]: r["resp_bytes"] for r in entries.collect()} == {n: n + 2 for n in range(1, 6)}
    kept = cache.trim_cache(entries, 20, "budget")
    asks = spark.createDataFrame([(9, "GET", "u", hashlib.sha256(b"").hexdigest(), at(5.5))], ASK)
    assert cache.cache_lookup(asks, kept).first()["entry_id"] == 5 and kept.count() == 3


RESPONSE = "id long, method string, url string, status int, created_at timestamp_ntz, req_body string, resp_headers string, resp_body string"


def test_admission_reads_the_first_directive_only(spark):
    def response(i, headers, method="GET", status=200):
        return (i, method, "u", status, T0, "", json.dumps(headers), None)
    rows = spark.createDataFrame([
        response(1, {"Cache-Control": ["private", "no-store"]}), response(2, {"Cache-Control": ["NO-STORE"]}),
        response(3, {}), response(4, {"Cache-Control": []}), response(5, {}, "POST"), response(6, {}, status=404),
    ], RESPONSE)
    got = {r["id"]: r["reason"] for r in cache.cache_admission(rows).collect()}
    assert got == {1: "ok", 2: "directive", 3: "ok", 4: "ok", 5: "method", 6: "status"}
    stored = cache.build_cache_entries(rows, 0).collect()
    assert {r["id"] for r in stored} == {1, 3, 4} and {r["expires_at"] for r in stored} == {None}
    headers = spark.createDataFrame([response(1, {"set-COOKIE": ["a"], "X": ["1", "2"], "TE": ["t"], "Vary": []})], RESPONSE)
    assert sorted((r["header"], r["value"]) for r in cache.scrubbed_headers(headers).collect()) == [("X", "1"), ("X", "2")]


def test_outcomes_in_order(spark):
    registry = spark.createDataFrame([
        (1, "on", "u", "a", "m", "", 1, False, T0), (2, "off", "u", "a", "m", "", 5, True, T0), (3, "zero", "u", "a", "m", "", 0, False, T0),
    ], KEYS)
    rows = log(spark, req(1, " ", at(0)), req(2, None, at(0)), req(3, "off", at(0), body=99), req(4, "nobody", at(0)),
               req(5, "zero", at(0)), req(6, "on", at(0), body=99), req(7, "on", at(0.5)), req(8, "on", at(1), body=10))
    got = {r["id"]: r["outcome"] for r in limiter.admission_status(rows, registry, 1, 10).collect()}
    assert got == {1: "401", 2: "401", 3: "403", 4: "429", 5: "429", 6: "413", 7: "429", 8: "pass"}
    counts = {r["outcome"]: (r["requests"], r["keys"]) for r in limiter.admission_outcomes(rows, registry, 1, 0).collect()}
    assert counts["pass"] == (2, 1) and counts["401"] == (2, 1)


def test_replay_boundaries_and_statuses(spark):
    rows = log(spark, req(1, when=at(0), status=500), req(2, when=at(1)), req(3, when=at(1)), req(4, when=at(10.999999)),
               req(5, when=at(11), status=404), req(6, when=at(12)), req(7, method="HEAD", when=at(12)), req(8, method="PUT", when=at(12)))
    got = {r["id"]: r["hit"] for r in replay.cache_replay(rows, 10).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: False, 6: False, 7: False}


def pool(spark, *rows):
    return spark.createDataFrame(list(rows), POOL)


LIMITS = "token_id long, category string, rate_limit int, remaining long, reset timestamp_ntz"


def test_ranking_puts_a_missing_quota_row_before_a_spent_one(spark):
    tokens_df = pool(spark, (1, "a", "t", T0, False, at(9), None), (2, "b", "t", T0, False, None, None),
                     (3, "c", "t", T0, True, None, None), (4, "d", "t", T0, False, at(1), None), (5, "e", "t", T0, False, None, None))
    limits = spark.createDataFrame([(1, "core", 60, 0, at(5)), (4, "core", 60, 9, at(50)), (3, "core", 60, 99, at(1))], LIMITS)
    ranked = tokens.rank_tokens(tokens_df, limits).where("category = 'core'").orderBy("rank").collect()
    assert [r["token_id"] for r in ranked] == [4, 2, 5, 1]
    best = {r["category"]: r["token_id"] for r in tokens.choose_token(tokens_df, limits).collect()}
    assert best == {"core": 4, "search": 2, "code_search": 2, "graphql": 2}


def test_allocation_equals_taking_the_fullest_token_each_time(spark):
    tokens_df = pool(spark, *[(i, f"u{i}", "t", T0, i == 4, at(i) if i % 2 else None, None) for i in range(1, 8)])
    limits = [(i, "core", 60, (i * 7) % 5, at(i % 3)) for i in range(1, 7)]
    asks = spark.createDataFrame([(n, "core" if n % 4 else "search", at(n % 5)) for n in range(40)],
                                 "id long, category string, created_at timestamp_ntz")
    got = {r["id"]: r["token_id"] for r in tokens.allocate_requests(asks, tokens_df, spark.createDataFrame(limits, LIMITS)).collect()}
    left = {i: [remaining, reset, None if i % 2 == 0 else at(i)] for i, _, _, remaining, reset in limits if i != 4}
    expected = {}
    for n in sorted(range(40), key=lambda n: (n % 5, n)):
        if n % 4 == 0:
            expected[n] = None
            continue
        best = min(left, key=lambda i: (-left[i][0], left[i][1], left[i][2] is not None, left[i][2] or T0, i))
        expected[n] = best if left[best][0] > 0 else None
        left[best][0] -= 1 if left[best][0] > 0 else 0
    assert got == expected


EVENTS = "id long, token_id long, created_at timestamp_ntz, kind string, status int, body string"


def test_token_status_by_last_change(spark):
    events = spark.createDataFrame([
        (1, 1, at(0), "response", 401, "{}"), (2, 1, at(5), "donation", 200, "{}"),
        (3, 2, at(0), "donation", 200, "{}"), (4, 2, at(0), "response", 403, '{"message":"BAD credentials!"}'),
        (5, 3, at(0), "response", 403, "oops"), (6, 3, at(0), "response", 403, '{"message":"rate limit"}'), (7, 4, at(1), "response", 200, "{}"),
    ], EVENTS)
    tokens_df = pool(spark, *[(i, f"u{i}", "t", T0, i == 4, None, None) for i in range(1, 6)])
    got = {r["token_id"]: (r["revoked"], r["changed_at"], r["revocations"]) for r in tokens.token_status(events, tokens_df).collect()}
    assert got == {1: (False, at(5), 1), 2: (True, at(0), 1), 3: (False, None, 0), 4: (True, None, 0), 5: (False, None, 0)}


def test_upsert_keeps_identity_and_revives(spark):
    tokens_df = pool(spark, (1, "a", "old", T0, True, None, "repo"), (2, "b", "keep", T0, True, at(1), None))
    given = spark.createDataFrame([(7, "a", "mid", "s1", at(10)), (8, "a", "new", "s2", at(10)), (9, "c", "c1", None, at(20)), (3, "c", "c0", "x", at(15))],
                                  "donation_id long, github_user string, token string, scopes string, donated_at timestamp_ntz")
    got = {r["github_user"]: tuple(r)[1:] for r in tokens.upsert_tokens(tokens_df, given).collect()}
    assert got == {
        "a": (1, "new", T0, False, at(10), "s2"), "b": (2, "keep", T0, True, at(1), None),
        "c": (2 + 1 + 3, "c1", at(15), False, at(20), None),
    }


def test_upsert_of_a_pool_with_text_ids(spark):
    pool_df = spark.createDataFrame([("b7", "a", "old", T0, True, None, "repo")], POOL.replace("id long", "id string"))
    given = spark.createDataFrame([(7, "a", "new", "s", at(1)), (9, "c", "c1", "s", at(2))],
                                  "donation_id long, github_user string, token string, scopes string, donated_at timestamp_ntz")
    first, again = ({r["github_user"]: r["id"] for r in tokens.upsert_tokens(pool_df, given).collect()} for _ in range(2))
    assert first == again and first["a"] == "b7" and len(first["c"]) == 36


def test_allocation_with_large_quotas_makes_few_units(spark):
    tokens_df = pool(spark, *[(i, f"u{i}", "t", T0, False, None, None) for i in range(1, 5)])
    limits = spark.createDataFrame([(i, "core", 5000, 5000 - 3 * i, at(i)) for i in range(1, 5)], LIMITS)
    asks = spark.createDataFrame([(n, "core", at(n)) for n in range(50)], "id long, category string, created_at timestamp_ntz")
    got = {r["id"]: r["token_id"] for r in tokens.allocate_requests(asks, tokens_df, limits).collect()}
    left, expected = {i: 5000 - 3 * i for i in range(1, 5)}, {}
    for n in range(50):
        expected[n] = min(left, key=lambda i: (-left[i], i))
        left[expected[n]] -= 1
    assert got == expected
    lowest = tokens._lowest_levels(tokens.live_quota(tokens_df, limits).where("remaining > 0"), asks).first()["lowest"]
    assert sum(max(0, 5000 - 3 * i - lowest + 1) for i in range(1, 5)) <= 50 + 4


def test_migrating_twice_changes_nothing(spark):
    source = pool(spark, (1, "a", "s1", T0, False, at(1), None), (2, "b", "s2", T0, True, None, "x"), (3, "c", "s3", T0, False, None, "x"),
                  (4, "skip", "s4", T0, False, None, "x"))
    target = pool(spark, (11, "a", "t1", at(5), True, None, "old"), (12, "z", "t2", T0, True, None, "old"))
    once = tokens.migrate_tokens(source, target, "skip")
    rows = sorted(tuple(r) for r in once.collect())
    assert rows == sorted([("a", 11, "s1", at(5), False, at(1), None), ("c", 3, "s3", T0, False, None, "x"), ("z", 12, "t2", T0, True, None, "old")])
    assert sorted(tuple(r) for r in tokens.migrate_tokens(source, once, "skip").collect()) == rows
    check = tokens.reconcile_tokens(source, once, "skip").first()
    assert tuple(check) == (2, 3, True, 0, 1)
    before = tokens.reconcile_tokens(source, target.where("github_user = 'z'"), "skip").first()
    assert tuple(before) == (2, 1, False, 2, 1)
    assert [r["github_user"] for r in tokens.migration_sample(once, "skip", 2).collect()] == ["a", "z"]


def test_quota_merge_replaces_only_what_came(spark):
    current = spark.createDataFrame([(1, "core", 60, 5, at(1), at(1)), (1, "search", 30, 2, at(1), at(1))],
                                    "token_id long, category string, rate_limit int, remaining int, reset timestamp_ntz, updated_at timestamp_ntz")
    body = json.dumps({"resources": {"core": {"limit": 60, "used": 50, "remaining": 10, "reset": 86400}, "new": {"limit": 1, "used": 0, "remaining": 1, "reset": 0}}})
    snaps = spark.createDataFrame([(1, 1, at(9), body), (2, 1, at(8), "{}"), (3, 1, at(30), "broken")],
                                  "snap_id long, token_id long, fetched_at timestamp_ntz, body string")
    got = {r["category"]: (r["remaining"], r["reset"], r["updated_at"]) for r in tokens.merge_rate_limits(current, snaps).collect()}
    assert got == {"core": (10, dt.datetime(1970, 1, 2), at(9)), "search": (2, at(1), at(1)), "new": (1, dt.datetime(1970, 1, 1), at(9))}
    touched = tokens.touch_last_ok(pool(spark, (1, "a", "t", T0, False, None, None), (2, "b", "t", T0, False, at(1), None)), snaps)
    assert {r["id"]: r["last_ok_at"] for r in touched.collect()} == {1: at(30), 2: at(1)}


def test_onboarding_keeps_one_row_per_hash(spark):
    plain = spark.createDataFrame(
        [(2, "u_a_m_secret99", "3", "u", "a", "m", T0), (1, "u_a_m_secret99", "", "u", "a", "m", T0), (3, "u_a_m_other", "x", "u", "a", "m", T0)],
        "id long, plain_key string, rate_text string, hc_username string, app_name string, machine string, created_at timestamp_ntz")
    registry = keys.onboard_keys(plain)
    got = {r["id"]: (r["key_hint"], r["key_prefix"], r["rate_limit_per_sec"], len(r["key_hash"])) for r in registry.collect()}
    assert got == {1: ("secret", "u_a_m", 10, 64), 3: ("other", "u_a_m", 10, 64)}
    used = hashlib.sha256(b"u_a_m_other").hexdigest()
    report = usage.key_report(registry, log(spark, req(1, used), req(2, used, hit=True))).orderBy("id").collect()
    assert [(r["display"], r["total"], r["disabled"], r["created_at"]) for r in report] == [
        ("u_a_m_secret", 0, False, T0), ("u_a_m_other", 2, False, T0)]


def test_disabling_is_idempotent(spark):
    registry = spark.createDataFrame([(i, f"k{i}", "u", "a", "m", "", 1, i == 1, T0) for i in range(3)], KEYS)
    ids = spark.createDataFrame([(1,), (2,), (2,), (9,)], "id long")
    got = {r["id"]: (r["disabled"], r["newly_disabled"]) for r in keys.disable_keys(registry, ids).collect()}
    assert got == {0: (False, False), 1: (True, False), 2: (True, True)}


LINES = [
    '2024/03/01 12:00:00 GET /gh/user 200 (123ms) ua="curl/8 \\"x\\" (a)" key=usr_ap…0001',
    '2024/03/01 12:00:01 POST /gh/graphql 500 (1m2.5s) ua="" key=***',
    "2024/03/01 12:00:02 proxy error: disallowed request target",
    "2024/03/01 12:00:03 server listening",
    "",
]


def test_access_log(spark, tmp_path):
    from gatewaylens.sources.tables import read_log_lines

    (tmp_path / "server.log").write_text("\n".join(LINES) + "\n")
    lines = read_log_lines(spark, str(tmp_path))
    rows = sorted(tuple(r) for r in logs.parse_access_log(lines).collect())
    assert rows == [
        (dt.datetime(2024, 3, 1, 12), "GET", "/gh/user", 200, 123, 'curl/8 "x" (a)', "usr_ap…0001"),
        (dt.datetime(2024, 3, 1, 12, 0, 1), "POST", "/gh/graphql", 500, 62_500, "", "***"),
    ]
    errors = {(r["status"], r["path"]): r["lines"] for r in logs.log_errors(lines).collect()}
    assert errors == {(500, "/gh/graphql"): 1, (None, ""): 1}
    assert logs.filter_log(lines, "GET|POST").count() == 2
    assert sorted(r["line"] for r in logs.unparsed_lines(lines).collect()) == sorted(LINES[2:4] + [r["line"] for r in lines.where("line = ''").collect()])


def test_access_log_of_hostile_paths(spark):
    paths = ["/gh/a b", "/gh/a\x01b", '/gh/"q" ua="x" key=y', "/gh/x 404 (3ms) ua=\"u\" key=k", "", "/gh/\ttab é"]
    lines = [f'2024/03/01 12:00:0{n} GET {p} 500 (5ms) ua="c\\"d" key=***' for n, p in enumerate(paths)]
    parsed = logs.parse_access_log(spark.createDataFrame([(x,) for x in lines], "line string")).orderBy("ts").collect()
    assert [(r["path"], r["status"], r["duration_ms"], r["ua"], r["key"]) for r in parsed] == [(p, 500, 5, 'c"d', "***") for p in paths]
    errors = logs.log_errors(spark.createDataFrame([(x,) for x in [*lines, None]], "line string")).collect()
    assert sum(r["lines"] for r in errors) == len(lines)


LOAD = "id long, ts timestamp_ntz, latency_ms double, ok boolean, cache_status string"


def test_load_figures(spark):
    assert tuple(logs.load_summary(spark.createDataFrame([], LOAD)).first())[:11] == (0, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, False)
    rows = [(1, at(0), 10.0, True, "hit"), (2, at(4), 30.0, True, "miss"), (3, at(25), 20.0, False, "hit"), (4, at(86_400), 0.0, True, None)]
    results = spark.createDataFrame(rows, LOAD)
    summary = logs.load_summary(results, 0.00001).first()
    assert (summary["hits"], summary["misses"], summary["errors"], summary["avg_latency_ms"], summary["target_met"]) == (1, 1, 1, 15.0, True)
    steps = [(r["bucket"], r["requests"], r["cumulative"]) for r in logs.load_progress(results, 10).orderBy("bucket").collect()]
    assert len(steps) == 8641 and [x for x in steps if x[1]] == [(at(0), 2, 2), (at(20), 1, 3), (at(86_400), 1, 4)]
    assert steps[1] == (at(10), 0, 2) and steps[5000][2] == 3
    assert logs.load_progress(spark.createDataFrame([], LOAD), 10).count() == 0


def test_each_line_is_matched_once(spark):
    lines = spark.createDataFrame([(1, "x")], "id long, line string")
    for made in (logs.parse_access_log(lines), logs.log_errors(lines), logs.log_key_counts(lines), logs.latency_profile(logs.parse_access_log(lines))):
        assert made._jdf.queryExecution().optimizedPlan().toString().count(r"^\d{4}/") == 1


def test_token_intervals_are_runs_of_equal_state(spark):
    schema = "token_id long, created_at timestamp_ntz, id long, kind string, status int, body string"
    bad = (401, "{}")
    rows = [(1, at(0), 1, "donation", 200, ""), (1, at(5), 2, "donation", 200, ""), (1, at(7), 3, "response", *bad), (1, at(9), 4, "response", *bad),
            (1, at(12), 5, "response", 200, ""), (1, at(20), 7, "donation", 200, ""), (1, at(20), 6, "response", *bad), (1, None, 9, "response", *bad),
            (2, at(3), 8, "response", 403, '{"message":"Bad credentials"}'), (3, at(1), 10, "response", 500, None)]
    found = tokens.token_intervals(spark.createDataFrame(rows, schema)).collect()
    assert {(r["token_id"], r["revoked"], r["begin"], r["until"]) for r in found} == {
        (1, False, at(0), at(7)), (1, True, at(7), at(20)), (1, False, at(20), None), (2, True, at(3), None)} and len(found) == 4
    assert tokens.token_intervals(spark.createDataFrame([], schema)).count() == 0


def test_token_choice_follows_the_quotas_of_its_time(spark):
    pool = spark.createDataFrame([(1, False, None), (2, False, at(-9)), (3, True, None), (4, False, at(-9))], "id long, revoked boolean, last_ok_at timestamp_ntz")
    said = lambda **quota: json.dumps({"resources": {c: {"limit": 9, "remaining": r, "reset": s} for c, (r, s) in quota.items()}})
    reads = spark.createDataFrame([
        (1, 1, at(0), said(core=(5, 100))), (2, 2, at(10), said(core=(7, 100), search=(1, 1))), (3, 3, at(1), said(core=(9, 1))),
        (4, 2, at(20), said(core=(5, 90))), (5, 1, at(30), said(core=(2, 5))), (6, 4, at(40), said(core=(5, 90))), (7, 2, at(50), said(core=(0, 1))),
        (8, 2, at(50), said(core=(5, 90))), (9, 2, None, said(core=(99, 1)))], "snap_id long, token_id long, fetched_at timestamp_ntz, body string")
    asks = spark.createDataFrame([(n, c, at(t)) for n, (c, t) in enumerate(
        [("core", 0), ("core", 1), ("core", 10), ("core", 11), ("core", 21), ("core", 31), ("core", 41), ("core", 51), ("search", 60), ("graphql", 60)])],
        "id long, category string, created_at timestamp_ntz")
    found = {r["id"]: (r["token_id"], r["remaining"]) for r in tokens.choose_token_as_of(asks, pool, reads).collect()}
    # At 41 tokens 2 and 4 have as much left, one reset and one last use: the smaller id.
    assert found == {0: (None, None), 1: (1, 5), 2: (1, 5), 3: (2, 7), 4: (2, 5), 5: (2, 5), 6: (2, 5), 7: (2, 5), 8: (2, 1), 9: (None, None)}


def test_ledger_counts_each_batch_once_and_reads_few_folders(spark, tmp_path):
    rows = [log(spark, *[req(100 * n + i) for i in range(n % 4)]) for n in range(20)]
    for n in [0, 1, 2, 2, *range(3, 16), 15, *range(16, 20)]:  # some batches run again
        ledger.post(rows[n], n, str(tmp_path))
    found = ledger.read(spark, 20, str(tmp_path))
    assert ledger.system_totals(found).first()["total_requests"] == sum(n % 4 for n in range(20))
    assert ledger.system_totals(ledger.read(spark, 9, str(tmp_path))).first()["total_requests"] == sum(n % 4 for n in range(9))
    assert len(ledger.folders(20, "p")) == 6 and len(ledger.folders(8**3, "p")) == 1 and len(ledger.folders(8**3 - 1, "p")) == 21
