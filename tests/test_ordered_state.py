"""Ordered operators against step-by-step recomputation, with one key holding most of the rows."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewaylens.operators import limiter, recurrence, replay, shifts
from gatewaylens.operators.ordered import in_order, numbered, prefix_cutoff, with_next

START = dt.datetime(2024, 1, 1)
LOG = "id long, api_key string, method string, path string, status int, created_at timestamp_ntz, rate int"


def log_rows(seed: int, n: int, mean_gap_s: float, hot: float, rate: int = 2, ok: float = 0.8, whole_seconds: bool = False):
    """A log in which one key holds the share `hot` of all rows."""
    rnd = random.Random(seed)
    at, rows = START, []
    for i in range(n):
        gap = rnd.expovariate(1 / mean_gap_s)
        at += dt.timedelta(seconds=round(gap) if whole_seconds else gap)
        key = "hot" if rnd.random() < hot else f"k{rnd.randrange(12)}"
        path = "/gh/user" if rnd.random() < hot else f"/gh/p{rnd.randrange(9)}"
        rows.append((i, key, rnd.choice(["GET", "GET", "HEAD", "POST"]) if hot < 1 else "GET", path,
                     200 if rnd.random() < ok else 500, at, rate))
    rnd.shuffle(rows)
    return rows


def micros(at: dt.datetime) -> int:
    return (at - START) // dt.timedelta(microseconds=1)


def bucket_by_hand(rows, unit_s: int) -> dict[int, bool]:
    unit = unit_s * 1_000_000
    level, seen, decided = {}, {}, {}
    for i, key, _, _, _, at, rate in sorted(rows, key=lambda r: (r[5], r[0])):
        t = micros(at)
        if rate <= 0:
            decided[i] = False
            continue
        now = min(rate * unit, level.get(key, rate * unit) + (t - seen.get(key, t)) * rate)
        decided[i] = now >= unit
        level[key], seen[key] = now - unit if now >= unit else now, t
    return decided


def replay_by_hand(rows, ttl_s: int) -> dict[int, bool]:
    ends, decided = {}, {}
    for i, _, method, path, status, at, _ in sorted(rows, key=lambda r: (r[5], r[0])):
        if method not in ("GET", "HEAD"):
            continue
        t, key = micros(at), (method, path)
        decided[i] = key in ends and t < ends[key]
        if not decided[i] and status == 200:
            ends[key] = t + ttl_s * 1_000_000 if ttl_s > 0 else 2**60
    return decided


# Light, near the limit, overloaded; a bucket of one; equal times; a rate of zero.
BUCKETS = [
    (1, 3.0, 0.4, 2, 10, False), (2, 1.0, 0.9, 5, 5, False), (3, 0.1, 0.9, 3, 20, False), (4, 0.5, 0.95, 1, 10, False),
    (5, 0.3, 0.9, 4, 3, True), (6, 1.0, 0.5, 0, 10, False), (7, 0.2, 1.0, 1, 7, True), (8, 0.9, 1.0, 6, 6, False),
    (9, 0.55, 1.0, 20, 10, False), (10, 0.5, 1.0, 40, 20, False),
]


@pytest.mark.parametrize("seed,gap,hot,rate,unit,whole", BUCKETS)
def test_bucket_equals_step_by_step(spark, seed, gap, hot, rate, unit, whole):
    rows = log_rows(seed, 2000, gap, hot, rate, whole_seconds=whole)
    df = spark.createDataFrame(rows, LOG)
    got = {r["id"]: r["allowed"] for r in limiter.rate_limit(df, F.col("rate"), unit, partitions=16).collect()}
    assert got == bucket_by_hand(rows, unit)


def test_chunks_of_any_number_decide_alike(spark):
    rows = log_rows(31, 2000, 0.5, 0.6, 3)
    df = spark.createDataFrame(rows, LOG)
    assert {r["id"]: r["allowed"] for r in limiter.rate_limit(df, F.col("rate"), 10).collect()} == bucket_by_hand(rows, 10)
    assert {r["id"]: r["hit"] for r in replay.cache_replay(df, 10).collect()} == replay_by_hand(rows, 10)
    states, got = recurrence.no_states(spark), {}
    for piece in (sorted(rows)[:900], sorted(rows)[900:]):
        decided, states = limiter.rate_limit_from(spark.createDataFrame(piece, LOG), F.col("rate"), states, 10)
        got.update({r["id"]: r["allowed"] for r in decided.collect()})
    assert got == bucket_by_hand(rows, 10)


def changing(rows, seed, low=0):
    """The same log with a rate that changes by key, up and down and to none."""
    rnd = random.Random(seed)
    return [(*row[:-1], rnd.choice([low, 1, 2, 3, 8]) if rnd.random() < 0.3 else 2) for row in rows]


@pytest.mark.parametrize("seed,gap,unit,low", [(41, 0.5, 5, 0), (42, 0.1, 20, 1), (43, 3.0, 4, 0)])
def test_a_rate_that_changes_counts_from_its_row_on(spark, seed, gap, unit, low):
    rows = changing(log_rows(seed, 1500, gap, 0.8), seed, low)
    expected = bucket_by_hand(rows, unit)
    got = limiter.rate_limit(spark.createDataFrame(rows, LOG), F.col("rate"), unit, partitions=12).collect()
    assert {r["id"]: r["allowed"] for r in got} == expected
    states, pieces = recurrence.no_states(spark), {}
    for piece in (sorted(rows)[:700], sorted(rows)[700:]):
        decided, states = limiter.rate_limit_from(spark.createDataFrame(piece, LOG), F.col("rate"), states, unit, partitions=4)
        pieces.update({r["id"]: r["allowed"] for r in decided.collect()})
    assert pieces == expected


def test_a_lowered_or_raised_rate_keeps_the_level(spark):
    row = lambda i, s, rate: (i, "a", "GET", "/", 200, START + dt.timedelta(seconds=s), rate)
    rows = [row(1, 0, 3), row(2, 0, 3), row(3, 86_400, 2), row(4, 86_400, 2), row(5, 86_400, 2), row(6, 86_400, 9), row(7, 86_400.5, 2)]
    got = {r["id"]: r["allowed"] for r in limiter.rate_limit(spark.createDataFrame(rows, LOG), F.col("rate"), 1, partitions=3).collect()}
    assert got == {1: True, 2: True, 3: True, 4: True, 5: False, 6: False, 7: True}


@pytest.mark.parametrize("load", [1.0, 1.5, 1.7])
def test_a_hot_key_at_any_load(spark, load):
    rows = log_rows(int(load * 10), 3000, 0.9 / (2 * load) * 5, 0.9, 2)
    got = limiter.rate_limit(spark.createDataFrame(rows, LOG), F.col("rate"), 5, partitions=12).collect()
    assert {r["id"]: r["allowed"] for r in got} == bucket_by_hand(rows, 5)


def test_bucket_falls_back_to_replaying_a_chunk(spark, monkeypatch):
    """Chunks with neither a sure refill nor a closed form are replayed one after another."""
    def unresolved(self, payload, state):
        raise recurrence.Unresolved
    monkeypatch.setattr(limiter.TokenBucket, "close", unresolved)
    rows = log_rows(11, 600, 0.1, 1.0, 3)
    df = spark.createDataFrame(rows, LOG)
    got = {r["id"]: r["allowed"] for r in limiter.rate_limit(df, F.col("rate"), 20, partitions=6).collect()}
    assert got == bucket_by_hand(rows, 20)


REPLAYS = [
    (1, 5.0, 0.3, 60, 0.8, False), (2, 1.0, 0.9, 300, 0.8, False), (3, 0.1, 1.0, 20, 0.9, False), (4, 1.0, 1.0, 10, 0.3, True),
    (5, 1.0, 0.6, 0, 0.7, False), (6, 0.05, 1.0, 1, 1.0, False), (7, 2.0, 1.0, 100_000, 0.5, False), (8, 0.5, 1.0, 3, 0.02, False),
]


@pytest.mark.parametrize("seed,gap,hot,ttl,ok,whole", REPLAYS)
def test_replay_equals_step_by_step(spark, seed, gap, hot, ttl, ok, whole):
    rows = log_rows(seed, 2000, gap, hot, ok=ok, whole_seconds=whole)
    df = spark.createDataFrame(rows, LOG)
    got = {r["id"]: r["hit"] for r in replay.cache_replay(df, ttl, partitions=20).collect()}
    assert got == replay_by_hand(rows, ttl)


@pytest.mark.parametrize("rate,gap,unit", [(1, 0.3, 7), (3, 0.1, 20)])
def test_pieces_give_what_the_whole_gives(spark, rate, gap, unit):
    rows = sorted(log_rows(21, 1500, gap, 0.8, rate), key=lambda r: r[0])
    limits, entries = recurrence.no_states(spark), recurrence.no_states(spark)
    allowed, hits = {}, {}
    for piece in (rows[:600], rows[600:601], rows[601:]):
        df = spark.createDataFrame(piece, LOG)
        decided, limits = limiter.rate_limit_from(df, F.col("rate"), limits, unit, partitions=6)
        allowed.update({r["id"]: r["allowed"] for r in decided.collect()})
        decided, entries = replay.cache_replay_from(df, unit, entries, partitions=6)
        hits.update({r["id"]: r["hit"] for r in decided.collect()})
        assert limits.count() == limits.select("key_").distinct().count()
    assert allowed == bucket_by_hand(rows, unit)
    assert hits == replay_by_hand(rows, unit)


def test_replay_without_expiry_never_misses_after_the_first_store(spark):
    rows = log_rows(9, 800, 1.0, 0.8, ok=1.0)
    decided = replay.cache_replay(spark.createDataFrame(rows, LOG), 0, partitions=8).collect()
    misses = [r for r in decided if not r["hit"]]
    assert len(misses) == len({(r["method"], r["path"]) for r in misses})


def test_hot_key_spans_chunks_and_no_chunk_is_large(spark):
    rows = log_rows(3, 4000, 1.0, 0.9)
    chunked = in_order(spark.createDataFrame(rows, LOG).select("api_key", "created_at", "id"), ["api_key"],
                       [F.col("created_at"), F.col("id")], 16)
    sizes = [r["count"] for r in chunked.groupBy("chunk").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 4000 / 3
    assert chunked.where("api_key = 'hot'").select("chunk").distinct().count() > 8


def test_step_functions_compose_like_one():
    rnd = np.random.default_rng(5)
    for width in (3, 17, 200):
        events = np.unique(rnd.integers(0, 4000, 700))
        cuts = np.array_split(events, 9)
        for entering in (recurrence.NEVER, int(events[0]), int(events[0]) + width // 2):
            now = np.array([entering])
            for part in cuts:
                now = recurrence.apply_steps(*recurrence.step_function(part, width), now)
            expected = entering
            for e in events.tolist():
                if e >= expected:
                    expected = e + width
            assert int(now[0]) == expected


def test_numbering_is_exact_per_key(spark):
    rows = log_rows(12, 3000, 1.0, 0.7)
    df = spark.createDataFrame(rows, LOG).select("id", "api_key", "created_at")
    got = {r["id"]: r["n"] for r in numbered(df, ["api_key"], [F.desc("created_at"), F.desc("id")]).collect()}
    seen, expected = {}, {}
    for i, key, *_, at, _ in sorted(rows, key=lambda r: (r[5], r[0]), reverse=True):
        seen[key] = seen.get(key, 0) + 1
        expected[i] = seen[key]
    assert got == expected


def test_each_row_meets_its_follower(spark):
    rnd = random.Random(8)
    rows = [(n, "hot" if rnd.random() < 0.6 else f"k{n % 5}", rnd.randrange(10_000_000)) for n in range(1500)]
    df = spark.createDataFrame(rows, "id long, k string, at long")
    got = {r["id"]: r["next"] for r in with_next(df, ["k"], [F.col("at"), F.col("id")], "id", "next").collect()}
    expected = {}
    for key in {r[1] for r in rows}:
        own = [i for i, k, _ in sorted(rows, key=lambda r: (r[2], r[0])) if k == key]
        expected.update(zip(own, [*own[1:], None]))
    assert got == expected


@pytest.mark.parametrize("spread", [3, 10_000_000])
def test_cutoff_finds_the_exact_row(spark, spread):
    rnd = random.Random(spread)
    rows = [(n, rnd.randrange(spread), rnd.randrange(1, 90)) for n in range(1500)]
    df = spark.createDataFrame(rows, "id long, at long, w long")
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    for need in (1, 777, 20_000, sum(r[2] for r in rows)):
        running = 0
        for i, at, w in ordered:
            running += w
            if running >= need:
                break
        assert prefix_cutoff(df, ["at", "id"], F.col("w"), need, cells=7) == {"at": at, "id": i}
    assert prefix_cutoff(df, ["at"], F.col("w"), 10**9) is None


def test_clamped_shifts_compose_like_their_rows():
    """Rows with changing sizes, cut anywhere, on an axis that begins elsewhere after the cut."""
    rnd = random.Random(1)
    for _ in range(150):
        unit, place, rows = rnd.choice([3, 10, 50]), 0, []
        for _ in range(rnd.randint(1, 50)):
            place += rnd.randint(0, 2 * unit // rnd.choice([1, 2, 3]))
            rows.append((place - rnd.choice([1, 1, 2, 5]) * unit, place - unit))

        def of(part, back=0):
            run = shifts.Run(unit, shifts.NEVER, 10**6)
            for a, b in part:
                run.add(a - back, b - back)
            return run.function()

        cut, back = rnd.randint(0, len(rows)), rnd.randint(-20, 20)
        whole, both = of(rows), of(rows[:cut]).then(of(rows[cut:], back), back)
        for place in [rnd.randint(-400, 200) for _ in range(30)]:
            now = place
            for a, b in rows:
                now = max(now, a)
                now += unit if now <= b else 0
            assert int(whole(place)) == now and int(both(place)) == now - back


def test_jobs_follow_the_depth_of_the_tree(spark):
    """A bucket that neither fills up nor has a closed form costs no job per chunk."""
    rows = log_rows(31, 3000, 0.35, 1.0, 3)
    df = spark.createDataFrame(rows, LOG)
    counts = []
    for partitions in (10, 40):
        tracker, group = spark.sparkContext.statusTracker(), f"bucket-{partitions}"
        spark.sparkContext.setJobGroup(group, "bucket")
        got = {r["id"]: r["allowed"] for r in limiter.rate_limit(df, F.col("rate"), 5, partitions=partitions).collect()}
        counts.append(len(tracker.getJobIdsForGroup(group)))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert got == bucket_by_hand(rows, 5)
    assert counts[1] <= counts[0] + 12
