"""Which logged requests a cache with a given lifetime would have answered."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewaylens.functions import columns as C
from gatewaylens.operators import recurrence as R
from gatewaylens.operators.shifts import from_steps

MICRO = 1_000_000


class CacheLifetime(R.Rule):
    """Hit while the stored entry lives; a miss that may be stored starts a new entry; hits do not extend it.

    The state is the end of life of the newest entry. A row's argument is 1 where its response may be stored.
    """

    def __init__(self, ttl_s: int):
        self.ttl = ttl_s * MICRO

    def replay(self, state, times, args):
        ttl = self.ttl
        ends = R.NEVER if state is None else state
        hits = []
        for t, storable in zip(times, args):
            if t < ends:
                hits.append(True)
            else:
                hits.append(False)
                if storable:
                    ends = t + ttl if ttl > 0 else R.FOREVER
        return (None if ends == R.NEVER else ends), hits

    # A state's place is its time.
    def enter(self, state, head):
        return R.NEVER if state is None else state

    def leave(self, place, tail):
        return None if place <= R.NEVER // 2 else place

    def settle(self, state):
        return (R.NEVER, None) if state is None else (state, (0, 0))

    def gap(self, tail, head):
        return 0

    def function(self, kind, payload, times, args):
        return (0, 0), (0, 0), from_steps(*R.step_function(np.unique(times[args == 1]), self.ttl))

    def summary(self):
        return _LifetimeSummary(self)


class _LifetimeSummary(R.Summary):
    """After a lifetime without a storable request nothing older can still live: the state is known."""

    def __init__(self, rule: CacheLifetime):
        self.rule = rule
        self.state: int | None = None
        self.newest: int | None = None  # newest storable request

    def add(self, times, args):
        ttl = self.rule.ttl
        if self.state is not None:
            self.state, _ = self.rule.replay(self.state, times, args)
            return
        for i, (t, storable) in enumerate(zip(times, args)):
            if not storable:
                continue
            if ttl <= 0 or (self.newest is not None and t >= self.newest + ttl):
                self.state, _ = self.rule.replay(None, times[i:], args[i:])
                return
            self.newest = t

    def finish(self):
        if self.state is not None:
            return R.KNOWN, [self.state]
        return (R.SAME, []) if self.newest is None else (R.STEPS, [])


def _cacheable(log: DataFrame) -> tuple[DataFrame, Column, Column]:
    """The requests that consult the cache, their cache key, and whether each response may be stored."""
    requests = log.where(C.is_cacheable(F.col("method"))).select("id", "method", "path", "status", "created_at")
    return requests, F.concat_ws("\n", "method", "path"), (F.col("status") == 200).cast("bigint")


def cache_replay(log: DataFrame, ttl_s: int, partitions: int | None = None) -> DataFrame:
    """Each GET or HEAD request with `hit` under a lifetime of `ttl_s` (zero or less: entries never end).

    The log keeps the status a client saw, taken here as what the origin would have answered; it keeps no
    response headers, so a response may be stored if its status is 200. The cache key is the method and the
    logged path, which has no query.
    """
    requests, key, storable = _cacheable(log)
    at_us = C.micros(F.col("created_at"))
    decided = R.decide(requests, CacheLifetime(ttl_s), key, at_us, "id", storable, "hit", partitions)
    return decided.select("id", "method", "path", "hit")


def cache_replay_from(
    log: DataFrame, ttl_s: int, states: DataFrame, partitions: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """`cache_replay` going on from the entries an earlier run left, and the entries afterwards."""
    requests, key, storable = _cacheable(log)
    at_us = C.micros(F.col("created_at"))
    decided, kept = R.decide_from(requests, CacheLifetime(ttl_s), key, at_us, "id", storable, "hit", states, partitions)
    return decided.select("id", "method", "path", "hit"), kept
