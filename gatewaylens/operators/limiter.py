"""Token-bucket decisions per key, and the outcome of every request."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewaylens.functions import columns as C
from gatewaylens.operators import recurrence as R
from gatewaylens.operators.shifts import Run, Shifts, from_steps, identity

MICRO = 1_000_000


class TokenBucket(R.Rule):
    """A bucket of `rate` tokens that refills `rate` tokens per `unit_s` seconds; a request costs one.

    Every row brings its key's rate of that moment: the time since the row before refills at the new rate, up to the
    new size. All arithmetic is in whole numbers: a token is `unit` wide, and a microsecond refills `rate` of it.
    The state is the level after the newest row and that row's time. A rate of zero or less refuses the row and
    leaves the bucket alone.
    """

    def __init__(self, unit_s: int):
        self.unit = unit_s * MICRO

    def level_at(self, state, t, rate):
        full = rate * self.unit
        return full if state is None else min(full, state[0] + (t - state[1]) * rate)

    def replay(self, state, times, args):
        unit = self.unit
        level, last = (None, 0) if state is None else state
        passed = []
        for t, rate in zip(times, args):
            if rate <= 0:
                passed.append(False)
                continue
            full = rate * unit
            level = full if level is None else min(full, level + (t - last) * rate)
            last = t
            if level >= unit:
                level -= unit
                passed.append(True)
            else:
                passed.append(False)
        return (None if level is None else [int(level), int(last)]), passed

    # A state's place is where the bucket was last empty, on the axis of what has been refilled since the chunk's first row.
    def enter(self, state, head):
        return R.NEVER if state is None else -int(self.level_at(state, *head))

    def leave(self, place, tail):
        return None if tail is None or place <= R.NEVER // 2 else [tail[1] - place, tail[0]]

    def settle(self, state):
        return (R.NEVER, None) if state is None else (-state[0], (state[1], 0))

    def gap(self, tail, head):
        return tail[1] + (head[0] - tail[0]) * head[1]

    def function(self, kind, payload, times, args):
        counts = args > 0
        times, args = times[counts], args[counts]
        head = (int(times[0]), int(args[0]))
        places = np.cumsum(np.diff(times, prepend=times[:1]) * args)
        tail = (int(times[-1]), int(places[-1]))
        full = head[1] * self.unit
        if kind == R.STEPS:  # one token: a place is a token behind the time at which it is whole again
            lo, out = R.step_function(np.unique(places) - self.unit, self.unit)
            return head, tail, from_steps(lo, out)
        n, bound = payload[2], payload[3]
        try:
            # Whole tokens are spent from a bucket that never fills up: one less for every token that it came emptier.
            spent = max(-full, bound - n * self.unit)
            first = bound - self.unit * ((bound - spent) // self.unit)
            bounds = np.unique([-full, *range(first, 1, self.unit), 0])
            ends = np.array([payload[-2] - self.close(payload, [-x, head[0]])[0] for x in bounds.tolist()], np.int64)
            whole = bounds == -full  # and a bucket that came fuller, or had no history, was full
            return head, tail, Shifts(bounds, whole, np.where(whole, ends, ends - bounds)).then(identity())
        except R.Unresolved:
            run = Run(self.unit, R.NEVER, 0)
            for place, rate in zip(places.tolist(), args.tolist()):
                run.add(place - rate * self.unit, place - self.unit)
            return head, tail, run.function()

    def summary(self):
        return _BucketSummary(self)

    def close(self, payload, state):
        """Passed requests of a chunk in which the bucket never fills up.

        On the axis of what has been refilled since the first row, the state is where the bucket was last empty.
        Each of the n requests passes if the state is a token behind its place, so the state can advance by at most
        n tokens, and at no request past its place: min(n, floor((bound - state) / token)) tokens, where bound
        is the least of `place_j + (n - j) tokens` over the requests j.
        """
        first_at, first_rate, n, bound, floor_state, never_full, last_place, last_at = payload
        empty = -self.level_at(state, first_at, first_rate)
        if not never_full or empty < floor_state:
            raise R.Unresolved
        empty += self.unit * min(n, (bound - empty) // self.unit)
        return [last_place - empty, last_at]


class _BucketSummary(R.Summary):
    """Follows the emptiest possible bucket until even that one is full, then the actual one."""

    def __init__(self, rule: TokenBucket):
        self.rule = rule
        self.state: list[int] | None = None  # exact from the moment the bucket is surely full
        self.first: tuple[int, int] | None = None  # time and rate of the first row
        self.last_at = self.place = self.n = 0  # place: what has been refilled since the first row
        self.only_ones = True
        self.bound: int | None = None  # the latest the state can be; also the bound of the closed form
        self.floor_state = R.NEVER * 2**20
        self.never_full = True

    def add(self, times, args):
        unit = self.rule.unit
        if self.state is not None:
            self.state, _ = self.rule.replay(self.state, times, args)
            return
        for i, (t, rate) in enumerate(zip(times, args)):
            if rate <= 0:
                continue
            if self.first is None:
                self.first, self.last_at = (int(t), int(rate)), t
            self.place += (t - self.last_at) * rate
            self.last_at = t
            self.only_ones = self.only_ones and rate == 1
            now, full = self.place, rate * unit
            if self.bound is not None:
                if self.bound <= now - full:
                    self.state, _ = self.rule.replay(None, times[i:], args[i:])
                    return
                self.never_full = self.never_full and self.bound - unit + 1 >= now - full
                self.floor_state = max(self.floor_state, now - full - self.n * unit)
            self.bound = now if self.bound is None else min(self.bound + unit, now)
            self.n += 1

    def finish(self):
        if self.state is not None:
            return R.KNOWN, [self.state]
        if self.first is None:
            return R.SAME, []
        if self.only_ones:
            return R.STEPS, [int(self.last_at)]
        numbers = (*self.first, self.n, self.bound, self.floor_state, self.never_full, self.place, self.last_at)
        return R.CLOSED, [x if isinstance(x, bool) else int(x) for x in numbers]


def rate_limit(
    requests: DataFrame, rate: Column, unit_s: int = 1, key_col: str = "api_key", at_col: str = "created_at",
    id_col: str = "id", partitions: int | None = None,
) -> DataFrame:
    """`requests` with `allowed` from one token bucket per key, in (time, id) order.

    Each row's rate counts from that row on; it may change from row to row. Select the needed columns first.
    """
    at_us = C.micros(F.col(at_col))
    return R.decide(requests, TokenBucket(unit_s), F.col(key_col), at_us, id_col, rate, "allowed", partitions)


def rate_limit_from(
    requests: DataFrame, rate: Column, states: DataFrame, unit_s: int = 1, key_col: str = "api_key",
    at_col: str = "created_at", id_col: str = "id", partitions: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """`rate_limit` going on from the buckets an earlier run left, and the buckets afterwards."""
    at_us = C.micros(F.col(at_col))
    return R.decide_from(requests, TokenBucket(unit_s), F.col(key_col), at_us, id_col, rate, "allowed", states, partitions)


# Outcome names by the status the client sees.
MISSING_KEY, DISABLED, LIMITED, TOO_LARGE, PASSED = "401", "403", "429", "413", "pass"


def admission_status(
    requests: DataFrame, keys: DataFrame, unit_s: int, max_body: int, partitions: int | None = None
) -> DataFrame:
    """Outcome of each request (`id, api_key, outcome`), the first rule that matches.

    A blank key, a disabled key, the limiter, the body limit. Only requests of known and enabled keys reach a
    bucket; an unknown key has rate 0 and is refused. Body limits are checked after a token was taken. What is
    decided without a bucket (a blank key may be the busiest of all) is neither shuffled for it nor sorted.
    """
    policy = keys.select("key_hash", "disabled", F.col("rate_limit_per_sec").alias("rate"))
    narrow = requests.select("id", "api_key", "created_at", "body_bytes")
    joined = narrow.join(policy, F.col("api_key") == F.col("key_hash"), "left")
    blank = F.coalesce(C.trimmed(F.col("api_key")), F.lit("")) == ""
    rate = F.coalesce("rate", F.lit(0))
    early = F.when(blank, MISSING_KEY).when(F.col("disabled"), DISABLED).when(rate <= 0, LIMITED)
    staged = joined.select("id", "api_key", "created_at", "body_bytes", early.alias("early"), rate.alias("rate"))
    decided = staged.where("early IS NOT NULL").select("id", "api_key", F.col("early").alias("outcome"))
    limited = rate_limit(staged.where("early IS NULL").drop("early"), F.col("rate"), unit_s, partitions=partitions)
    too_large = (F.lit(max_body) > 0) & (F.col("body_bytes") > max_body)
    late = F.when(~F.col("allowed"), LIMITED).when(too_large, TOO_LARGE).otherwise(PASSED)
    return decided.unionByName(limited.select("id", "api_key", late.alias("outcome")))


def admission_outcomes(
    requests: DataFrame, keys: DataFrame, unit_s: int, max_body: int, partitions: int | None = None
) -> DataFrame:
    """Requests and distinct keys per outcome; reduced to (outcome, key) before keys are counted."""
    status = admission_status(requests, keys, unit_s, max_body, partitions)
    per_key = status.groupBy("outcome", "api_key").agg(F.count("*").alias("requests"))
    return per_key.groupBy("outcome").agg(F.sum("requests").alias("requests"), F.count("api_key").alias("keys"))
