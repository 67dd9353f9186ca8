"""Keyed stateful streams: token bucket and cache lifetime.

`*_in_batches` run the batch operators on each micro-batch and keep the states in written tables: no key is held in
one task. Rows wait until a watermark has passed them (the newest time seen less `delay`), so files may come in any
order within that delay; when the input is worked through, what waits is decided. A row that comes later than that
counts as arriving at its key's newest time.

`stream_*` keep the state in Spark's state store for an input in time order. A key's rows of one micro-batch are sorted
in one task, which the reader bounds by bytes: the form for steady, small batches of a live source.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gatewaylens.functions import columns as C
from gatewaylens.operators.limiter import TokenBucket, rate_limit_from
from gatewaylens.operators.recurrence import Rule, no_states
from gatewaylens.operators.replay import CacheLifetime, cache_replay_from
from gatewaylens.sources.streams import run_available

ROWS_PER_FRAME = 100_000


def _decide_stream(rows: DataFrame, keys: list[str], rule: Rule, out: str, output: str) -> DataFrame:
    """`rows` has the keys, `id`, `at_` (microseconds) and `arg_`; `output` the keys, `id` and `out`."""

    def each(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # The key is the same in all rows: only three numbers per row are held to sort them.
        parts = [frame[["id", "at_", "arg_"]] for frame in frames]
        if not parts:
            return
        held = pd.concat(parts, ignore_index=True).sort_values(["at_", "id"], ignore_index=True)
        before, seen = (None, None) if not state.exists else state.get
        times = held["at_"] if seen is None else held["at_"].clip(lower=seen)
        now = None if before is None else json.loads(before)
        for begin in range(0, len(held), ROWS_PER_FRAME):
            end = begin + ROWS_PER_FRAME
            now, marks = rule.replay(now, times[begin:end].tolist(), held["arg_"][begin:end].tolist())
            decided = pd.DataFrame({"id": held["id"][begin:end], out: marks})
            yield decided.assign(**dict(zip(keys, key)))
        state.update((None if now is None else json.dumps(now), int(times.iloc[-1])))

    return rows.groupBy(*keys).applyInPandasWithState(
        each, output, "before string, seen long", "append", GroupStateTimeout.NoTimeout
    )


def stream_rate_limit(requests: DataFrame, rate: Column, unit_s: int) -> DataFrame:
    """`id, api_key, allowed` for a stream of requests, one token bucket per key."""
    rows = requests.select(
        "id", "api_key", C.micros(F.col("created_at")).alias("at_"), rate.cast("bigint").alias("arg_")
    )
    return _decide_stream(rows, ["api_key"], TokenBucket(unit_s), "allowed", "id long, api_key string, allowed boolean")


def stream_cache_replay(log: DataFrame, ttl_s: int) -> DataFrame:
    """`id, method, path, hit` for a stream of logged requests under one cache lifetime."""
    rows = log.where(C.is_cacheable(F.col("method"))).select(
        "id", "method", "path", C.micros(F.col("created_at")).alias("at_"), (F.col("status") == 200).cast("bigint").alias("arg_")
    )
    return _decide_stream(
        rows, ["method", "path"], CacheLifetime(ttl_s), "hit", "id long, method string, path string, hit boolean"
    )


Each = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]
DELAY = dt.timedelta(days=7)


def _in_batches(stream: DataFrame, each: Each, path: str, checkpoint: str, delay: dt.timedelta) -> DataFrame:
    """Decide micro-batch by micro-batch; rows, states and waiting rows are written under the batch's number.

    A batch reads what the batch before left and overwrites only its own folders, so running it again
    after a failure changes nothing. What waits at the end is decided under the last number's own `end` folders, from
    which the next run goes on.
    """
    spark = stream.sparkSession
    begun = last = None

    def left_by(session, name: str, kind: str) -> DataFrame:
        return session.read.parquet(f"{path}/{kind}/{name}")

    def before(session, number: int) -> tuple[DataFrame, DataFrame]:
        if number == 0:
            return no_states(session), session.createDataFrame([], stream.schema)
        names = [f"{number - 1}-end", f"{number - 1}"] if begun == number else [f"{number - 1}"]
        for name in names:
            try:
                return left_by(session, name, "states"), left_by(session, name, "waiting")
            except AnalysisException:  # the run before ended early: it decided no waiting rows
                if name == names[-1]:
                    raise
        raise AssertionError

    def run(batch: DataFrame, number: int) -> None:
        nonlocal begun, last
        begun, last = number if begun is None else begun, number
        states, waiting = before(batch.sparkSession, number)
        rows = batch.unionByName(waiting)
        newest = rows.agg(F.max("created_at")).first()[0]
        late = F.coalesce(F.col("created_at") > F.lit(newest - delay if newest else None).cast("timestamp_ntz"), F.lit(False))
        _write(each(rows.where(~late), states), rows.where(late), f"{number}", path)

    run_available(stream, "append", run, checkpoint)
    if last is not None:
        states, waiting = left_by(spark, f"{last}", "states"), left_by(spark, f"{last}", "waiting")
        _write(each(waiting, states), waiting.where("false"), f"{last}-end", path)
    return spark.read.parquet(f"{path}/rows").drop("batch")


def _write(decided: tuple[DataFrame, DataFrame], waiting: DataFrame, name: str, path: str) -> None:
    rows, states = decided
    rows.write.mode("overwrite").parquet(f"{path}/rows/batch={name}")
    states.write.mode("overwrite").parquet(f"{path}/states/{name}")
    waiting.write.mode("overwrite").parquet(f"{path}/waiting/{name}")


def rate_limit_in_batches(
    requests: DataFrame, rate: Column, unit_s: int, path: str, checkpoint: str, delay: dt.timedelta = DELAY
) -> DataFrame:
    """`id, api_key, allowed` of a stream of requests (`id, api_key, created_at` and what the rate needs)."""
    def each(batch: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
        decided, kept = rate_limit_from(batch, rate, states, unit_s)
        return decided.select("id", "api_key", "allowed"), kept

    return _in_batches(requests, each, path, checkpoint, delay)


def cache_replay_in_batches(log: DataFrame, ttl_s: int, path: str, checkpoint: str, delay: dt.timedelta = DELAY) -> DataFrame:
    """`id, method, path, hit` of a stream of logged requests under one cache lifetime."""
    return _in_batches(log, lambda batch, states: cache_replay_from(batch, ttl_s, states), path, checkpoint, delay)
