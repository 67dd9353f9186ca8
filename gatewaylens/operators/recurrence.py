"""Ordered recurrences per key (each decision depends on the one before) over evenly cut rows.

Rows are cut into even chunks in (key, time, id) order, so a hot key spans many chunks. Three passes:

1. every chunk describes in one row the function from the state that enters it to the state that leaves it;
2. those functions are composed up a tree of small groups, and the states handed down the same tree;
3. every chunk replays its rows from the state that enters it.

The functions (`shifts.py`) are closed under composition, so this holds for every load: the number of jobs follows the depth
of the tree, no chunk waits for another one to be replayed, and the summaries never leave Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewaylens.operators import shifts
from gatewaylens.operators.ordered import in_order
from gatewaylens.operators.shifts import NEVER, Shifts
from gatewaylens.session import written

FOREVER = 2**62
RADIX = 8  # chunks combined by one group of the tree

# A chunk, or a run of chunks: its first key with the state that key begins with, its last key, where its axis begins and ends
# (time and rate of the first row, time and place of the newest; null without rows that count), and its function.
SUMMARY = (
    "place long, first_key string, first_state string, last_key string, head array<bigint>, tail array<bigint>, "
    "upto array<bigint>, fixed array<boolean>, by array<bigint>"
)
# What is kept of a key between runs: its state and the time of its newest row.
STATES = "key_ string, state_ string, seen_ long"
# How a chunk that holds one key only is described: it ends in a known state, has no row that counts, follows a closed form, is a
# step function of the entering time, or is none of these and composed row by row.
KNOWN, SAME, CLOSED, STEPS = "known", "same", "closed", "steps"


State = int | list[int] | None
Ends = tuple[int, int] | None


class Rule:
    """A recurrence. States are whole numbers or lists of them, None where the key has no history.

    On the axis of a chunk, a state is one whole number, `NEVER` for None: `enter` and `leave` translate.
    """

    def replay(self, state: State, times: list[int], args: list[int]) -> tuple[State, list[bool]]:
        raise NotImplementedError

    def summary(self) -> "Summary":
        raise NotImplementedError

    def enter(self, state: State, head: Ends) -> int:
        """A state where the axis with this head begins."""
        raise NotImplementedError

    def leave(self, place: int, tail: Ends) -> State:
        raise NotImplementedError

    def settle(self, state: State) -> tuple[int, Ends]:
        """A place and a tail that stand for a known state."""
        raise NotImplementedError

    def gap(self, tail: Ends, head: Ends) -> int:
        """How far the next axis begins behind the one before."""
        raise NotImplementedError

    def function(self, kind: str, payload: list, times: np.ndarray, args: np.ndarray) -> tuple[Ends, Ends, Shifts]:
        """Head, tail and function of a chunk of one key that is not KNOWN."""
        raise NotImplementedError


class Summary:
    """Builds the description of a chunk that holds one key only."""

    def add(self, times: list[int], args: list[int]) -> None:
        raise NotImplementedError

    def finish(self) -> tuple[str, list]:
        raise NotImplementedError


class Unresolved(Exception):
    pass


@dataclass
class Batch:
    """Columns of one Arrow batch and the first row of each run of equal keys in it."""

    keys: pa.Array
    times: np.ndarray
    args: np.ndarray
    starts: list[int]
    kept: pa.Array | None  # states kept from an earlier run

    def opening(self, row: int) -> State:
        """State of a key that begins at a row."""
        kept = None if self.kept is None else self.kept[row].as_py()
        return None if kept is None else json.loads(kept)


def _batches(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    last_key: str | None = None
    begun = False
    for batch in source:
        if batch.num_rows == 0:
            continue
        keys = batch.column("key_")
        changed = pc.not_equal(keys.slice(1), keys.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        starts = (np.flatnonzero(changed) + 1).tolist()
        if not begun or keys[0].as_py() != last_key:
            starts.insert(0, 0)
        begun, last_key = True, keys[batch.num_rows - 1].as_py()
        yield batch, Batch(
            keys, batch.column("at_").to_numpy(zero_copy_only=False), batch.column("arg_").to_numpy(zero_copy_only=False), starts,
            batch.column("state_") if "state_" in batch.schema.names else None,
        )


def _summarise(rule: Rule):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = first_key = first_state = last_key = None
        single, state = True, None
        summary = rule.summary()
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of one chunk and one key, while its end is not known
        for batch, b in _batches(source):
            if chunk is None:
                chunk, first_key = batch.column("chunk")[0].as_py(), b.keys[0].as_py()
                first_state = b.opening(0)
                b.starts = b.starts[1:]
            last_key = b.keys[batch.num_rows - 1].as_py()
            if b.starts:
                # Another key begins here: only the last one can go on in the next chunk.
                single, held = False, []
                begin = b.starts[-1]
                state, _ = rule.replay(b.opening(begin), b.times[begin:].tolist(), b.args[begin:].tolist())
            elif single:
                summary.add(b.times.tolist(), b.args.tolist())
                held = [] if summary.state is not None else [*held, (b.times, b.args)]
            else:
                state, _ = rule.replay(state, b.times.tolist(), b.args.tolist())
        if chunk is None:
            return
        kind, payload = summary.finish() if single else (KNOWN, [state])
        if kind == KNOWN:
            end, tail = rule.settle(payload[0])
            head, made = (0, 0), shifts.constant(end)
        elif kind == SAME:
            head, tail, made = None, None, shifts.identity()
        else:
            head, tail, made = rule.function(kind, payload, *(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_pylist([{
            "place": chunk, "first_key": first_key, "first_state": json.dumps(first_state), "last_key": last_key,
            "head": head, "tail": tail, "upto": made.upto, "fixed": made.fixed, "by": made.by,
        }], schema=_SUMMARY_ARROW)
    return run


_SUMMARY_ARROW = pa.schema([
    ("place", pa.int64()), ("first_key", pa.string()), ("first_state", pa.string()), ("last_key", pa.string()),
    ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64())),
    ("upto", pa.list_(pa.int64())), ("fixed", pa.list_(pa.bool_())), ("by", pa.list_(pa.int64())),
])


def _decide(rule: Rule, out: str, keep: bool = False):
    """Replays each chunk from the state in `enter_`. With `keep`, the last row of a key in each batch also
    carries the state after it."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, begun = None, False
        for batch, b in _batches(source):
            if not begun:
                begun = True
                known = batch.column("enter_")[0].as_py()
                state = None if known is None else json.loads(known)
                b.starts = b.starts[1:]
            times, args = b.times.tolist(), b.args.tolist()
            marks: list[bool] = []
            after: list[str | None] = [None] * batch.num_rows
            edges = [0, *b.starts, batch.num_rows] if not b.starts or b.starts[0] != 0 else [*b.starts, batch.num_rows]
            fresh = set(b.starts)
            for begin, end in zip(edges, edges[1:]):
                before = b.opening(begin) if begin in fresh else state
                state, outcome = rule.replay(before, times[begin:end], args[begin:end])
                marks.extend(outcome)
                after[end - 1] = None if state is None else json.dumps(state)
            decided = batch.append_column(out, pa.array(marks, pa.bool_()))
            if keep:
                decided = decided.append_column("after_", pa.array(after, pa.string()))
            yield decided.drop_columns([c for c in INNER if c in decided.schema.names and not (keep and c in KEPT)])
    return run


INNER = ("key_", "at_", "arg_", "state_", "pos", "chunk", "enter_")
KEPT = ("key_", "at_", "pos")


def step_function(events: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Closing time by entering time, for sorted distinct event times that fire at least `width` apart.

    From an entering time E the first event at or after E fires and blocks until `width` later. No entering
    time lies beyond the first event plus `width`, so only events up to there can be the first to fire.
    """
    following = np.searchsorted(events, events + width, "left").tolist()
    n = len(events)
    ends = [0] * n
    for i in range(n - 1, -1, -1):
        ends[i] = int(events[i]) + width if following[i] == n else ends[following[i]]
    entries = min(n, following[0] + 1) if n else 0
    return _distinct_steps(events[:entries], np.array(ends[:entries], dtype=np.int64))


def _distinct_steps(lo: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring steps with one result become one step."""
    if len(out) == 0:
        return lo, out
    last = np.append(out[1:] != out[:-1], True)
    return lo[last], out[last]


def apply_steps(lo: np.ndarray, out: np.ndarray, entering: np.ndarray) -> np.ndarray:
    at = np.searchsorted(lo, entering, "left")
    inside = at < len(lo)
    result = entering.copy()
    result[inside] = out[at[inside]]
    return result


@dataclass
class Link:
    """A chunk or a run of chunks, as a row of SUMMARY has it."""

    place: int
    first_key: str
    first_state: State
    last_key: str
    head: Ends
    tail: Ends
    made: Shifts

    @property
    def idle(self) -> bool:
        """One key without a row that counts: the state passes through."""
        return self.head is None

    def close(self, rule: Rule, state: State) -> State:
        return state if self.idle else rule.leave(int(self.made(rule.enter(state, self.head))), self.tail)


def _links(pdf: pd.DataFrame) -> list[Link]:
    def ends(value) -> Ends:
        return None if value is None else tuple(int(x) for x in value)

    return [
        Link(int(r.place), r.first_key, json.loads(r.first_state), r.last_key, ends(r.head), ends(r.tail),
             Shifts(np.asarray(r.upto, np.int64), np.asarray(r.fixed, bool), np.asarray(r.by, np.int64)))
        for r in pdf.sort_values("place").itertuples()]


def joined(rule: Rule, a: Link, b: Link) -> Link:
    """The run of `a` and then `b`."""
    if a.last_key != b.first_key:  # a key that begins with `b`: nothing of `a` comes through
        place, tail = rule.settle(b.close(rule, b.first_state))
        return Link(a.place, a.first_key, a.first_state, b.last_key, a.head or (0, 0), tail, shifts.constant(place))
    if b.idle:
        return Link(a.place, a.first_key, a.first_state, b.last_key, a.head, a.tail, a.made)
    if a.idle:
        return Link(a.place, a.first_key, a.first_state, b.last_key, b.head, b.tail, b.made)
    if a.tail is None:  # the key has no history yet
        made = shifts.constant(int(b.made(NEVER)))
    else:
        made = a.made.then(b.made, rule.gap(a.tail, b.head))
    return Link(a.place, a.first_key, a.first_state, b.last_key, a.head, b.tail, made)


def _compose(rule: Rule):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first, *later = _links(pdf)
        for link in later:
            first = joined(rule, first, link)
        made = first.made
        return pd.DataFrame([{
            "place": key[0], "first_key": first.first_key, "first_state": json.dumps(first.first_state), "last_key": first.last_key,
            "head": first.head, "tail": first.tail, "upto": made.upto, "fixed": made.fixed, "by": made.by}])
    return run


def _descend(rule: Rule):
    """The key before each member of a group and its state there, from those before the group."""
    def run(key: tuple, before: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        last, state = (before["last_key"].iloc[0], json.loads(before["state"].iloc[0])) if len(before) else (None, None)
        rows = []
        for link in _links(members):
            goes_on = link.first_key == last
            entering = state if goes_on else link.first_state
            rows.append((link.place, last, json.dumps(state), json.dumps(entering) if entering is not None else None))
            last, state = link.last_key, link.close(rule, entering)
        return pd.DataFrame(rows, columns=["place", "last_key", "state", "enter_"])
    return run


def _entering_states(rule: Rule, chunked: DataFrame) -> DataFrame:
    """(chunk, enter_): the state at the start of each chunk, null where its key has no history.

    Functions of RADIX neighbours are composed to one, again and again; then the states are handed down the same tree. A group
    holds a bounded number of summaries, whatever the key.
    """
    chunked = chunked.select("key_", "at_", "arg_", "chunk", *[c for c in chunked.columns if c == "state_"])
    levels = [chunked.mapInArrow(_summarise(rule), SUMMARY).checkpoint()]
    size = (levels[0].agg(F.max("place")).first()[0] or 0) + 1
    while size > RADIX:
        levels.append(levels[-1].groupBy(F.expr(f"place div {RADIX}").alias("group")).applyInPandas(_compose(rule), SUMMARY).checkpoint())
        size = -(-size // RADIX)
    found = chunked.sparkSession.createDataFrame([], "group long, last_key string, state string, enter_ string")
    for level in reversed(levels):
        members = level.withColumn("group", F.expr(f"place div {RADIX}"))
        pairs = found.groupBy("group").cogroup(members.groupBy("group"))
        found = pairs.applyInPandas(_descend(rule), "place long, last_key string, state string, enter_ string")
        found = found.withColumnRenamed("place", "group")
    return found.select(F.col("group").cast("int").alias("chunk"), "enter_").checkpoint()


def _replayed(
    df: DataFrame, rule: Rule, key: Column, at_us: Column, id_col: str, arg: Column, out: str, partitions: int | None,
    states: DataFrame | None = None,
) -> DataFrame:
    """Decided rows; with `states` they also carry `key_`, `at_`, `pos` and `after_`."""
    keep = states is not None
    zero = F.lit(0).cast("bigint")
    rows = df.withColumns({"key_": F.coalesce(key, F.lit("")), "at_": at_us, "arg_": F.coalesce(arg.cast("bigint"), zero)})
    if keep:
        # A row older than its key's state counts as arriving at the state's time.
        rows = rows.join(states, "key_", "left").withColumn("at_", F.greatest("at_", "seen_")).drop("seen_")
    order = [F.col("at_"), F.col(id_col)]
    placed = in_order(rows, ["key_"], order, partitions)
    # One row per chunk, so no more than there are partitions: small enough to go to every task.
    started = placed.join(F.broadcast(_entering_states(rule, placed)), "chunk", "left")
    passed_on = [f for f in placed.schema.fields if f.name in df.columns or (keep and f.name in KEPT)]
    added = [T.StructField(out, T.BooleanType())] + ([T.StructField("after_", T.StringType())] if keep else [])
    return started.select(*placed.columns, "enter_").mapInArrow(_decide(rule, out, keep), T.StructType([*passed_on, *added]))


def decide(
    df: DataFrame, rule: Rule, key: Column, at_us: Column, id_col: str, arg: Column, out: str, partitions: int | None = None
) -> DataFrame:
    """`df` with the boolean column `out`, decided row by row in (key, time, id) order, in as many chunks as
    `partitions` says."""
    return _replayed(df, rule, key, at_us, id_col, arg, out, partitions)


def decide_from(
    df: DataFrame, rule: Rule, key: Column, at_us: Column, id_col: str, arg: Column, out: str, states: DataFrame,
    partitions: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The same, going on from kept states: the decided rows, and the states of all keys afterwards.

    Deciding a log piece by piece in time order gives what deciding it whole gives, so history is read once.
    """
    rows = written(_replayed(df, rule, key, at_us, id_col, arg, out, partitions, states), "decided")
    fresh = rows.where("after_ IS NOT NULL").groupBy("key_").agg(
        F.max_by("after_", "pos").alias("state_"), F.max("at_").alias("seen_")
    )
    untouched = states.join(fresh.select("key_"), "key_", "left_anti")
    return rows.select(*df.columns, out), untouched.unionByName(fresh)


def no_states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATES)
