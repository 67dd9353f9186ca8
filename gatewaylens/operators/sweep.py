"""Which of the spans that are live at a moment comes first: an ordered sweep over even chunks.

Spans and probes of a key lie in one order of time, so a row is shuffled once. What a sweep has to remember is the skyline of
live spans: one that ranks lower and ends no later than another can never win again. A key that holds a third of all rows
spans a third of the chunks; from chunk to chunk goes its skyline only, merged up a tree of small groups and handed down
the same tree.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from gatewaylens.operators.ordered import CHUNK_BITS, in_order

FOREVER = 2**62
RADIX = 8  # chunks in one group of the tree


class Skyline:
    """Live spans by falling rank and rising end; each is (rank, end, payload)."""

    def __init__(self, spans: list[tuple] = ()):
        self.ranks: list = []  # rising, so that the best is at the end of the lists
        self.ends: list[int] = []
        self.loads: list = []
        for span in spans:
            self.add(*span)

    def add(self, rank, end: int, load) -> None:
        ranks, ends = self.ranks, self.ends
        at = bisect_left(ranks, rank)
        same = at < len(ranks) and ranks[at] == rank
        if same and ends[at] >= end or any_longer(ends, at + same, end):
            return
        low = at  # lower ranks that end no later
        while low and ends[low - 1] <= end:
            low -= 1
        past = at + same
        ranks[low:past], ends[low:past], self.loads[low:past] = [rank], [end], [load]

    def best(self, at: int):
        """Payload of the highest rank that is live after `at`; what has ended is forgotten."""
        while self.ends and self.ends[-1] <= at:
            self.ranks.pop()
            self.ends.pop()
            self.loads.pop()
        return self.loads[-1] if self.loads else None

    def hold(self) -> list:
        """The payloads; in their place stand their numbers, so that a batch's payloads can be numbered on, until `release`."""
        held = self.loads
        self.loads = list(range(len(held)))
        return held

    def release(self, held: list, more: pa.Array) -> None:
        """Numbers become payloads again: first those that `hold` gave, then those of a column. Only what is left is made a Python value."""
        self.loads = [held[n] if n < len(held) else more[n - len(held)].as_py() for n in self.loads]

    def spans(self, after: int = -FOREVER) -> list[tuple]:
        return [s for s in zip(self.ranks, self.ends, self.loads) if s[1] > after]


def any_longer(ends: list[int], at: int, end: int) -> bool:
    """Whether a span of higher rank ends no earlier: ends fall with rising rank, so the next higher one decides."""
    return at < len(ends) and ends[at] >= end


def _packed(spans: list[tuple]) -> dict[str, list]:
    ranks, ends, loads = (list(x) for x in zip(*spans)) if spans else ([], [], [])
    return {"ranks": ranks, "ends": ends, "loads": loads}


def _unpacked(row) -> list[tuple]:
    def plain(value):
        return tuple(plain(v) for v in value) if isinstance(value, (list, tuple, np.ndarray)) else value

    return [(plain(rank), int(end), load) for rank, end, load in zip(row.ranks, row.ends, row.loads)]


def _closing(source: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per chunk: its first key, its last key with the skyline where it ends, and whether that began here."""
    place = first = last = newest = None
    sky, single = Skyline(), True
    for batch in source:
        if not batch.num_rows:
            continue
        keys, ends = batch.column("key_"), batch.column("end_")
        if place is None:
            place, first = batch.column("chunk")[0].as_py(), keys[0].as_py()
            last = first
        ending = keys[-1].as_py()
        if ending != last:
            last, sky, single = ending, Skyline(), False
        newest = batch.column("at_")[-1].as_py()
        if last is None:
            continue
        # Only spans that live on where the chunk ends count, and it does not end before this batch.
        live = batch.filter(pc.and_(pc.equal(keys, last), pc.greater(ends, -FOREVER if newest is None else newest)))
        held = sky.hold()
        for number, (rank, end) in enumerate(zip(_ranks(live.column("rank_")), _whole(live.column("end_"))), len(held)):
            sky.add(rank, end, number)
        sky.release(held, live.column("load_"))
    if place is not None:
        spans = sky.spans(newest if newest is not None else -FOREVER)
        yield pa.RecordBatch.from_pylist([{"place": place, "first_key": first, "last_key": last, "single": single, "newest": newest, **_packed(spans)}], schema=schema)


def _key(rank):
    return tuple(rank) if isinstance(rank, list) else rank


def _whole(column: pa.Array) -> list[int]:
    """Whole numbers, null as 0."""
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).tolist()


def _ranks(column: pa.Array) -> list:
    """Ranks as values that compare. Arrays of whole numbers that are equally long are cut from all their numbers in a row."""
    if len(column) and pa.types.is_list(column.type) and pa.types.is_integer(column.type.value_type) and not column.null_count:
        flat, sizes = column.flatten(), pc.list_value_length(column)
        width = sizes[0].as_py()
        if width and not flat.null_count and pc.all(pc.equal(sizes, width)).as_py():
            numbers = flat.to_numpy(zero_copy_only=False).reshape(-1, width)
            return list(zip(*(part.tolist() for part in numbers.T)))
    return [_key(rank) for rank in column.to_pylist()]


def _merged(first, later: list) -> dict:
    key, single, newest, spans = first.last_key, bool(first.single), first.newest, _unpacked(first)
    for row in later:
        goes_on = row.first_key == key and row.single
        spans = Skyline([*(spans if goes_on else []), *_unpacked(row)]).spans(-FOREVER if pd.isna(row.newest) else int(row.newest))
        single = single and goes_on
        key, newest = row.last_key, row.newest
    return {"first_key": first.first_key, "last_key": key, "single": single, "newest": newest, **_packed(spans)}


def _up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    first, *later = pdf.sort_values("place").itertuples()
    return pd.DataFrame([{"place": key[0], **_merged(first, later)}])


def _down(names: list[str]) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, before: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        last, spans = (before["last_key"].iloc[0], _unpacked(next(before.itertuples()))) if len(before) else (None, [])
        rows = []
        for row in members.sort_values("place").itertuples():
            rows.append({"place": row.place, "last_key": last, **_packed(spans)})
            goes_on = row.first_key == last and row.single
            spans = Skyline([*(spans if goes_on else []), *_unpacked(row)]).spans(-FOREVER if pd.isna(row.newest) else int(row.newest))
            last = row.last_key
        return pd.DataFrame(rows, columns=names)
    return run


def best_live(
    probes: DataFrame, spans: DataFrame, key: Callable[[], Column], at: str, begin: Column, end: Column, rank: Column, load: Column, out: str,
    partitions: int | None = None,
) -> DataFrame:
    """`probes` with `out`: `load` of the highest-ranking span of the same key that began before and ends after the probe's time, else null.

    `key` makes the key from either side's columns (a text; rows where it is null meet nothing), `at` names the probe's time, `begin`
    and `end` are times of the spans (no end: live for ever; no begin: never live). `rank` is a number, a text or an array of numbers,
    without nulls. Of spans with equal rank the one that ends last counts. Probes come back as they are, once each.
    """
    use = [f for f in probes.schema.fields]
    asked = probes.select(
        "*", key().alias("key_"), _micros(F.col(at)).alias("at_"), F.lit(None).cast(LongType()).alias("end_"), F.monotonically_increasing_id().alias("tie_"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in use]
    given = spans.select(
        *none, key().alias("key_"), _micros(begin).alias("at_"), F.coalesce(_micros(end), F.lit(FOREVER)).alias("end_"),
        F.monotonically_increasing_id().alias("tie_"), rank.alias("rank_"), load.alias("load_")).where("key_ IS NOT NULL AND at_ < end_")
    rows = asked.unionByName(given, allowMissingColumns=True)
    kinds = {name: rows.schema[name].dataType for name in ("rank_", "load_")}
    # At one time probes come before spans: a span has to begin before them.
    placed = in_order(rows, ["key_"], [F.col("at_"), F.col("end_").isNotNull(), F.col("tie_")], partitions)
    skyline = [StructField("ranks", ArrayType(kinds["rank_"])), StructField("ends", ArrayType(LongType())), StructField("loads", ArrayType(kinds["load_"]))]
    summary = StructType([StructField("place", LongType()), StructField("first_key", StringType()), StructField("last_key", StringType()),
                          StructField("single", BooleanType()), StructField("newest", LongType()), *skyline])
    entering = StructType([StructField("place", LongType()), StructField("last_key", StringType()), *skyline])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(summary)
    ends_of = placed.select("chunk", "key_", "at_", "end_", "rank_", "load_")
    levels = [ends_of.mapInArrow(lambda source: _closing(source, arrow), summary).checkpoint()]
    size = (levels[0].agg(F.max("place")).first()[0] or 0) + 1
    while size > RADIX:
        levels.append(levels[-1].groupBy(F.expr(f"place div {RADIX}").alias("group")).applyInPandas(_up, summary).checkpoint())
        size = -(-size // RADIX)
    found = probes.sparkSession.createDataFrame([], entering).withColumnRenamed("place", "group")
    for level in reversed(levels):
        pairs = found.groupBy("group").cogroup(level.withColumn("group", F.expr(f"place div {RADIX}")).groupBy("group"))
        found = pairs.applyInPandas(_down(entering.names), entering).withColumnRenamed("place", "group")
    carried = found.select(F.shiftleft("group", CHUNK_BITS).alias("pos"), "last_key", F.struct("ranks", "ends", "loads").alias("carried_")).checkpoint()
    # One row per chunk; its skyline holds live spans only, none of which another one outranks and outlives. It meets the chunk's first row only.
    started = placed.join(F.broadcast(carried), "pos", "left")
    made = StructType([*use, StructField(out, kinds["load_"])])
    found_type = to_arrow_schema(StructType([made[out]])).field(0).type

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sky, begun = None, Skyline(), False
        for batch in source:
            if not batch.num_rows:
                continue
            if not begun:
                begun, last = True, batch.column("last_key")[0].as_py()
                carry = batch.column("carried_")[0].as_py() or {"ranks": [], "ends": [], "loads": []}
                sky = Skyline([(_key(r), e, p) for r, e, p in zip(carry["ranks"], carry["ends"], carry["loads"])])
            answers, chosen = [], []
            keys, ends, loads = (batch.column(c) for c in ("key_", "end_", "load_"))
            codes = pc.fill_null(keys.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(codes)) + 1
            span, times, untimed = (pc.is_valid(ends).to_numpy(zero_copy_only=False), _whole(batch.column("at_")),
                                    pc.is_null(batch.column("at_")).to_numpy(zero_copy_only=False))
            ranks, until = iter(_ranks(batch.column("rank_").filter(pa.array(span)))), _whole(ends)
            mute, span = (untimed | (codes < 0)).tolist(), span.tolist()
            held = sky.hold()
            base = len(held)
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                key = keys[start].as_py()
                if key != last:
                    last, sky = key, Skyline()
                for number in range(start, stop):
                    if span[number]:
                        sky.add(next(ranks), until[number], base + number)
                    else:
                        chosen.append(number)
                        answers.append(None if mute[number] else sky.best(times[number]))
            sky.release(held, loads)
            given = pa.concat_arrays([pa.array(held, loads.type), loads]).take(pa.array(answers, pa.int64()))
            part = batch.take(pa.array(chosen, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(f.name) for f in use), given.cast(found_type)], names=[*(f.name for f in use), out])

    # Others have an empty one: Arrow's writer takes time with the square of a batch for arrays inside of structs that are null.
    empty = F.struct(*[F.array().cast(f.dataType).alias(f.name) for f in skyline])
    brought = F.coalesce("carried_", empty).alias("carried_")
    return started.select(*(f.name for f in use), "key_", "at_", "end_", "rank_", "load_", "last_key", brought).mapInArrow(run, made)


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))
