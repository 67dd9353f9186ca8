"""Work that needs an order inside a key, without ever giving a whole key to one task.

Rows are range-partitioned by (keys, order). With a unique id as the last order column the ranges come out even
however the keys are spread: a key that holds a third of the table simply spans a third of the partitions
("chunks"). What must pass from chunk to chunk is then one small row per chunk and key. Tables of all sizes
go the same way, and nothing is counted to choose it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewaylens.session import use_checkpoints, written

# Position = chunk number in the upper bits, row number inside the chunk below.
CHUNK_BITS = 33


def _placed(df: DataFrame, keys: Sequence[str], order: Sequence[Column], partitions: int | None) -> DataFrame:
    wanted = [F.col(k) for k in keys] + list(order)
    ranged = df.repartitionByRange(partitions, *wanted) if partitions else df.repartitionByRange(*wanted)
    placed = ranged.sortWithinPartitions(*wanted).withColumn("pos", F.monotonically_increasing_id())
    return placed.withColumn("chunk", F.shiftright("pos", CHUNK_BITS).cast("int"))


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """Rows sorted by (keys, order) over even chunks, one partition each, with columns `pos` and `chunk`.

    Range bounds come from a sample, so a second evaluation could cut elsewhere: the result is
    checkpointed once and every later pass reads the same cut. Select only the columns needed first.
    """
    use_checkpoints(df.sparkSession)
    return _placed(df, keys, order, partitions).checkpoint()


def numbered_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """The same rows as a written table, for passes that need `pos` and `chunk` but not the partitions.

    Written in columns, so that each pass reads only those it uses.
    """
    return written(_placed(df, keys, order, partitions), "ordered")


def chunk_offsets(chunked: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Per (keys, chunk): first position, and the sum of `value` over the key's earlier chunks.

    One row per key and chunk it touches, so the window runs over the summary and not over the rows.
    """
    sums = chunked.groupBy(*keys, "chunk").agg(F.min("pos").alias("first_pos"), F.sum(value).alias("inside"))
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("inside").over(earlier), F.lit(0).cast("bigint"))
    return sums.withColumn("before", before).drop("inside")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "n") -> DataFrame:
    """Row number from 1 within each key, exact.

    No key is in a single task: with few keys the offsets are little more than one row per chunk, and the
    rows are not shuffled again.
    """
    chunked = numbered_rows(df, keys, order)
    offsets = written(chunk_offsets(chunked, keys, F.lit(1).cast("bigint")), "offsets")
    joined = chunked.join(offsets, [*keys, "chunk"])
    number = F.col("pos") - F.col("first_pos") + F.col("before") + 1
    return joined.withColumn(name, number).drop("pos", "chunk", "first_pos", "before")


def with_next(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """`df` with the `value` of the row that follows within the key in `name`, null at the last one.

    Rows meet their follower by an equi-join on the number, so a key with very many rows is in no single task.
    """
    rows = written(numbered(df, keys, order, "n_"), "numbered")
    following = rows.select(*keys, (F.col("n_") - 1).alias("n_"), F.col(value).alias(name))
    return rows.join(following, [*keys, "n_"], "left").drop("n_")


def prefix_cutoff(
    df: DataFrame, axes: Sequence[str], weight: Column, need: int, cells: int = 1 << 16,
    known: tuple[int, int] | None = None,
) -> dict[str, int] | None:
    """The first row, in the order of the `axes`, at which the running weight reaches `need` (at least 1).

    Axes are whole numbers or timestamps (as microseconds); the last one must be unique, and no row may be null
    there. Each step counts weight over at most `cells` equal cells of the current range and narrows to the cell that
    holds the boundary: a few scans, filtered ever more tightly, with small results in place of a global sort. It is
    exact for any spread of values, many rows at one instant included. None where all weight is below `need`. `known`
    are bounds of the first axis between which the row is known to lie; it saves the scan for them.
    """
    here = df
    found: dict[str, int] = {}
    for name in axes:
        is_time = df.schema[name].dataType.typeName().startswith("timestamp")
        axis = F.unix_micros(F.col(name).cast("timestamp")) if is_time else F.col(name)

        def value(x: int, name: str = name, is_time: bool = is_time) -> Column:
            kind = df.schema[name].dataType
            return F.timestamp_micros(F.lit(x)).cast(kind) if is_time else F.lit(x).cast(kind)

        if known and name == axes[0]:
            low, high = known
        else:
            low, high, whole = here.agg(F.min(axis), F.max(axis), F.sum(weight)).first()
            if low is None or whole < need:
                return None
        while low < high:
            width = -(-(high - low + 1) // cells)
            cell = F.expr(f"(x - {low}L) div {width}L")
            # The bounds compare the plain column, so that the scan can skip what lies outside.
            inside = here.where((F.col(name) >= value(low)) & (F.col(name) <= value(high)))
            weights = inside.select(axis.alias("x"), weight.alias("w")).groupBy(cell.alias("cell")).agg(F.sum("w").alias("w"))
            for row in sorted(weights.collect()):
                if row["w"] >= need:
                    low, high = low + row["cell"] * width, min(high, low + (row["cell"] + 1) * width - 1)
                    break
                need -= row["w"]
            else:
                return None
        found[name] = low
        here = here.where(F.col(name) == value(low))
    return found
