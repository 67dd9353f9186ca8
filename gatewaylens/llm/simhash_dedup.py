"""SimHash near-dedup: all pairs of fingerprints within a radius, found by tiled exact comparison.

Distinct fingerprints are sorted by their number of set bits and cut into tiles. Two fingerprints within
`radius` bits differ by at most `radius` in that number, so only tile pairs whose ranges come that close
meet; each such pair is one row of a Spark join, compared by exclusive-or and bit counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewaylens.llm.common import fresh_name, slices
from gatewaylens.llm.components import connected_components
from gatewaylens.session import written

SHINGLE_WORDS = 3
SEED = 42  # fixed value of the fingerprint
RADIUS = 2
TILE = 8192
ROWS_AT_ONCE = 64


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each shingle of a text; a text with fewer words is one shingle, one without words none."""
    if not text:
        return []
    parts = text.encode().lower().split()  # on bytes: only A-Z, and only ASCII white space
    if not parts:
        return []
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [digest(b" ".join(parts), SEED)]
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    return [
        digest(joined[a:b], SEED)
        for a, b in zip(starts[: len(parts) - words + 1].tolist(), (ends[words - 1:] - 1).tolist())
    ]


def simhash(hashes: list[int]) -> int:
    """Bit i is set if it is set in over half the hashes; zero without hashes."""
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    values = np.array(hashes, dtype="<u8")
    for at in range(0, len(values), 1 << 16):
        part = values[at:at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, k1, k2, fingerprint as a signed 64-bit number) for each row; k1 and k2 are a digest of id and text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                marks = [simhash(shingle_hashes(t, words)) for t in part.column("t").to_pylist()]
                signed = np.array(marks, dtype=np.uint64).view(np.int64)
                kept = [part.column(c) for c in ("i", "k1", "k2")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(signed)], names=["i", "k1", "k2", "fp"])

    picked = docs.select(F.col(id_col).alias("i"), *row_digest(id_col, text), F.col(text).alias("t"))
    return picked.mapInArrow(run, f"i {kind}, k1 bigint, k2 bigint, fp bigint")


def row_digest(id_col: str, text: str) -> list[Column]:
    """128 bits that two rows share only if they agree in id and text; nulls count as values of their own."""
    return [
        F.xxhash64(F.lit(salt), F.col(id_col).isNull(), id_col, F.col(text).isNull(), text).alias(f"k{salt}")
        for salt in (1, 2)
    ]


def _tiles(distinct: DataFrame) -> DataFrame:
    """Rows (tile, low, high, marks): up to TILE fingerprints sorted by their number of set bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, task, number = np.empty(0, np.int64), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column("task")[0].as_py() if task is None else task
            held = np.concatenate([held, batch.column("fp").to_numpy()])
            while len(held) >= TILE:
                yield tile(held[:TILE], (task << 32) + number)
                held, number = held[TILE:], number + 1
        if len(held):
            yield tile(held, (task << 32) + number)

    def tile(marks: np.ndarray, name: int) -> pa.RecordBatch:
        bits = np.bitwise_count(marks.view(np.uint64))
        return pa.RecordBatch.from_pydict({
            "tile": pa.array([name], pa.int64()), "low": pa.array([int(bits[0])], pa.int32()),
            "high": pa.array([int(bits[-1])], pa.int32()), "marks": pa.array([marks.tobytes()], pa.binary())})

    order = [F.bit_count("fp"), F.col("fp")]
    placed = distinct.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("task", F.spark_partition_id().cast("bigint"))
    return placed.mapInArrow(run, "tile bigint, low int, high int, marks binary")


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius; both sides are sorted by bit count."""
    bits_a, bits_b = np.bitwise_count(a), np.bitwise_count(b)
    for at in range(0, len(a), ROWS_AT_ONCE):
        rows = a[at:at + ROWS_AT_ONCE]
        low = np.searchsorted(bits_b, max(0, int(bits_a[at]) - radius), "left")
        high = np.searchsorted(bits_b, int(bits_a[at + len(rows) - 1]) + radius, "right")
        if low >= high:
            continue
        apart = np.bitwise_count(rows[:, None] ^ b[None, low:high])
        i, j = np.nonzero(apart <= radius)
        if len(i):
            yield i + at, j + low


def _forest(links: Iterator[tuple[np.ndarray, np.ndarray]], shift: int, size: int) -> list[tuple[int, int]]:
    """The links that join something new: a spanning forest with the same components, at most `size` links."""
    parent = list(range(size))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i, j in links:
        for x, y in zip(i.tolist(), (j + shift).tolist()):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                kept.append((x, y))
    return kept


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints `fp` within `radius` bits, directly or along a path.

    Every pair of tiles that can hold a link is compared in full; of a tile pair's links only a spanning
    forest goes on, so a dense group costs rows in proportion to its members and not to its pairs.
    """
    tiles = written(_tiles(distinct), "tiles")
    # A tile meets another through the numbers of set bits: at most 65 of them, whatever the size.
    reach = tiles.select(F.col("tile").alias("a"), F.explode(F.sequence("low", F.col("high") + radius)).alias("bits"))
    own = tiles.select(F.col("tile").alias("b"), F.col("low").alias("bits"))
    # Tiles are in order: a pair can hold a link if the later one's lowest number lies in the earlier one's reach.
    pairs = reach.join(own, "bits").where("a <= b").select("a", "b")
    pairs = pairs.join(tiles.select(F.col("tile").alias("a"), F.col("marks").alias("left")), "a")
    pairs = pairs.join(tiles.select(F.col("tile").alias("b"), F.col("marks").alias("right")), "b").repartition("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, left, right in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "left", "right"))):
                x = np.frombuffer(left, np.uint64)
                y = x if a == b else np.frombuffer(right, np.uint64)
                same = 0 if a == b else len(x)
                kept = _forest(_near(x, y, radius), same, len(x) + (len(y) if same else 0))
                if kept:
                    i, j = np.array(kept).T
                    ends = x[i].view(np.int64), y[j - same].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(e) for e in ends], names=["a", "b"])

    return pairs.select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int = RADIUS, words: int = SHINGLE_WORDS
) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id): classes of near-copies, one row per input row.

    The class is named by its smallest id, reached over links of at most `radius` differing bits. Null and
    empty texts have fingerprint zero and are linked like any other. Rows with a null id get a class too; the
    class of rows whose ids are all null has a null name. Repeated rows stay. An empty table gives no rows; other columns,
    whatever their names, are not looked at.
    """
    marked = written(fingerprints(docs, text, id_col, words), "fingerprints")
    placed = _classes(marked, radius)
    names = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = written(placed.join(names, "component").select("fp", "component_id"), "classes")
    mark = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(named, "fp").select(F.col("i").alias(id_col), mark.alias("fingerprint"), "component_id")


def _classes(marked: DataFrame, radius: int) -> DataFrame:
    """(fp, first id, component) for each distinct fingerprint."""
    firsts = written(marked.groupBy("fp").agg(
        F.min("i").alias("first"), F.min(F.struct(F.col("i").isNull(), "i", "k1", "k2")).alias("row")), "distinct")
    found = connected_components(fingerprint_links(firsts.select("fp"), radius), "a", "b")
    return firsts.join(found, firsts["fp"] == found["node"], "left").select(
        "fp", "first", "row", F.coalesce("component", "fp").alias("component"))


def keep_first(docs: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """`docs` with one row of each class of near-copies: that with the smallest id (rows without an id come last).

    Of rows that share this id, one stays. All columns are kept as they are.
    """
    marked = written(fingerprints(docs, text, id_col), "fingerprints")
    first = _classes(marked, radius).groupBy("component").agg(F.min("row").alias("row"))
    keys = [fresh_name("k1"), fresh_name("k2")]
    chosen = written(first.select(*[F.col(f"row.k{n}").alias(k) for n, k in enumerate(keys, 1)]), "chosen")
    marks = [c.alias(k) for c, k in zip(row_digest(id_col, text), keys)]
    return docs.select("*", *marks).join(chosen, keys, "left_semi").dropDuplicates(keys).drop(*keys)
