"""Language-model scoring with a weighted backoff automaton.

States are the root, words and pairs of words, all that occur. A state's arcs carry the smoothed log-probability of a
next token; for any other token a failure arc leads to the state of the shorter history, at its backoff weight. At the
root every token has its smoothed relative frequency.

Every n-gram of the training documents counts, however rare it is and however large the corpus. Documents are cut into
blocks; a block sends its distinct n-grams with their counts, sorted and packed, to shards and gets back, in the same order,
what the arcs and failure arcs of these n-grams need. All that follows from whole numbers: an n-gram's count, and per
history how many arcs it has and how often the shorter history goes on with the tokens of these arcs.

A shard has all n-grams (a, b, c) of its middle words b, so it knows the arcs of (a, b), those of b, and the counts of
(b, c), which are sums over a. A frequent middle word is spread over several shards by c; the numbers of its histories are
added up in shards of histories, which a block asks in the same way: packed names go there, packed numbers come back in order.

Words are counted in shards of their own, by names of 64 bits, and numbered there: frequent words have small numbers, which
take one to three bytes where a name takes eight. N-grams are sent by these numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewaylens.llm.common import group_returned, memory_returned, slices
from gatewaylens.session import new_path, written

BLOCK_BYTES = 6 << 20
SHARD_TOKENS = 800_000  # n-grams of one shard, about
TOKENS_AT_ONCE = 200_000  # of a block, in the walk
DISCOUNT = 0.75
ADDED = 0.1
END = ""  # counted as a token; no word is empty
START, NOTHING = 0, 1  # numbers of the beginning of a text and of what is before it; words have the numbers after these
ALONE = np.array([2**64 - 1], np.uint64)  # in place of the first word, in the name of a history of one word
WORDS, GRAMS, HISTORIES, ASKED, PARTS = range(5)  # kinds of packed rows: three answers to a block; what a block asks of spread histories; their parts


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, codes of all tokens (each text's words, then the end), and tokens per text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = pc.list_flatten(parts)
    rows = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    flat, rows = flat.filter(pa.array(real)), rows[real]
    coded = pc.dictionary_encode(pa.concat_arrays([pa.array([END], flat.type), flat]))
    inside = coded.indices.to_numpy(zero_copy_only=False)[1:].astype(np.int32)
    counts = np.bincount(rows, minlength=len(texts)) if len(rows) else np.zeros(len(texts), np.int64)
    ends = np.cumsum(counts)
    return coded.dictionary, np.insert(inside, ends, 0), counts + 1


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as bytes: all first bytes, all second bytes and so on, compressed."""
    values = np.ascontiguousarray(values)
    return zstandard.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), 3)


def unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the place among them of every key; with less memory than numpy's own."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at = np.empty(len(keys), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return ranked[new], at


def _dense(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `_distinct`, by a table of the numbers where that is small; they are not negative."""
    size = int(numbers.max(initial=0)) + 1
    if size > 4 * len(numbers) + 1024:
        return _distinct(numbers)
    there = np.zeros(size, bool)
    there[numbers] = True
    return np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[numbers]


def _triples(a: np.ndarray, b: np.ndarray, c: np.ndarray, sizes: tuple[int, int, int]) -> tuple[np.ndarray, ...]:
    """Distinct (a, b, c) in the order of b, c, a: their a, b and c, and the place among them of every triple.

    The three are codes below the `sizes`; one sort where a triple fits into 63 bits.
    """
    size_a, size_b, size_c = sizes
    if size_a * size_b * size_c < 2**63:
        whole, entry = _distinct((b.astype(np.int64) * size_c + c) * size_a + a)
        of = whole // size_a
    else:
        pairs, pair = _distinct(b.astype(np.int64) * size_c + c)
        whole, entry = _distinct(pair.astype(np.int64) * size_a + a)
        of = pairs[whole // size_a]
    return (whole % size_a).astype(np.int32), (of // size_c).astype(np.int32), (of % size_c).astype(np.int32), entry


def blocks_of(docs: DataFrame, train: Column, text: str, id_col: str) -> DataFrame:
    """Documents in blocks, tokenised once: (block, hashes, ids, train, sizes, codes, and three totals).

    A table in buckets of blocks, so that the two later passes that bring a block its answers do not shuffle it.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for part in slices(batch, "t", BLOCK_BYTES):
                words, codes, sizes = _tokens(part.column("t"))
                task = part.column("task")[0].as_py()
                values = part.column("i"), part.column("train"), pa.array(sizes.astype(np.int64))
                learned = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
                one = pa.array([0, len(part)], pa.int32())
                totals = len(codes), sizes[learned].sum(), learned.sum()
                yield pa.RecordBatch.from_arrays([
                    pa.array([(task << 32) + number], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                    *(pa.ListArray.from_arrays(one, v) for v in values),
                    pa.array([pack(codes.astype(np.int32))], pa.binary()),
                    *(pa.array([int(n)], pa.int64()) for n in totals),
                ], names=["block", "words", "ids", "train", "sizes", "codes", "tokens", "train_tokens", "train_docs"])
                number += 1

    spark = docs.sparkSession
    picked = docs.select(
        F.col(id_col).alias("i"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("t"),
        F.spark_partition_id().cast("bigint").alias("task"))
    schema = (f"block bigint, words array<string>, ids array<{kind}>, train array<boolean>, sizes array<bigint>, codes binary, "
              "tokens bigint, train_tokens bigint, train_docs bigint")
    cut = picked.mapInArrow(memory_returned(run), schema).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).drop("words")
    path = new_path(spark, "blocks")
    table = "lm_" + path.rsplit("-", 1)[1]
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)  # Spark's own bound of buckets
    cut.write.format("parquet").bucketBy(buckets, "block").option("path", path).saveAsTable(table)
    return spark.table(table)


@dataclass(frozen=True)
class Sizes:
    """Totals of the blocks, and how n-grams are dealt to shards."""

    tokens: int  # of the training texts
    texts: int  # training texts
    shards: int
    most: int  # occurrences from which a middle word is spread

    @staticmethod
    def of(blocks: DataFrame) -> Sizes:
        total = blocks.agg(*(F.sum(c) for c in ("tokens", "train_tokens", "train_docs"))).first()
        every, tokens, texts = (int(n or 0) for n in total)
        return Sizes(tokens, texts, every // SHARD_TOKENS + 1, SHARD_TOKENS)


def _mixed(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Names of pairs: for a fixed history another name for each word, for a fixed word another for each history."""
    x = (history ^ (history >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


PACKED = "block bigint, shard int, data array<binary>, kind tinyint"


class _Block:
    """One row of the blocks. Words have codes: places among the hashes, and once numbers are there places among these."""

    def __init__(self, row: pa.Table | pa.RecordBatch, at: int = 0) -> None:
        self.codes = unpack(row.column("codes")[at].as_py(), np.int32)
        self.hashes = row.column("hashes")[at].values.to_numpy().view(np.uint64)
        self.sizes = row.column("sizes")[at].values.to_numpy()
        train = row.column("train")[at].values.to_numpy(zero_copy_only=False).astype(bool)
        self.learned = np.repeat(train, self.sizes)

    def word_order(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of words by shard and name, and the bounds of the shards among them."""
        shard = (self.hashes % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((self.hashes, shard))
        return order, np.searchsorted(shard[order], np.arange(shards + 1))

    def take_counts(self, rows: list[tuple[int, list[bytes]]], sizes: Sizes) -> None:
        """Occurrences of the words in the training texts and in all texts, from the word shards' answers."""
        order, bounds = self.word_order(sizes.shards)
        counts = np.zeros((3, len(order)), np.int64)
        for shard, data in rows:
            own = order[bounds[shard]:bounds[shard + 1]]
            counts[:, own] = [unpack(d) for d in data]
            counts[2, own] = counts[2, own] * sizes.shards + shard + 2
        sort = np.argsort(counts[2], kind="stable")
        code = np.empty(len(sort), np.int32)
        code[sort] = np.arange(2, len(sort) + 2, dtype=np.int32)
        self.codes = code[self.codes]
        seen, every, number = counts[:, sort]
        self.seen = np.concatenate([[sizes.texts, 0], seen])
        self.spread = np.concatenate([[sizes.texts, 0], every]) // sizes.most + 1
        self.numbers = np.concatenate([[START, NOTHING], number])

    def grams(self, sizes: Sizes) -> None:
        """Distinct (a, b, c) that end at the tokens, in the order in which they are sent, by shard."""
        base = len(self.numbers)
        place = np.arange(len(self.codes), dtype=np.int32) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes).astype(np.int32)
        middle, first = np.full(len(place), START, np.int32), np.full(len(place), NOTHING, np.int32)
        np.copyto(middle[1:], self.codes[:-1], where=place[1:] > 0)
        first[place == 1] = START
        np.copyto(first[2:], self.codes[:-2], where=place[2:] > 1)
        a, b, c, entry = _triples(first, middle, self.codes, (base, base, base))
        del middle, first
        numbers = self.numbers.view(np.uint64)
        shard = _mixed(ALONE, numbers)[b] + numbers[c] % self.spread.astype(np.uint64)[b]
        shard = (shard % np.uint64(sizes.shards)).astype(np.uint16 if sizes.shards < 1 << 16 else np.int64)  # 16 bits are sorted by radix
        order = np.argsort(shard, kind="stable")
        self.bounds = np.searchsorted(shard[order], np.arange(sizes.shards + 1))
        at = np.empty(len(order), np.int32)
        at[order] = np.arange(len(order), dtype=np.int32)
        self.starts, self.entry = place == 0, at[entry]
        self.a, self.b, self.c = a[order], b[order], c[order]

    def histories(self, sizes: Sizes) -> None:
        """Distinct spread histories, of two words (a, b) and of one (b), in the order in which they are asked, by shard."""
        self.far = np.flatnonzero(self.spread[self.b] > 1)
        a, b, base = self.a[self.far], self.b[self.far], len(self.numbers)
        pairs, pair = _distinct(b.astype(np.int64) * base + a)
        words, word = _dense(b)
        of_b = self.numbers[np.concatenate([pairs // base, words])]
        of_a = np.concatenate([self.numbers[pairs % base] + 1, np.zeros(len(words), np.int64)])
        order, self.asked_bounds = _dealt(of_a, of_b, sizes.shards)
        self.asked_a, self.asked_b = of_a[order], of_b[order]
        at = np.empty(len(order), np.int32)
        at[order] = np.arange(len(order), dtype=np.int32)
        self.pair_at, self.word_at = at[pair], at[len(pairs) + word]


def _dealt(a: np.ndarray, b: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Histories in the order of their shards, and the bounds of these; `a` is the first word's number and one, 0 where there is none."""
    first = np.where(a > 0, (a - 1).view(np.uint64), ALONE)
    shard = (_mixed(first, b.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _split(rows: pa.Table) -> dict[int, list]:
    """What was sent to a block, by kind."""
    found = {WORDS: [], GRAMS: [], HISTORIES: []}
    for kind, shard, data in zip(*(rows.column(c).to_pylist() for c in ("kind", "shard", "data"))):
        found[kind].append((shard, data))
    return found


def _sent(blocks: list[int], shards: list[int], data: list[list[bytes]]) -> list[pa.Array]:
    return [pa.array(blocks, pa.int64()), pa.array(shards, pa.int32()), pa.array(data, pa.list_(pa.binary()))]


def _kinds(kinds: list[int]) -> pa.Array:
    return pa.array(kinds, pa.int8())


def word_counts(blocks: DataFrame, sizes: Sizes) -> DataFrame:
    """For every block and word shard, the counts of the block's words over all blocks and their numbers in the shard, the most
    frequent first; and once a shard how many distinct words the training texts have there."""

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = _Block(batch, row)
                order, bounds = block.word_order(sizes.shards)
                every = np.bincount(block.codes, minlength=len(order))
                train = np.bincount(block.codes[block.learned], minlength=len(order))
                shards = np.flatnonzero(np.diff(bounds)).tolist()
                data = []
                for shard in shards:
                    own = order[bounds[shard]:bounds[shard + 1]]
                    data.append([pack(np.diff(block.hashes[own], prepend=np.uint64(0))), pack(train[own]), pack(every[own])])
                number = batch.column("block")[row].as_py()
                yield pa.RecordBatch.from_arrays(_sent([number] * len(shards), shards, data), names=["block", "shard", "data"])

    def add(rows: pa.Table) -> pa.Table:
        packed = rows.column("data").to_pylist()
        names = [np.cumsum(unpack(d[0], np.uint64), dtype=np.uint64) for d in packed]
        ends = np.cumsum([len(n) for n in names])[:-1]
        own, at = np.unique(np.concatenate(names), return_inverse=True)
        train, every = (np.bincount(at, np.concatenate([unpack(d[n]) for d in packed]), len(own)).astype(np.int64) for n in (1, 2))
        rank = np.empty(len(own), np.int64)
        rank[np.argsort(-every, kind="stable")] = np.arange(len(own))
        data = [[pack(x[part]) for x in (train, every, rank)] for part in np.split(at, ends)]
        distinct = np.zeros(len(packed), np.int64)
        distinct[0] = np.count_nonzero(train)
        columns = _sent(rows.column("block").to_pylist(), rows.column("shard").to_pylist(), data)
        return pa.table([*columns, pa.array(distinct)], names=["block", "shard", "data", "words"])

    offered = blocks.select("block", "hashes", "train", "sizes", "codes").mapInArrow(
        memory_returned(offer), "block bigint, shard int, data array<binary>").repartition(sizes.shards, "shard")
    return written(offered.groupBy("shard").applyInArrow(
        lambda rows: group_returned(add, rows), "block bigint, shard int, data array<binary>, words bigint"), "words")


def gram_numbers(blocks: DataFrame, counts: DataFrame, sizes: Sizes) -> DataFrame:
    """For every block and shard the numbers of the block's n-grams (GRAMS).

    Beside them, by shards of histories, what the blocks ask of spread histories (ASKED, as they sent it) and the parts of
    these histories' numbers (PARTS, without a block).
    """

    def offer(block: pa.Table, known: pa.Table) -> pa.Table:
        number = block.column("block")[0].as_py()
        block = _Block(block.combine_chunks())
        block.take_counts(_split(known)[WORDS], sizes)
        block.grams(sizes)
        n = np.bincount(block.entry[block.learned], minlength=len(block.a))
        shards = np.flatnonzero(np.diff(block.bounds)).tolist()
        data = []
        for shard in shards:
            own = slice(block.bounds[shard], block.bounds[shard + 1])
            middle, last = _dense(block.b[own])[0], _dense(block.c[own])[0]
            data.append([pack(np.diff(block.numbers[block.b[own]], prepend=0)), pack(block.numbers[block.c[own]]),
                         pack(block.numbers[block.a[own]]), pack(n[own]), pack(block.spread[middle]), pack(block.seen[last])])
        block.histories(sizes)
        asked = np.flatnonzero(np.diff(block.asked_bounds)).tolist()
        kinds = [GRAMS] * len(shards) + [ASKED] * len(asked)
        for shard in asked:
            own = slice(block.asked_bounds[shard], block.asked_bounds[shard + 1])
            data.append([pack(np.diff(block.asked_b[own], prepend=0)), pack(block.asked_a[own])])
        shards += asked
        return pa.table([*_sent([number] * len(shards), shards, data), _kinds(kinds)], names=["block", "shard", "data", "kind"])

    def add(rows: pa.Table) -> pa.Table:
        is_asked = pc.equal(rows.column("kind"), ASKED)
        asked, rows = rows.filter(is_asked), rows.filter(pc.invert(is_asked))
        if not rows.num_rows:
            return asked
        packed = rows.column("data").to_pylist()
        columns = [[np.cumsum(unpack(d[0])) for d in packed], *([unpack(d[k]) for d in packed] for k in (1, 2))]
        ends = np.cumsum([len(x) for x in columns[0]])[:-1]
        middle, b = _dense(np.concatenate(columns.pop(0)))
        last, c = _dense(np.concatenate(columns.pop(0)))
        first, a = _dense(np.concatenate(columns.pop(0)))
        # Sent once a row for its distinct middle and last words, in the order of their numbers.
        spread, seen = np.ones(len(middle), np.int64), np.zeros(len(last), np.int64)
        for d, of_b, of_c in zip(packed, np.split(b, ends), np.split(c, ends)):
            spread[_dense(of_b)[0]], seen[_dense(of_c)[0]] = unpack(d[4]), unpack(d[5])
        n = np.concatenate([unpack(d[3]) for d in packed])
        del packed
        whole_a, whole_b, whole_c, entry = _triples(a, b, c, (len(first), len(middle), len(last)))
        del c
        n3 = np.bincount(entry, n, len(whole_a)).astype(np.int64)
        del n
        # Equal pairs (b, c) follow each other.
        new = np.ones(len(n3), bool)
        new[1:] = (whole_b[1:] != whole_b[:-1]) | (whole_c[1:] != whole_c[:-1])
        pair_of = np.cumsum(new, dtype=np.int32) - 1
        pair_b, pair_c = whole_b[new], whole_c[new]
        n2 = np.bincount(pair_of, n3, len(pair_b)).astype(np.int64)
        histories, of = _distinct(whole_b.astype(np.int64) * len(first) + whole_a)
        del whole_a, whole_b, whole_c, new
        live = n3 > 0
        arcs3 = np.bincount(of[live], minlength=len(histories))
        low3 = np.bincount(of[live], n2[pair_of[live]], len(histories)).astype(np.int64)
        live = n2 > 0
        arcs2 = np.bincount(pair_b[live], minlength=len(middle))
        low2 = np.bincount(pair_b[live], seen[pair_c[live]], len(middle)).astype(np.int64)
        del pair_b, pair_c
        found = []
        for values, index in ((n3, entry), (n2, pair_of[entry]), (arcs3, of[entry]), (low3, of[entry]), (arcs2, b), (low2, b)):
            found.append([pack(values[own]) for own in np.split(index, ends)])
        data = [list(d) for d in zip(*found)]
        of_b = histories // len(first)
        parts = np.flatnonzero((spread[of_b] > 1) & (arcs3 > 0))
        mids = np.flatnonzero((spread > 1) & (arcs2 > 0))
        of_a = np.concatenate([first[histories[parts] % len(first)] + 1, np.zeros(len(mids), np.int64)])
        of_b = middle[np.concatenate([of_b[parts], mids])]
        arcs, low = (np.concatenate([x[parts], y[mids]]) for x, y in ((arcs3, arcs2), (low3, low2)))
        order, bounds = _dealt(of_a, of_b, sizes.shards)
        shards = np.flatnonzero(np.diff(bounds)).tolist()
        kinds = [GRAMS] * len(data) + [PARTS] * len(shards)
        for shard in shards:
            own = order[bounds[shard]:bounds[shard + 1]]
            data.append([pack(np.diff(of_b[own], prepend=0)), pack(of_a[own]), pack(arcs[own]), pack(low[own])])
        made = _sent(rows.column("block").to_pylist() + [None] * len(shards), rows.column("shard").to_pylist() + shards, data)
        return pa.concat_tables([pa.table([*made, _kinds(kinds)], names=["block", "shard", "data", "kind"]).cast(asked.schema), asked])

    offered = blocks.select("block", "hashes", "train", "sizes", "codes").groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(
        lambda block, known: group_returned(offer, block, known), PACKED).repartition(sizes.shards, "shard")
    return written(offered.groupBy("shard").applyInArrow(lambda rows: group_returned(add, rows), PACKED), "grams")


def history_numbers(numbers: DataFrame, sizes: Sizes) -> DataFrame:
    """For every block and shard of histories the numbers of the spread histories that the block asked for: sums over their parts."""

    def add(rows: pa.Table) -> pa.Table:
        packed, blocks = rows.column("data").to_pylist(), rows.column("block").to_pylist()
        is_part = [len(d) == 4 for d in packed]
        middle, b = _dense(np.concatenate([np.cumsum(unpack(d[0])) for d in packed]))
        of_a = [unpack(d[1]) for d in packed]
        lengths = [len(x) for x in of_a]
        first, a = _dense(np.concatenate(of_a))
        whole, at = _distinct(b.astype(np.int64) * len(first) + a)
        from_parts = at[np.repeat(is_part, lengths)]
        totals = []
        for k in (2, 3):
            values = [unpack(d[k]) for d, part in zip(packed, is_part) if part]
            totals.append(np.bincount(from_parts, np.concatenate([np.zeros(0, np.int64), *values]), len(whole)).astype(np.int64))
        asked = [(block, own) for block, part, own in zip(blocks, is_part, np.split(at, np.cumsum(lengths)[:-1])) if not part]
        data = [[pack(x[own]) for x in totals] for _, own in asked]
        shards = [rows.column("shard")[0].as_py()] * len(asked)
        return pa.table([*_sent([block for block, _ in asked], shards, data), _kinds([HISTORIES] * len(asked))], names=["block", "shard", "data", "kind"])

    return numbers.where(F.col("kind") != GRAMS).repartition(sizes.shards, "shard").groupBy("shard").applyInArrow(lambda rows: group_returned(add, rows), PACKED)


def _answers(counts: DataFrame, numbers: DataFrame, sizes: Sizes) -> DataFrame:
    """All that is sent to the blocks."""
    return counts.unionByName(numbers.where(F.col("kind") == GRAMS)).unionByName(history_numbers(numbers, sizes))


def log_unigram(c: np.ndarray, tokens: int, distinct: int) -> np.ndarray:
    return np.log10((c + ADDED) / (tokens + ADDED * (distinct + 1)))


def _failure(left: np.ndarray, open_: np.ndarray, arcs: np.ndarray) -> np.ndarray:
    """Weight of a failure arc: what the arcs leave, over what the shorter history has beside them."""
    ok = (arcs > 0) & (left > 1e-12) & (open_ > 1e-12)
    return np.where(ok, np.log10(np.where(ok, left, 1.0) / np.where(ok, open_, 1.0)), 0.0)


def _arc(n: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """log10 of the weight of an arc that was seen `n` times."""
    return np.log10((np.maximum(n, 1) - DISCOUNT) / seen)


def score(blocks: DataFrame, order: int) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every document of the blocks."""
    sizes = Sizes.of(blocks)
    counts = word_counts(blocks, sizes)
    distinct = int(counts.agg(F.sum("words")).first()[0] or 0)
    heads = blocks.select("block", "hashes", "ids", "train", "sizes", "codes")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    known = counts.select("block", "shard", "data", F.lit(WORDS).cast("tinyint").alias("kind"))
    numbers = gram_numbers(blocks, known, sizes)
    root = sizes.tokens + ADDED * (distinct + 1)

    def walk(block: _Block, told: dict[int, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each token alone and after its history, and whether it is known: the arc of the longest
        history that has it, and the failure weights on the way down to it."""
        found = np.zeros((6, len(block.a)), np.int64)
        for shard, data in told[GRAMS]:
            for k in range(6):
                found[k, block.bounds[shard]:block.bounds[shard + 1]] = unpack(data[k])
        block.histories(sizes)
        for k in range(2):
            spread = np.zeros(len(block.asked_a), np.int64)
            for shard, data in told[HISTORIES]:
                spread[block.asked_bounds[shard]:block.asked_bounds[shard + 1]] = unpack(data[k])
            found[2 + k, block.far], found[4 + k, block.far] = spread[block.pair_at], spread[block.word_at]
        each = []
        for at in range(0, len(block.entry), TOKENS_AT_ONCE):
            entry = block.entry[at:at + TOKENS_AT_ONCE]
            n3, n2, arcs3, low3, arcs2, low2 = found[:, entry]
            last, before = block.seen[block.c[entry]], block.seen[block.b[entry]]
            once = np.maximum(before, 1)  # where a history was not seen, it has no arcs and the value does not matter
            unigram = log_unigram(last, sizes.tokens, distinct)
            fail = _failure(DISCOUNT * arcs2 / once, 1 - (low2 + ADDED * arcs2) / root, arcs2)
            best = np.where(n2 > 0, _arc(n2, once), fail + unigram)
            if order > 2:
                # The state by which a token is read is the pair that ended at the token before.
                pair = np.maximum(found[1, block.entry[np.maximum(np.arange(at, at + len(entry)) - 1, 0)]], 1)
                fail = _failure(DISCOUNT * arcs3 / pair, 1 - (low3 - DISCOUNT * arcs3) / once, arcs3)
                best = np.where(block.starts[at:at + len(entry)], best, np.where(n3 > 0, _arc(n3, pair), fail + best))
            each.append((unigram, best, last > 0))
        return tuple(np.concatenate(x) for x in zip(*each))

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows, answers = rows.combine_chunks(), answers.combine_chunks()
        block, told = _Block(rows), _split(answers)
        block.take_counts(told[WORDS], sizes)
        block.grams(sizes)
        unigram, each, seen = walk(block, told)
        owner = np.repeat(np.arange(len(block.sizes)), block.sizes)
        total = len(block.sizes)
        return pa.table({
            "doc_id": rows.column("ids")[0].values, "n_tokens": pa.array(block.sizes),
            "n_known": pa.array(np.bincount(owner, seen, total).astype(np.int64)),
            "train_tokens": pa.array(np.full(total, sizes.tokens, np.int64)),
            "base_score": pa.array(np.bincount(owner, unigram, total)),
            "score": pa.array(np.bincount(owner, each, total))})

    schema = f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return heads.groupBy("block").cogroup(_answers(known, numbers, sizes).groupBy("block")).applyInArrow(
        lambda rows, answers: group_returned(run, rows, answers), schema)


def score_documents(docs: DataFrame, train_on: Column, text: str = "text", id_col: str = "doc_id", order: int = 3) -> DataFrame:
    """Scores every row of `docs` by a model of the rows where `train_on` holds; `order` is 2 or 3.

    Tokens are runs without ASCII white space, A-Z in lower case, and an end. A null text is empty: one token. Rows
    are scored one by one, repeated ones alike, and a null id stays null. Without training rows every token is unknown, at
    a probability of 1. Other columns are not looked at.
    """
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    return score(blocks_of(docs, train_on, text, id_col), order)
