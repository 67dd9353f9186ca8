"""Ranked lexical search by a dual-tree: a hierarchy over items meets a hierarchy over documents.

A document is a vector of impacts (how much one occurrence pattern of a term is worth in it), an item one of term weights;
a score is their product, in whole numbers. Every node of either tree holds the largest coordinates below it, so the product of two
nodes is a bound for all pairs below them. Pairs of nodes are opened from the highest bound down; a pair whose bound is
under the weakest k-th score of its items is left out with everything below it. Nothing that could be in a result is: bounds
are exact, and pairs at the k-th score itself are still opened.

Two passes over the corpus: the first cuts texts into terms once and writes what meets the items' words, with the counts that
weights need (over all documents). The second builds trees of a bounded number of documents in each task. A round over a sixteenth of
the documents comes before it and gives each item a score that its k-th has to reach; that only saves work.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gatewaylens.llm.common import slices
from gatewaylens.session import written

PASS_BYTES = 2 << 20  # texts of items that one pass over the documents takes
TREE_ITEMS = 256  # items in one tree
TREE_DOCS = 4096  # documents in one tree
TREE_TERMS = 1 << 21  # and their terms
ITEM_LEAF, DOC_LEAF, FAN = 8, 16, 8
SEED = 16  # the first round reads one document in so many
EXACT = 1 << 53  # whole numbers up to here are exact in a double
LAST = np.iinfo(np.int64).max  # stands for a document without an id: after all others

# What ends a term, and the capital letters.
_GAP = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(0x20 if b in _GAP else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of letters, digits and everything beyond ASCII; only A-Z become lower case."""
    return text.translate(_TABLE).split()


@dataclass
class Corpus:
    documents: int  # with at least one term
    terms: int  # of all documents, with repeats


def _features(docs: DataFrame, id_col: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc, n, terms, tf) per document with terms: all its terms counted, those of the vocabulary listed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            for part in slices(batch, "text"):
                ids, sizes, found, times = [], [], [], []
                for doc, raw in zip(part.column("doc").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                    words = terms_of(raw) if raw else []
                    if not words:
                        continue
                    known = np.array([i for i in map(get, words) if i is not None], np.int32)
                    terms, tf = np.unique(known, return_counts=True)
                    ids.append(doc)
                    sizes.append(len(words))
                    found.append(terms.tobytes())
                    times.append(tf.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary()), pa.array(times, pa.binary())],
                    names=["doc", "n", "terms", "tf"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text).alias("text"))
    return written(rows.mapInArrow(run, "doc long, n long, terms binary, tf binary"), "features")


def _document_counts(features: DataFrame, words: int) -> np.ndarray:
    """In how many documents each word of the vocabulary is; one row per word and task is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(words, np.int64)
        for batch in batches:
            for raw in batch.column("terms").to_pylist():
                counts[np.frombuffer(raw, np.int32)] += 1
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], names=["term", "df"])

    summed = features.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    total = np.zeros(words, np.int64)
    for row in summed.collect():  # at most the words of one pass
        total[row["term"]] = row["df"]
    return total


def _weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class _Tree:
    """Rows in leaves of equal size under nodes of `FAN` children; every node holds the maxima of its rows' coordinates."""

    def __init__(self, maxima: np.ndarray, rows: int, leaf: int):
        self.levels, self.rows, self.leaf = [maxima], rows, leaf  # from the leaves up
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            starts = np.arange(0, len(below), FAN)
            self.levels.append(np.maximum.reduceat(below, starts, axis=0))

    def children(self, level: int, node: int) -> range:
        return range(node * FAN, min((node + 1) * FAN, len(self.levels[level - 1])))

    def members(self, node: int) -> slice:
        return slice(node * self.leaf, min((node + 1) * self.leaf, self.rows))


class _Items:
    """A tree over up to TREE_ITEMS items, in an order that puts items of a kind side by side."""

    def __init__(self, numbers: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], known: dict[int, int]):
        kind = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
        order = sorted(range(len(numbers)), key=lambda i: kind[i])
        self.numbers = [numbers[i] for i in order]
        self.columns = np.unique(np.concatenate([t for t, _ in vectors] or [np.empty(0, np.int64)]))
        largest = max((int(w.sum()) for _, w in vectors), default=0)
        # Impacts are at most a million; a node's bound adds up at most the maxima of all columns.
        dense = np.zeros((len(order), len(self.columns)), np.int64)
        for row, i in enumerate(order):
            dense[row, np.searchsorted(self.columns, vectors[i][0])] = vectors[i][1]
        self.kind = np.float64 if max(largest, int(dense.max(axis=0, initial=0).sum())) * 1_000_000 < EXACT else np.int64
        self.weights = dense.astype(self.kind)
        starts = np.arange(0, len(order), ITEM_LEAF)
        self.tree = _Tree(np.maximum.reduceat(self.weights, starts, axis=0), len(order), ITEM_LEAF)
        self.least = np.array([known[n] for n in self.numbers], np.int64)  # the k-th score is at least this


class _Best:
    """The best k documents so far of each item of a tree, and the weakest k-th score per node."""

    def __init__(self, items: _Items, k: int):
        self.items, self.k = items, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in items.numbers]  # (score, -doc), a heap with the weakest in front
        self.weakest = [np.minimum.reduceat(items.least, np.arange(0, len(items.least), ITEM_LEAF))]
        while len(self.weakest[-1]) > 1:
            self.weakest.append(np.minimum.reduceat(self.weakest[-1], np.arange(0, len(self.weakest[-1]), FAN)))
        self.least = items.least.copy()

    def add(self, node: int, scores: np.ndarray, docs: np.ndarray) -> None:
        """Scores of all documents of a leaf (columns) for all items of a leaf (rows)."""
        members = self.items.tree.members(node)
        for row, item in enumerate(range(members.start, members.stop)):
            line, heap = scores[row], self.found[item]
            for at in np.flatnonzero((line >= self.least[item]) & (line > 0)).tolist():
                entry = (int(line[at]), -int(docs[at]))
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[item] = max(self.least[item], heap[0][0])
        self.weakest[0][node] = self.least[members].min()
        for level in range(1, len(self.weakest)):
            node //= FAN
            below = self.weakest[level - 1]
            self.weakest[level][node] = below[node * FAN:(node + 1) * FAN].min()


def _impacts(n: np.ndarray, counts: np.ndarray, tf: np.ndarray, corpus: Corpus) -> np.ndarray:
    m = 25 + (75 * n * corpus.documents) // corpus.terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, counts))


def _search(best: _Best, docs: np.ndarray, owner: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
    """Adds to `best` what a tree of documents has for a tree of items. `owner` is the row of `docs` of each term."""
    items = best.items
    column = np.searchsorted(items.columns, term)
    met = np.flatnonzero(items.columns[np.minimum(column, len(items.columns) - 1)] == term) if len(items.columns) else []
    if not len(met):
        return
    owner, column, impact = owner[met], column[met], impact[met].astype(items.kind)
    # Documents that share their weightiest term lie side by side; those without any term of the items are left out.
    worth = impact * items.tree.levels[-1][0][column]
    by = np.lexsort((-worth, owner))
    first = by[np.flatnonzero(np.diff(owner[by], prepend=-1))]
    order = np.argsort(column[first], kind="stable")
    place = np.full(len(docs), -1)
    place[owner[first][order]] = np.arange(len(first))
    row = place[owner]
    sort = np.argsort(row, kind="stable")
    row, column, impact = row[sort], column[sort], impact[sort]
    ids = docs[owner[first][order]]
    leaves = -(-len(ids) // DOC_LEAF)
    maxima = np.zeros((leaves, len(items.columns)), items.kind)
    np.maximum.at(maxima, (row // DOC_LEAF, column), impact)
    tree = _Tree(maxima, len(ids), DOC_LEAF)
    begins = np.searchsorted(row, np.arange(0, leaves * DOC_LEAF + 1, DOC_LEAF))
    top, high = len(items.tree.levels) - 1, len(tree.levels) - 1
    bound = float((items.tree.levels[top][0] * tree.levels[high][0]).sum())
    queue = [(-bound, top, 0, high, 0)]
    while queue:
        bound, i_level, i_node, d_level, d_node = heapq.heappop(queue)
        if -bound < best.weakest[i_level][i_node] or not bound:
            continue
        if i_level == d_level == 0:
            part = slice(begins[d_node], begins[d_node + 1])
            here, at = np.unique(column[part], return_inverse=True)
            members = tree.members(d_node)
            dense = np.zeros((members.stop - members.start, len(here)), items.kind)
            dense[row[part] - members.start, at] = impact[part]
            scores = items.weights[items.tree.members(i_node)][:, here] @ dense.T
            best.add(i_node, scores, ids[members])
            continue
        i_next = items.tree.children(i_level, i_node) if i_level else range(i_node, i_node + 1)
        d_next = tree.children(d_level, d_node) if d_level else range(d_node, d_node + 1)
        i_below, d_below = max(i_level - 1, 0), max(d_level - 1, 0)
        bounds = items.tree.levels[i_below][i_next.start:i_next.stop] @ tree.levels[d_below][d_next.start:d_next.stop].T
        for i, line in zip(i_next, bounds):
            weakest = best.weakest[i_below][i]
            for d, value in zip(d_next, line.tolist()):
                if value >= weakest and value > 0:
                    heapq.heappush(queue, (-value, i_below, i, d_below, d))


def _ranked(features: DataFrame, items: list[_Items], corpus: Corpus, k: int, thresholds: dict[int, int]) -> DataFrame:
    """(item, doc, score): the k best of every task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests = []
        for block in items:
            block.least = np.array([thresholds.get(n, 0) for n in block.numbers], np.int64)
            bests.append(_Best(block, k))
        for docs, owner, term, impact in _trees(batches, corpus):
            for best in bests:
                _search(best, docs, owner, term, impact)
        rows = [(number, -doc, score) for best in bests for number, heap in zip(best.items.numbers, best.found) for score, doc in heap]
        if rows:
            item, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc", "score"])

    found = features.mapInArrow(run, "item long, doc long, score long")
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc"))
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def _trees(batches: Iterator[pa.RecordBatch], corpus: Corpus):
    """Runs of documents for one tree each."""
    held: list[pa.RecordBatch] = []
    count = size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            held.append(part)
            count += part.num_rows
            size += (pc.sum(pc.binary_length(part.column("terms"))).as_py() or 0) // 4
            if count >= TREE_DOCS or size >= TREE_TERMS:
                yield _arrays(held, corpus)
                held, count, size = [], 0, 0
    if held:
        yield _arrays(held, corpus)


def _arrays(held: list[pa.RecordBatch], corpus: Corpus):
    table = pa.Table.from_batches(held).combine_chunks()
    docs = pc.fill_null(table.column("doc"), LAST).to_numpy()
    n = table.column("n").to_numpy()
    counts = pc.binary_length(table.column("terms")).to_numpy().astype(np.int64) // 4
    term, tf = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int32).astype(np.int64) for c in ("terms", "tf"))
    return docs, np.repeat(np.arange(len(docs)), counts), term, _impacts(n, counts, tf, corpus)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text: str = "text",
                   item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(`item_col`, rank, `id_col`, score): each item's k highest-scoring documents with a score above 0, equal scores by smaller id.

    Ids of documents are whole numbers; one without an id comes after its equals. A null or empty text has no terms: such an item
    has no rows and such a document none either. Rows of items that repeat id and text count once; an id with several texts has a
    list for each of them. Documents that repeat an id are ranked each for itself. Other columns are not read. Items are taken in
    passes of about PASS_BYTES of text, so what is sent to the tasks is bounded however many there are.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item_key"), F.col(item_text).alias("text")).where("text IS NOT NULL").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // PASS_BYTES)
    kind = items.schema[item_col].dataType
    id_kind = docs.schema[id_col].dataType
    result = None
    for number in range(passes):
        mine = asked.where(F.pmod(F.xxhash64("item_key", "text"), F.lit(passes)) == number).collect()
        found = _one_pass(docs, [(r["item_key"], r["text"]) for r in mine], k, id_col, text, kind, item_col)
        result = found if result is None else result.unionByName(found)
    if result is None:
        result = spark.createDataFrame([], StructType([StructField(item_col, kind)])).select(
            item_col, F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc"), F.lit(0).cast("bigint").alias("score"))
    doc = F.when(F.col("doc") != F.lit(int(LAST)), F.col("doc")).cast(id_kind)
    return result.select(item_col, F.col("rank").cast("int").alias("rank"), doc.alias(id_col), "score")


def _one_pass(docs: DataFrame, mine: list[tuple], k: int, id_col: str, text: str, kind, item_col: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    counts = []
    for _, body in mine:
        numbers = [vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(body.encode())]
        counts.append(np.unique(np.array(numbers, np.int64), return_counts=True))
    features = _features(docs, id_col, text, vocabulary)
    total = features.agg(F.count("*"), F.sum("n")).first()
    corpus = Corpus(total[0], total[1] or 1)
    weight = np.array([_weight(int(df), corpus.documents) for df in _document_counts(features, len(vocabulary))], np.int64)
    vectors = [(terms, times * weight[terms]) for terms, times in counts]
    # Items whose weightiest words are the same go into one tree.
    order = sorted(range(len(mine)), key=lambda i: int(vectors[i][0][np.argmax(vectors[i][1])]) if len(vectors[i][0]) else -1)
    trees = [_Items(part, [vectors[i] for i in part], dict.fromkeys(part, 0))
             for part in (order[at:at + TREE_ITEMS] for at in range(0, len(order), TREE_ITEMS))]
    first = _ranked(features.where(F.pmod(F.xxhash64("doc", "n"), F.lit(SEED)) == 0), trees, corpus, k, {})
    reached = {r["item"]: r["score"] for r in first.where(F.col("rank") == k).select("item", "score").collect()}
    ranked = _ranked(features, trees, corpus, k, reached)
    keys = spark.createDataFrame([(number, key) for number, (key, _) in enumerate(mine)], StructType(
        [StructField("item", ranked.schema["item"].dataType), StructField(item_col, kind)]))
    return ranked.join(keys, "item").select(item_col, "rank", "doc", "score")
