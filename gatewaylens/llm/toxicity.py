"""Toxicity by a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios.

A feature is how often a text has an n-gram, per hundred words; n-grams of 3 to 5 characters are taken inside
words with a blank at either end and hashed into a table of fixed size. The log-count ratio of a feature compares its share
among all n-grams of the toxic texts with that of the others; it is counted over all labelled training texts, in Spark. The
logistic regression on the scaled features is fitted on a bounded sample of them. Since all of that is linear, a text's
score is a mean over its words, and a word is looked up once per worker as long as it is remembered.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gatewaylens.llm.common import fresh_name, remainder, slices, texts_of

BITS = 18  # the table has 2^18 features
ORDERS = (3, 4, 5)
SMOOTHING = 1.0
SAMPLE = 2000  # labelled training texts per class that the regression is fitted on, those with the smallest hash of the id
ROUNDS = 150
LEAST_RATIO = 0.25  # n-grams whose log-count ratio is nearer to zero have weight zero
PENALTY = 1e-4
KNOWN_BYTES = 16 << 20  # of words that a worker remembers

_WORDS = re.compile(r"\w+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: an odd multiplier that spreads bits


@dataclass
class Model:
    """What each hashed n-gram adds to the score of a text per hundred words, and what every text has."""

    weights: np.ndarray
    bias: float


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words in a row, and the word that each belongs to."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = "".join(f" {w} " for w in words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # characters up to the word's end
    found, owners = [], []
    ahead = np.concatenate([points, np.zeros(max(ORDERS), np.uint64)])
    rolling = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        rolling = (rolling + ahead[n - 1:n - 1 + len(points)]) * _MIX
        rolling ^= rolling >> np.uint64(29)
        if n in ORDERS:
            inside = left >= n
            found.append((rolling[inside] * _MIX) >> np.uint64(64 - BITS))
            owners.append(owner[inside])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners)


def words_of(text: str) -> list[str]:
    return _WORDS(text.lower())


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, learned: Column) -> DataFrame:
    """Training texts with their label; an id with several labels is toxic if one of them says so."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("doc")).agg(F.max(label).alias("toxic"))
    rows = docs.where(learned & F.col(text).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text).alias("text"))
    # Always by merging: labels grow with the corpus, and a plan that changes with their size could not be planned for.
    return rows.join(known.hint("merge"), "doc").select("doc", "text", (F.col("toxic") > 0).cast("long").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, learned: Column | None = None, id_col: str = "doc_id", text: str = "text",
          label: str = "toxic") -> Model | None:
    """Learns from the documents that `learned` (an expression over `docs`; all if None) allows and that have a label.

    Rows without an id, a text or a label teach nothing. None if there are not labelled texts of both kinds.
    """
    rows = _labelled(docs, labels, id_col, text, label, F.lit(True) if learned is None else learned)
    # Ids and labels alone say how large each class is and which hashes belong to the sample.
    ids = _labelled(docs.withColumn(text, F.when(F.col(text).isNotNull(), F.lit(""))), labels, id_col, text, label,
                    F.lit(True) if learned is None else learned)
    sizes = {r["toxic"]: r["n"] for r in ids.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    spread = F.pmod(F.xxhash64("doc"), F.lit(1 << 30))
    share = F.when(F.col("toxic") == 1, min(1.0, SAMPLE / sizes[1])).otherwise(min(1.0, SAMPLE / sizes[0]))
    marked = rows.select("text", "toxic", (spread < share * (1 << 30)).alias("chosen"))
    found = marked.mapInArrow(_count, "toxic long, feature int, n double, ids binary, rates binary")
    counted = found.groupBy("toxic", "feature", F.when(F.col("feature").isNull(), F.xxhash64("ids", "rates")).alias("text")).agg(
        F.sum("n").alias("n"), F.first("ids").alias("ids"), F.first("rates").alias("rates"))
    counts = np.full((2, 1 << BITS), SMOOTHING)
    texts, targets = [], []
    # At most two rows per feature of the table, and the sample.
    for batch in counted.toArrow().to_batches():
        plain = batch.filter(batch.column("feature").is_valid())
        counts[plain.column("toxic").to_numpy(), plain.column("feature").to_numpy()] += plain.column("n").to_numpy()
        sample = batch.filter(batch.column("feature").is_null())
        for toxic, times, ids, rates in zip(*(sample.column(c).to_pylist() for c in ("toxic", "n", "ids", "rates"))):
            texts.append((np.frombuffer(ids, np.int32), np.frombuffer(rates, np.float32)))
            targets.append((toxic, times))
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    toxic, times = np.array([t for t, _ in targets]), np.array([n for _, n in targets], float)
    for side in (0, 1):  # each class weighs what it weighs in all training texts
        times[toxic == side] *= sizes[side] / max(times[toxic == side].sum(), 1)
    beta, bias = _fit(texts, toxic.astype(float), times / times.sum(), ratio)
    return Model((beta * ratio).astype(np.float32), bias)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams per class over a partition, and the features of each chosen text."""
    counts = np.zeros((2, 1 << BITS))
    for batch in batches:
        for part in slices(batch, "text"):
            words: tuple[Counter, Counter] = (Counter(), Counter())
            texts = []
            for text, toxic, chosen in zip(texts_of(part, "text"), part.column("toxic").to_pylist(), part.column("chosen").to_pylist()):
                found = Counter(words_of(text))
                words[toxic].update(found)
                if chosen:
                    ids, owner = features_of(list(found))
                    rate = np.bincount(ids, np.fromiter(found.values(), float)[owner], 1 << BITS)
                    there = np.flatnonzero(rate)
                    texts.append((toxic, there.astype(np.int32).tobytes(), (rate[there] * (100 / max(found.total(), 1))).astype(np.float32).tobytes()))
            for side in (0, 1):
                ids, owner = features_of(list(words[side]))
                counts[side] += np.bincount(ids, np.fromiter(words[side].values(), float)[owner], 1 << BITS)
            if texts:
                toxic, ids, rates = zip(*texts)
                yield _counted(toxic, [None] * len(texts), [1.0] * len(texts), ids, rates)
    for side in (0, 1):
        there = np.flatnonzero(counts[side])
        if len(there):
            nothing = [None] * len(there)
            yield _counted([side] * len(there), there, counts[side][there], nothing, nothing)


def _counted(toxic, feature, n, ids, rates) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(toxic, pa.int64()), pa.array(feature, pa.int32()), pa.array(n, pa.float64()), pa.array(ids, pa.binary()), pa.array(rates, pa.binary())],
        names=["toxic", "feature", "n", "ids", "rates"])


def _fit(texts: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, share: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient steps of adapted size (Adam), from zero, with a quadratic penalty."""
    telling = np.abs(ratio) >= LEAST_RATIO
    texts = [(ids[telling[ids]], rates[telling[ids]]) for ids, rates in texts]
    sizes = np.array([len(ids) for ids, _ in texts])
    full = np.flatnonzero(sizes)
    ids = np.concatenate([texts[i][0] for i in full] or [np.empty(0, np.int32)])
    values = np.concatenate([texts[i][1] for i in full] or [np.empty(0, np.float32)]) * ratio[ids].astype(np.float32)
    used, column = np.unique(ids, return_inverse=True)
    starts = np.cumsum(sizes[full]) - sizes[full]
    row = np.repeat(full, sizes[full])
    odds = float((share * toxic).sum())
    beta, bias = np.zeros(len(used)), float(np.log(odds / (1 - odds)))
    moments = np.zeros((2, len(used) + 1))
    for step in range(1, ROUNDS + 1):
        logit = np.full(len(texts), bias)
        if len(full):
            logit[full] += np.add.reduceat(values * beta[column], starts)
        error = share * (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - toxic)
        slope = np.append(np.bincount(column, values * error[row], len(used)) + PENALTY * beta, error.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.99 * moments[1] + 0.01 * slope ** 2
        move = 0.05 * (moments[0] / (1 - 0.9 ** step)) / (np.sqrt(moments[1] / (1 - 0.99 ** step)) + 1e-9)
        beta, bias = beta - move[:-1], bias - float(move[-1])
    whole = np.zeros(len(ratio))
    whole[used] = beta
    return whole, bias


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """`docs` with the probability in `out` that the whole text is toxic.

    A null text counts as empty; a text without words gets what the model says without any feature. Without a model the score is 0.
    All other columns pass through, or those in `keep`; one that is called as `out` is replaced.
    """
    kept = [f for f in docs.schema.fields if f.name != out and (keep is None or f.name in keep)]
    read = fresh_name("text")
    schema = StructType([*kept, StructField(out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        size = 0
        for batch in batches:
            for part in slices(batch, read):
                lists = [words_of(t) for t in texts_of(part, read)]
                new = list(set().union(*lists) - known.keys()) if model else []
                if new:
                    if size > KNOWN_BYTES:
                        known, size = {}, 0
                        new = list(set().union(*lists))
                    ids, owner = features_of(new)
                    known.update(zip(new, np.bincount(owner, model.weights[ids], len(new)).tolist()))
                    size += sum(map(len, new)) + 100 * len(new)
                sums = np.array([sum(map(known.__getitem__, words)) if model else 0.0 for words in lists])
                counts = np.array([max(len(words), 1) for words in lists])
                scores = 1 / (1 + np.exp(-np.clip(model.bias + sums * 100 / counts, -60, 60))) if model else sums
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(scores, pa.float64())],
                                                 names=[*(f.name for f in kept), out])

    return docs.select(F.col(text).alias(read), *(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """The third of the documents that labels are never learned from."""
    return remainder(doc_id, 3) == 1
