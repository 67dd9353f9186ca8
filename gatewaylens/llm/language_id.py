"""Language identification as mixture inference.

A word's likelihood under a language is that of its character n-grams. A document is a mixture: each word
comes from one language, and expectation-maximisation estimates in which proportions. The set of languages
is the one with the best penalised likelihood: another language must pay for itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from gatewaylens.llm.common import fresh_name, memory_returned, remainder, slices

ORDERS = (2, 3, 4)  # bytes per n-gram; a blank stands before and after each word
BINS = 1 << 16  # n-grams are counted by a hash of this many values, so a language's model has a fixed size
SMOOTHING = 0.5
ROUNDS = 6
PENALTY = 6.0  # log-likelihood that each further language must bring, times log(1 + words)
LETTER = r"\pL"
TOKENS_AT_ONCE = 100_000  # of a slice, in the mixtures


@dataclass(frozen=True)
class LanguageModel:
    """log_p[bin, language]: bounded by the number of labels times BINS, whatever the size of the corpus."""

    languages: tuple[str, ...]
    log_p: np.ndarray


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """Hashed n-grams starting at each byte."""
    size = max(0, len(data) - order + 1)
    code = np.full(size, order, np.uint32)
    for at in range(order):
        code = code * np.uint32(0x01000193) ^ data[at:at + size]
    code *= np.uint32(0x9E3779B1)
    return (code >> np.uint32(16)).astype(np.int64)


def _word_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words with a blank before and after each, and where each word's stretch begins."""
    joined = b" " + b" ".join(w.encode() for w in words.to_pylist()) + b" "
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return np.frombuffer(joined, np.uint8), np.cumsum(sizes) - sizes


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the word number of each token, and the row of each token."""
    parts = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    rows = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(parts).dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) == 0
    real = ~blank[numbers] if len(numbers) else np.zeros(0, bool)
    return coded.dictionary, numbers[real], rows[real].astype(np.int64)


def _gram_counts(words: pa.Array, times: np.ndarray) -> np.ndarray:
    data, starts = _word_bytes(words)
    owner = np.zeros(len(data), np.int64)
    owner[starts[1:]] = 1
    owner = np.cumsum(owner)
    total = np.zeros(BINS, np.int64)
    for order in ORDERS:
        grams = _grams(data, order)
        total += np.bincount(grams, times[owner[: len(grams)]], BINS).astype(np.int64)
    return total


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """N-gram counts of all labelled documents; rows with a null text or label teach nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "t"):
                words, numbers, rows = _split(part.column("t"))
                labels = part.column("l").dictionary_encode()
                label = labels.indices.to_numpy(zero_copy_only=False).astype(np.int64)[rows]
                for n, name in enumerate(labels.dictionary.to_pylist()):
                    times = np.bincount(numbers[label == n], minlength=len(words))
                    if times.any():
                        used = np.flatnonzero(times)
                        totals[name] = totals.get(name, 0) + _gram_counts(words.take(pa.array(used)), times[used])
        for name, counts in totals.items():
            bins = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({
                "l": pa.array([name] * len(bins)), "bin": pa.array(bins), "n": pa.array(counts[bins])})

    picked = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    counted = picked.mapInArrow(memory_returned(run), "l string, bin bigint, n bigint").groupBy("l", "bin").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    names = tuple(sorted(set(table.column("l").to_pylist())))
    counts = np.zeros((BINS, len(names)))
    column = {name: n for n, name in enumerate(names)}
    at = np.array([column[x] for x in table.column("l").to_pylist()], np.int64)
    counts[table.column("bin").to_numpy(), at] = table.column("n").to_numpy()
    smooth = counts + SMOOTHING
    return LanguageModel(names, np.log(smooth / smooth.sum(axis=0, keepdims=True)).astype(np.float32))


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents to learn from: those whose crc32 of the id is not 0 modulo 5."""
    return docs.where(remainder(F.col(id_col), 5) != 0)


def _word_scores(words: pa.Array, log_p: np.ndarray) -> np.ndarray:
    """Log-likelihood of each distinct word under each language, as the mean over n-gram orders."""
    data, starts = _word_bytes(words)
    size = len(data)
    scores = np.zeros((len(words), log_p.shape[1]), np.float32)
    begin = np.zeros(size, np.int8)
    begin[starts[1:]] = 1
    owner = np.cumsum(begin, dtype=np.int64)
    for order in ORDERS:
        grams = _grams(data, order)
        for k in range(log_p.shape[1]):
            scores[:, k] += np.bincount(owner[: len(grams)], log_p[:, k][grams], len(words)).astype(np.float32)
    return scores / len(ORDERS)


def _mixture(word_p: np.ndarray, rows: np.ndarray, docs: int, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions per document and the log-likelihood of its words, given the languages each may use."""
    shares = allowed / allowed.sum(axis=1, keepdims=True)
    sizes = np.maximum(np.bincount(rows, minlength=docs), 1)[:, None]
    for _ in range(rounds):
        each = shares[rows] * word_p
        each /= np.maximum(each.sum(axis=1, keepdims=True), 1e-300)
        shares = np.stack([np.bincount(rows, each[:, k], docs) for k in range(word_p.shape[1])], axis=1) / sizes
    fit = np.log(np.maximum((shares[rows] * word_p).sum(axis=1), 1e-300))
    return shares, np.bincount(rows, fit, docs)


def _infer(texts: pa.Array, model: LanguageModel, rounds: int, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: proportions over the selected languages, number of them, number of words."""
    words, numbers, rows = _split(texts)
    size = np.bincount(rows, minlength=len(texts))
    scores = _word_scores(words, model.log_p).astype(np.float64)
    word_p = np.maximum(np.exp(scores - scores.max(axis=1, keepdims=True)), 1e-30)
    # A text's mixture depends on its own words only: texts go in runs, so that memory follows the run.
    ends = np.cumsum(size)
    cuts = np.flatnonzero(np.diff((ends - size) // TOKENS_AT_ONCE)) + 1
    found = []
    for start, stop in zip([0, *cuts], [*cuts, len(texts)]):
        own = slice(ends[start] - size[start], ends[stop - 1]) if stop else slice(0, 0)
        found.append(_mixtures(word_p[numbers[own]], rows[own] - start, size[start:stop], rounds, penalty))
    shares, number = (np.concatenate(x) for x in zip(*found))
    return shares, number, size


def _mixtures(
    word_p: np.ndarray, rows: np.ndarray, size: np.ndarray, rounds: int, penalty: float
) -> tuple[np.ndarray, np.ndarray]:
    """Of a run of texts: proportions and number of languages, from each token's likelihoods and text."""
    docs, kinds = len(size), word_p.shape[1]
    # One language: its summed log-likelihood. More: the languages in order of their share in the full mixture.
    alone = np.stack([np.bincount(rows, np.log(word_p[:, k]), docs) for k in range(kinds)], axis=1)
    full, _ = _mixture(word_p, rows, docs, np.ones((docs, kinds)), rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    best = alone.argmax(axis=1)
    chosen = np.zeros((docs, kinds))
    chosen[np.arange(docs), best] = 1
    shares, number, reached = chosen.copy(), np.ones(docs, np.int64), alone.max(axis=1)
    open_ = np.flatnonzero((size > 1) & (kinds > 1))
    for count in range(2, kinds + 1):
        if not len(open_):
            break
        allowed = np.zeros((docs, kinds))
        for place in range(count):
            allowed[open_, order[open_, place]] = 1
        member = np.zeros(docs, bool)
        member[open_] = True
        picked = member[rows]
        place = np.cumsum(member) - 1
        own, fit = _mixture(word_p[picked], place[rows[picked]], len(open_), allowed[open_], rounds)
        better = fit - penalty * np.log1p(size[open_]) > reached[open_]
        taken = open_[better]
        shares[taken], number[taken] = own[better], count
        reached[taken] = fit[better] - 0.0
        open_ = taken
    return shares, number


def identify(
    docs: DataFrame, model: LanguageModel, text: str = "text", rounds: int = ROUNDS, penalty: float = PENALTY,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """`docs` with lang_pred, score (share of the words in that language) and languages (how many were selected).

    A text that is null or has no letter, and any text under a model without languages, is `und` with score 0
    and no languages. Ties go to the language whose label sorts first. Whole texts are used. All other columns pass
    through, or those named in `keep`; a column that has the name of a result is replaced by it.
    """
    names = ["lang_pred", "score", "languages"]
    kept = [f for f in docs.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    schema = StructType([*kept, *(StructField(n, t) for n, t in zip(names, (StringType(), DoubleType(), IntegerType())))])

    # A text that passes through is sent once.
    read = text if "." not in text and any(f.name == text for f in kept) else fresh_name("text")
    sent = [F.col(f"`{f.name}`") for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, read):
                texts = part.column(read)
                usable = pc.fill_null(pc.match_substring_regex(texts, LETTER), False).to_numpy(zero_copy_only=False)
                if model.languages:
                    shares, number, size = _infer(texts, model, rounds, penalty)
                    usable &= size > 0
                    best = shares.argmax(axis=1)
                    label = [model.languages[b] if u else "und" for b, u in zip(best, usable)]
                    score = np.where(usable, shares.max(axis=1), 0.0)
                    number = np.where(usable, number, 0)
                else:
                    label, score, number = ["und"] * len(part), np.zeros(len(part)), np.zeros(len(part))
                made = [pa.array(label, pa.string()), pa.array(np.clip(score, 0.0, 1.0)), pa.array(number.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in kept), *made], names=[*(f.name for f in kept), *names])

    if read != text:
        sent.append(F.col(text).alias(read))
    return docs.select(*sent).mapInArrow(memory_returned(run), schema)


def accepted(lang: Column, score: Column, least: float) -> Column:
    """Whether a document has a language: not `und`, and at least `least` of its words in one language."""
    return (lang != "und") & (score >= least)
