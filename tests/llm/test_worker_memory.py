"""What a Python worker needs at once, and what is sent to it."""

import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa

from gatewaylens.llm import common, language_id


def _model(kinds: int) -> language_id.LanguageModel:
    rng = np.random.default_rng(1)
    log_p = np.log(rng.dirichlet(np.ones(language_id.BINS), kinds).T + 1e-12).astype(np.float32)
    return language_id.LanguageModel(tuple("abcdefgh"[:kinds]), log_p)


def test_mixtures_take_memory_by_the_run_of_texts_and_do_not_depend_on_it(monkeypatch):
    rng = np.random.default_rng(2)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(400)]
    texts = [" ".join(words[w] for w in rng.integers(0, len(words), 50)) for _ in range(8000)]
    texts[3:6] = [None, "", "one"]
    model, found, peaks = _model(4), [], []
    for at_once in (1 << 40, 20_000):
        monkeypatch.setattr(language_id, "TOKENS_AT_ONCE", at_once)
        tracemalloc.start()
        found.append(language_id._infer(pa.array(texts, pa.string()), model, language_id.ROUNDS, language_id.PENALTY))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert all(np.array_equal(x, y) for x, y in zip(*found))
    assert peaks[1] < 0.5 * peaks[0]


def test_a_text_that_passes_through_is_sent_to_the_worker_once(spark):
    docs = spark.createDataFrame([(1, "one two", "x"), (2, None, "y")], "doc_id long, text string, lang string")
    kept = language_id.identify(docs, _model(2))
    assert kept.columns == ["doc_id", "text", "lang", "lang_pred", "score", "languages"]
    assert [(r["doc_id"], r["text"], r["lang"]) for r in kept.orderBy("doc_id").collect()] == [(1, "one two", "x"), (2, None, "y")]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "__text_" not in plan
    alone = language_id.identify(docs, _model(2), keep=["doc_id"])
    assert alone.columns == ["doc_id", "lang_pred", "score", "languages"] and "__text_" in alone._jdf.queryExecution().optimizedPlan().toString()


def test_memory_that_is_not_used_any_more_goes_back_to_the_system():
    def used() -> float:
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6

    def filled(batches):
        for batch in batches:
            small = [np.ones(2000) for _ in range(6000)]  # 96 MB in pieces, of which one at the end stays
            held.append(small[-1])
            del small
            yield batch

    common.return_memory()
    held, before = [], used()
    assert list(common.memory_returned(filled)([1, 2])) == [1, 2]
    assert used() < before + 40
    assert common.group_returned(lambda x, y: x + y, 1, 2) == 3
