"""Tokenizer, language ID, PII, language model and pipeline against definitions, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from gatewaylens.llm import language_id, lm_scoring, pii, sentencepiece_suffix, simhash_dedup
from gatewaylens.llm.common import read_table, remainder
from gatewaylens.llm.registered import TOKENIZER
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "  a  b ", "\n\nx\t y", "日本語", "a\0b", "<s> x </s>", "😀😀", "a" * 300, "    " * 20 + "x", "l'été — “q”",
       "\ufffe\ufffd e\u0301", "0000000011110000", "=" * 40, "İıſ", "long " * 20000, "x" * 20000, "same text", "same text"]


@pytest.fixture(scope="module")
def documents(spark):
    return read_table(spark, SF_DIR, "documents")


def test_ids_equal_the_tokenizers_own(spark, documents):
    import sentencepiece

    draw = random.Random(1)
    texts = ODD + ["".join(draw.choices("ab  \n<>=éüñ中0-_/.", k=draw.randint(1, 80))) for _ in range(300)]
    texts += [r["text"] for r in documents.collect()] + [r["html"] for r in read_table(spark, SF_DIR, "pages").limit(20).collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("a clash"))
    own = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    encoded = sentencepiece_suffix.encode(rows, TOKENIZER)
    decoded = sentencepiece_suffix.decode(encoded, TOKENIZER).collect()
    assert len(decoded) == len(texts)
    for r in decoded:
        text = texts[r["doc_id"]]
        assert r["ids"] == (None if text is None else own.encode(text)), repr(text)[:80]
        assert r["decoded"] == text
    assert sentencepiece_suffix.encode(rows.where("false"), TOKENIZER).count() == 0


def test_decoding_of_broken_bytes_and_marks():
    pieces = sentencepiece_suffix.load_pieces(TOKENIZER)
    raw = sentencepiece_suffix._raw_pieces(pieces)
    lone = int(pieces.byte_ids[0xFF])
    assert sentencepiece_suffix.decode_ids([lone], raw, True) == "\ufffd"
    values, ends = sentencepiece_suffix.encode_texts(["a\u2581b"], TOKENIZER)
    assert sentencepiece_suffix.decode_ids(values.tolist(), raw, True) == "a b"  # the mark of a blank is a blank


def test_suffix_ranges_equal_plain_search():
    draw = np.random.default_rng(2)
    codes = draw.integers(1, 4, 500)
    wanted = np.zeros((200, 40), np.int64)
    for row in wanted:
        size = draw.integers(1, 41)
        at = draw.integers(0, len(codes) - size)
        row[:size] = codes[at:at + size] if draw.random() < 0.8 else draw.integers(1, 4, size)
    order, low, high = sentencepiece_suffix.suffix_ranges(codes, wanted)
    for row, a, b in zip(wanted, low, high):
        own = row[row > 0]
        assert sorted(order[a:b].tolist()) == [n for n in range(len(codes)) if (codes[n:n + len(own)]).tolist() == own.tolist()]


def test_language_id_on_held_out_documents(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.train(language_id.training_rows(docs))
    rows = language_id.identify(docs, model).where(remainder(F.col("doc_id"), 5) == 0).collect()
    judged = [r for r in rows if r["lang"] is not None and re.search(r"[^\W\d_]", r["text"] or "")]
    assert sum(r["lang"] == r["lang_pred"] for r in judged) / len(judged) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_mixture_finds_both_languages(spark, documents):
    model = language_id.train(documents)
    texts = {k: " ".join(r["text"] for r in documents.where(F.col("lang") == k).limit(3).collect())[:3000] for k in ("en", "de", "fr")}
    rows = [(0, texts["en"]), (1, texts["en"] + " " + texts["de"][:1500]), (2, texts["fr"] + " " + texts["en"][:2900] + " " + texts["de"])]
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["languages"] for r in found] == [1, 2, 3]
    assert found[1]["lang_pred"] == "en" and 0.55 < found[1]["score"] < 0.8


def test_language_mixture_equals_plain_expectation_maximisation():
    draw = np.random.default_rng(3)
    word_p, rows = draw.random((60, 3)) + 0.01, np.sort(draw.integers(0, 5, 60))
    allowed = np.ones((5, 3))
    allowed[2, 1] = 0
    shares, fit = language_id._mixture(word_p, rows, 5, allowed, 4)
    for doc in range(5):
        own = word_p[rows == doc]
        share = allowed[doc] / allowed[doc].sum()
        for _ in range(4):
            r = own * share
            share = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        assert np.allclose(shares[doc], share) and math.isclose(fit[doc], np.log((own * share).sum(axis=1)).sum())


def test_language_id_of_odd_rows_and_without_labels(spark, documents):
    model = language_id.train(documents)
    rows = [(n, t, None, "s", 0) for n, t in enumerate(ODD + ["123 !!", None])] + [(None, "und das ist die", None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("a clash"))
    found = {(r["doc_id"], r["text"]): r for r in language_id.identify(docs, model).collect()}
    for (_, text), r in found.items():
        if not re.search(r"[^\W\d_]", text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in model.languages
    none = language_id.train(docs)
    assert none.languages == () and {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(docs.where("false"), model).count() == 0


# The base patterns as the contract words them, leftmost and non-overlapping.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_by_definition(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)

    def passes(number):
        return sum(int(d) if n % 2 == 0 else sum(map(int, str(2 * int(d)))) for n, d in enumerate(number[::-1])) % 10 == 0

    found = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), 2, m.end(), "card") for m in CARD.finditer(text) if 12 <= len(digits(m.group())) <= 19 and passes(digits(m.group()))]
    found += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return [(a, b, k) for a, _, b, k in sorted(found)]


def test_base_spans_equal_the_patterns(documents):
    draw = random.Random(4)
    texts = ["".join(draw.choices("a1.@-_+( )5é%", weights=[2, 5, 4, 3, 2, 1, 2, 1, 3, 1, 5, 1, 1], k=draw.randint(1, 60))) for _ in range(4000)]
    texts += ["4111 1111 1111 1111", "mail a.b@c.de.f_g@h.i", "1.2.3.4.5.6.7.8", "+49 (30) 123-4567 8", "00001.1.1.001 256.1.1.1", "1" * 5000]
    texts += [r["text"] or "" for r in documents.collect()]
    for text in texts:
        assert pii.base_spans(text) == base_by_definition(text), text[:200]


def test_added_spans_are_personal_and_clean_text_is_left_alone(spark):
    docs = read_table(spark, "/root/testdata/sf0.1", "documents")
    model = pii.train(docs)
    hidden = [("write to anna.k [at] mail3 [dot] example [dot] com now", "email"), ("the card 4111.1111.1111.1111 is mine", "card"),
              ("server 10.20[.]30[.]40 answers", "ip"), ("call (734) 555-2134 then", "phone")]
    clean = ["look at home. Then dot the i.", "in 2024-05-06 we sold 1,234,567 items", "version 1.2.3 of 12 and 300.400.500.600", "plain words"]
    rows = [(n, t) for n, t in enumerate([*(t for t, _ in hidden), *clean, "mail x@y.de twice x@y.de", None, ""])]
    found = {r["id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert sum([s["kind"] for s in found[n]] == [kind] for n, (_, kind) in enumerate(hidden)) >= 3
    assert all(found[n] == [] for n in range(len(hidden), len(hidden) + len(clean)))
    assert [(s["kind"], s["start"], s["end"], s["base"]) for s in found[8]] == [("email", 5, 11, True), ("email", 18, 24, True)]
    assert found[9] == found[10] == []
    masked = spark.createDataFrame([(8, rows[8][1])], "doc_id long, text string")
    joined = pii.find(masked, model).select(pii.redact(F.lit(rows[8][1]), F.col("spans")).alias("t")).first()["t"]
    assert joined == "mail ****** twice ******"


def test_pii_of_a_corpus_full_of_loose_personal_data(spark):
    """Loose phones and addresses outnumber the base spans: they are no examples of what is not personal."""
    draw = random.Random(13)

    def phone():
        return f"{draw.randint(200, 999)}", f"{draw.randint(200, 999)}", f"{draw.randint(1000, 9999)}"

    texts = [f"call +1 {a} {b} {c} now, mail {draw.choice('abcdef')}{a}@host{b}.org" for a, b, c in (phone() for _ in range(150))]
    loose = [f"call ({a}) {b}-{c} now, mail kim{a} [at] host{b} [dot] org" for a, b, c in (phone() for _ in range(900))]
    docs = spark.createDataFrame(list(enumerate(texts + loose)), "doc_id long, text string")
    found = pii.find(docs.where(f"doc_id >= {len(texts)}"), pii.train(docs)).collect()
    for kind in ("phone", "email"):
        assert sum(any(s["kind"] == kind for s in r["spans"]) for r in found) / len(found) > 0.9, kind


def test_pii_examples_of_a_rare_kind_beside_a_frequent_one(spark, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE", 20)
    texts = [f"mail a{n}@b{n}.org" for n in range(400)] + [f"host 10.0.0.{n} there" for n in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert Counter(kind for kind, *_ in pii._samples(docs, "text")) == {"email": 20, "ip": 20}


def test_pii_of_odd_rows_and_without_examples(spark):
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(ODD)] + [(None, "a@b.cd"), (1, "a@b.cd"), (1, "a@b.cd")], "doc_id long, text string")
    model = pii.train(rows.where("text NOT LIKE '%@%'"))
    assert model.trees is None
    found = pii.find(rows, model).collect()
    assert len(found) == len(ODD) + 3 and sum(len(r["spans"]) for r in found) == 3
    assert pii.find(rows.where("false"), model).count() == 0


def tokens_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w] + [""]


def scored_by_definition(train, texts, order):
    """A backoff model by its definition, walking from token to token."""
    counts = Counter(t for text in train for t in tokens_of(text))
    n, v = sum(counts.values()), len(counts)
    uni = lambda w: (counts[w] + 0.1) / (n + 0.1 * (v + 1))
    states = {w for w, c in counts.items() if c * 2 ** 16 >= n}
    grams = [Counter() for _ in range(order + 1)]
    for text in train:
        tokens = [None, *tokens_of(text)]
        for k in range(2, order + 1):
            for at in range(k - 1, len(tokens)):
                grams[k][tuple(tokens[at - k + 1:at + 1])] += 1
    kept = {}
    for k in range(2, order + 1):
        kept |= {g: c for g, c in grams[k].items() if c * 2 ** 20 >= n and all(w is None or w in states for w in g)
                 and (k == 2 or g[:-1] in kept)}
    starts = len(train)
    seen = lambda g: (starts if g == (None,) else counts[g[0]]) if len(g) == 1 else grams[len(g)][g]

    def p(history, w):
        if not history:
            return uni(w)
        if (*history, w) in kept:
            return (kept[(*history, w)] - 0.75) / seen(history)
        return weight(history) * p(history[1:], w)

    memory = {}

    def weight(history):
        if history not in memory:
            arcs = [g[-1] for g in kept if g[:-1] == history]
            known = len(history) == 1 and (history[0] is None or history[0] in states) or history in kept
            left = 1 - sum((kept[(*history, w)] - 0.75) / seen(history) for w in arcs)
            open_ = 1 - sum(p(history[1:], w) for w in arcs)
            memory[history] = left / open_ if known and arcs and left > 1e-12 and open_ > 1e-12 else 1.0
        return memory[history]

    result = []
    for text in texts:
        total, history = 0.0, (None,)
        for w in tokens_of(text):
            longest = history
            while longest and not (len(longest) == 1 and (longest[0] is None or longest[0] in states) or longest in kept):
                longest = longest[1:]
            total += math.log10(p(longest, w))
            history = (*history, w)[-(order - 1):]
        result.append((sum(math.log10(uni(w)) for w in tokens_of(text)), total))
    return result, n, counts


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_a_token_by_token_walk(spark, order):
    draw = random.Random(5)
    texts = [" ".join(draw.choices(["the", "of", "a", "Cat", "dog\t", "ran", "É", "sat\n"], weights=[9, 7, 5, 2, 2, 1, 1, 1], k=draw.randint(0, 30)))
             for _ in range(60)] + [None, "", " x ", "unseen words only"]
    docs = spark.createDataFrame([(n, t, n % 3 != 0) for n, t in enumerate(texts)], "doc_id long, text string, block boolean").repartition(4)
    rows = {r["doc_id"]: r for r in lm_scoring.score_documents(docs, F.col("block"), order=order).collect()}
    expected, total, counts = scored_by_definition([t for n, t in enumerate(texts) if n % 3], texts, order)
    for n, (base, score) in enumerate(expected):
        r = rows[n]
        own = tokens_of(texts[n])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert math.isclose(r["base_score"], base, abs_tol=1e-9) and math.isclose(r["score"], score, abs_tol=1e-7), texts[n]


def test_spread_middle_words_and_many_shards_give_the_same_scores(spark, monkeypatch):
    """Blocks of a few texts, shards of 40 tokens: frequent words are spread over shards, their histories are added up."""
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 40)
    draw = random.Random(6)
    words = ["the", "of", *(f"w{n}" for n in range(30))]
    texts = [" ".join(draw.choices(words, weights=[60, 20, *[1] * 30], k=draw.randint(0, 40))) for _ in range(80)]
    texts += ["hot unseen " * 30, "the the the", "hot the"]
    docs = spark.createDataFrame([(n, t, n % 4 != 0 and n < 80) for n, t in enumerate(texts)], "doc_id long, text string, t boolean")
    blocks = lm_scoring.blocks_of(docs.repartition(6), F.col("t"), "text", "doc_id")
    sizes = lm_scoring.Sizes.of(blocks)
    assert blocks.count() > 3 and sizes.shards > 20
    rows = {r["doc_id"]: r for r in lm_scoring.score(blocks, 3).collect()}
    expected, total, _ = scored_by_definition([t for n, t in enumerate(texts) if n % 4 and n < 80], texts, 3)
    assert sizes.tokens == total and len(rows) == len(texts)
    for n, (base, score) in enumerate(expected):
        assert math.isclose(rows[n]["base_score"], base, abs_tol=1e-9) and math.isclose(rows[n]["score"], score, abs_tol=1e-7), texts[n]


def test_spread_histories_are_asked_and_answered_packed(spark, monkeypatch):
    """No row for each history: a row for each block and shard at most, whatever the number of spread histories."""
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 400)
    docs = spark.createDataFrame([(n, " ".join(f"x{n}y{k} the" for k in range(200))) for n in range(12)], "doc_id long, text string")
    blocks = lm_scoring.blocks_of(docs.repartition(4), F.lit(True), "text", "doc_id")
    sizes = lm_scoring.Sizes.of(blocks)
    counts = lm_scoring.word_counts(blocks, sizes).withColumn("kind", F.lit(lm_scoring.WORDS).cast("tinyint"))
    numbers = lm_scoring.gram_numbers(blocks, counts.select("block", "shard", "data", "kind"), sizes)
    answered = lm_scoring.history_numbers(numbers, sizes).toArrow()
    asked = sum(len(lm_scoring.unpack(d[0])) for d in answered.column("data").to_pylist())
    assert asked >= 12 * 200 and answered.num_rows <= blocks.count() * sizes.shards
    assert numbers.where(F.col("kind") == lm_scoring.PARTS).count() <= sizes.shards ** 2
    assert "Generate" not in lm_scoring.score(blocks, 3)._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_not_shuffled_for_their_answers(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b d")], "doc_id long, text string")
    plan = lm_scoring.score_documents(docs, F.lit(True))._jdf.queryExecution().executedPlan().toString()
    cogroup = plan[plan.index("FlatMapCoGroupsInArrow"):]
    assert "Exchange" not in cogroup[:cogroup.index("FileScan")] and "Bucketed: true" in cogroup


def test_the_model_is_better_than_single_words_on_held_out_text(spark):
    docs = read_table(spark, "/root/testdata/sf0.1", "documents")
    held = remainder(F.col("doc_id"), 10) == 0
    scored = lm_scoring.score_documents(docs, ~held).join(docs.where(held).select("doc_id"), "doc_id")
    r = scored.agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert r["s"] > r["b"]


def test_scores_without_training_rows_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    rows = lm_scoring.score_documents(docs, F.lit(False)).collect()
    assert [(r["n_known"], r["train_tokens"], r["score"]) for r in rows] == [(0, 0, 0.0)] * 3
    assert lm_scoring.score_documents(docs.where("false"), F.lit(True)).count() == 0


def test_rare_ngrams_count_in_a_large_corpus(spark):
    """Two occurrences among over 2^21 tokens."""
    texts = [(n, "a " * 110_000, True) for n in range(20)] + [(20, "x y", True), (21, "x y", True), (22, "x y", False)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, t boolean").repartition(4)
    found = lm_scoring.score_documents(docs, F.col("t")).where("doc_id = 22").first()
    assert math.isclose(found["score"], math.log10(1.25 / 22) + 2 * math.log10(1.25 / 2), abs_tol=1e-9)


def test_pipeline_stages(spark):
    kept = read_table(spark, SF_DIR, "documents")
    columns = kept.columns
    ids = [{r["doc_id"] for r in kept.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, kept, SF_DIR).persist()
        ids.append({r["doc_id"] for r in made.select("doc_id").collect()})
        assert ids[-1] <= ids[-2] and made.count() == len(ids[-1]), name
        if name != "sentencepiece":
            assert made.columns == columns and made.schema == kept.schema, name
        kept = made
    assert kept.where("NOT round_trip").count() == 0
    assert [r["doc_id"] for r in corpus_pipeline.run(spark, SF_DIR).select("doc_id").orderBy("doc_id").collect()] == sorted(ids[-1])


def test_language_stage_without_labels_keeps_documents_with_letters(spark):
    rows = [(1, "some words", None, "s", 0), (2, "日本語", None, "s", 0), (3, "123 !!", None, "s", 0), (4, "", None, "s", 0), (5, None, None, "s", 0)]
    kept = corpus_pipeline.keep_languages(spark, spark.createDataFrame(rows, DOCS), SF_DIR)
    assert {r["doc_id"] for r in kept.collect()} == {1, 2}


def test_simhash_stage_keeps_one_document_of_each_group(spark):
    """Copies with a word changed: some are within 2 bits of the fingerprint of 3-word shingles, some are not."""
    draw = random.Random(11)
    texts = [None, "", " \n"]
    for _ in range(40):
        base = ["".join(draw.choices("abcdefgh", k=draw.randint(3, 7))) for _ in range(draw.randint(100, 600))]
        copy = list(base)
        copy[draw.randrange(len(copy))] = "zz"
        texts += [" ".join(base), " ".join(base).upper(), " ".join(copy)]
    marks = [simhash_dedup.simhash(simhash_dedup.shingle_hashes(t, 3)) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if bin(marks[a] ^ marks[b]).count("1") <= 2 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    assert 43 < len(set(group)) < 75
    docs = spark.createDataFrame([(n, t, None, "s", None) for n, t in enumerate(texts)], DOCS).repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF_DIR)
    assert {r["doc_id"] for r in kept.collect()} == set(group) and kept.columns == docs.columns


def test_pipeline_keeps_clean_documents_and_survives_odd_ones(spark, tmp_path):
    documents = [(100 + n, t, None, "s", None) for n, t in enumerate(ODD)] + [(None, None, None, None, None)]
    real = read_table(spark, SF_DIR, "documents").limit(60)
    real.unionByName(spark.createDataFrame(documents, DOCS)).write.parquet(f"{tmp_path}/documents.parquet")
    read_table(spark, SF_DIR, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(rows) > 30 and all(r["round_trip"] is not False for r in rows)
