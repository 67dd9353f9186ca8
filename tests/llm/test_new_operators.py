"""Lexical search, toxicity and the conversation trie against brute force, with the odd cases each defines."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gatewaylens.llm import decontaminate, lexical_search, prefix_trie, topk, toxicity, warc
from gatewaylens.session import written
from pyspark.sql import functions as F

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _ranked(docs, items, k=10):
    cut = [[t.translate(LOWER) for t in TERM.findall(text or "")] for _, text in docs]
    n, total = sum(1 for c in cut if c), sum(map(len, cut))
    df = Counter(t for c in cut for t in set(c))
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        asked, scores = [t.translate(LOWER) for t in TERM.findall(text)], []
        for (doc, _), terms in zip(docs, cut):
            tf = Counter(terms)
            m = 25 + (75 * len(terms) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in asked if t in tf)
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def _search(spark, docs, items, k=10):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, score string, n int").repartition(3)
    i = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in lexical_search.rank_documents(d, i, k).collect()), key=str)


def test_search_finds_what_all_products_find(spark, monkeypatch):
    draw = random.Random(4)
    words = [f"w{n}" for n in range(300)] + ["É", "ß9", "I", "i"]
    text = lambda n: draw.choice(" ,.-_\t\n").join(draw.choices(words, [1 / (n + 1) for n in range(len(words))], k=n))
    docs = [(n, text(draw.choice([1, 5, 40, 40, 200]))) for n in range(700)]
    docs += [(900 + n, docs[3][1]) for n in range(30)]  # ties
    docs += [(3, docs[3][1]), (None, docs[3][1]), (None, None), (800, ""), (801, "., -"), (802, None), (803, "w1 " * 50_000 + "w299")]
    items = [(n, text(30)) for n in range(70)] + [(80, docs[3][1]), (80, docs[3][1]), (81, None), (82, ""), (83, "nowhere"), (None, "w1 É")]
    monkeypatch.setattr(lexical_search, "TREE_DOCS", 100)
    monkeypatch.setattr(lexical_search, "TREE_ITEMS", 32)
    for bound in (lexical_search.PASS_BYTES, 1500):
        monkeypatch.setattr(lexical_search, "PASS_BYTES", bound)
        assert _search(spark, docs, items) == _ranked(docs, items)
    assert _search(spark, docs, items, k=1) == _ranked(docs, items, 1)
    assert _search(spark, [(1, None), (2, "")], items) == []
    assert _search(spark, docs, []) == [] and _search(spark, [], items) == []


def test_search_leaves_out_most_pairs():
    draw = np.random.default_rng(1)
    items = [(np.unique(draw.integers(n * 40, n * 40 + 40, 12)), None) for n in range(64)]
    items = [(t, np.full(len(t), 500)) for t, _ in items]
    tree = lexical_search._Items(list(range(64)), items, dict.fromkeys(range(64), 0))
    best = lexical_search._Best(tree, 3)
    owner = np.repeat(np.arange(2000), 20)
    kind = draw.integers(0, 64, 2000)
    term = (np.repeat(kind, 20) * 40 + draw.integers(0, 40, 40_000)).astype(np.int64)
    code = np.unique(owner * 10_000 + term)
    opened = []
    inner = best.add
    best.add = lambda node, scores, docs: (opened.append(scores.size), inner(node, scores, docs))
    lexical_search._search(best, np.arange(2000), code // 10_000, code % 10_000, draw.integers(1, 1000, len(code)))
    assert 0 < sum(opened) < 64 * 2000 / 6  # a leaf of 8 items meets the documents of its 8 kinds at least


def _trie(spark, rows):
    turns = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, conv string, n int")
    coded = written(prefix_trie.coded_turns(turns.repartition(3)), "coded")
    conv = F.col("conv")
    found = prefix_trie.prefix_trie(*prefix_trie.rebuilt(coded, F.crc32(conv.cast("string").cast("binary")) % 4, conv - conv % 20))
    return sorted((tuple(r) for r in found.collect()), key=str)


def _walked(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [v[2:] for v in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}
    new = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = said.get(c - int(math.fmod(c, 20)), [])[:h] + said[c][h:]
    members, below = defaultdict(list), defaultdict(list)
    for c, s in new.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in below[node])
        leaves[node] = sum(leaves[x] for x in below[node]) or 1
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(below[n]), leaves[n], saved[n],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(new[c]) == len(n)).encode()).hexdigest())
                   for n, m in members.items()), key=str)


def test_trie_equals_a_walk(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_PER_PIECE", 4)
    draw = random.Random(9)
    rows = []
    for c in [*range(0, 90), 205, -7, 10_000_000_021]:
        for turn in range(draw.choice([1, 1, 2, 3, 5, 8, 9])):
            rows.append((c, turn * 2, draw.choice(["user", None]), draw.choice(["a b", "c", "", None, "d e f"])))
    rows += [(300, n, "user", "go on") for n in range(70)] + [(301, n, "user", "go on") for n in range(70)]  # long and alike
    rows += [(302, None, "system", "first"), (302, 0, "user", "then"), (302, None, "system", "first")]  # a repeated row, no number
    rows += [(c, 0, "user", "same") for c in range(400, 440)]  # one node where many end
    rows += [(310, 0, "user", "x " * 100_000), (None, 0, "user", "nobody")]
    assert _trie(spark, rows) == _walked(rows)
    assert _trie(spark, []) == []


def test_trie_of_turnless_conversations(spark):
    # Conversation 7 has one turn, and its first ones come from an absent conversation.
    h = zlib.crc32(b"7") % 4
    rows = [(7, 0, "user", "a")] if h else [(c := next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4), 0, "user", "a")]
    assert _trie(spark, rows) == _walked(rows)


def _labelled(spark, draw, count, first=0):
    good = ["water", "garden", "letter", "window", "música", "straße"]
    rows, labels = [], []
    for n in range(first, first + count):
        words = draw.choices(good, k=draw.choice([5, 60, 400]))
        toxic = n % 4 == 0
        if toxic:
            for at in range(0, len(words), 10):
                words[at] = draw.choice(["vileness", "vilely", "VILEST"])
        rows.append((n, " ".join(words)))
        labels.append((n, int(toxic)))
    return rows, labels


def test_toxic_texts_are_told_apart(spark):
    draw = random.Random(2)
    rows, labels = _labelled(spark, draw, 400)
    odd = [(1000, None), (1001, ""), (1002, "?! ..."), (1003, "garden " * 200_000), (None, "viler than vile"), (1004, "unseenword")]
    labels += [(1000, 1), (1000, 0), (None, 1), (3, None), (5000, 1)]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows + odd], "doc_id long, text string, score double, label string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    learned = ~toxicity.held_out(F.col("doc_id"))
    model = toxicity.train(docs, known, learned)
    found = toxicity.score(docs, model).collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["label"] == "x" for r in found)
    score = {r["doc_id"]: r["score"] for r in found}
    truth = dict(labels[:400])
    outside = [n for n in truth if zlib.crc32(str(n).encode()) % 3 == 1]
    assert len(outside) > 100 and all((score[n] >= 0.7) == bool(truth[n]) for n in outside)
    assert score[1000] == score[1001] == score[1002] < 0.7 and score[1003] < 0.7 and score[None] > 0.7
    # Labels, ids and the order of rows are no inputs of a score.
    moved = docs.select((F.col("doc_id") + 7).alias("doc_id"), "text").repartition(5)
    again = {r["doc_id"] - 7: r["score"] for r in toxicity.score(moved, model, keep=["doc_id"]).where("doc_id IS NOT NULL").collect()}
    assert again == {n: s for n, s in score.items() if n is not None}
    # Held-out labels teach nothing.
    turned = known.withColumn("toxic", F.when(learned, F.col("toxic")).otherwise(1 - F.col("toxic")))
    other = toxicity.train(docs, turned, learned)
    assert np.array_equal(other.weights, model.weights) and other.bias == model.bias


@pytest.mark.parametrize("side", [0, 1])
def test_one_kind_of_label_is_no_model(spark, side):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, side)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels) is None
    assert [r["score"] for r in toxicity.score(docs, None).collect()] == [0.0, 0.0]
    assert toxicity.score(docs.limit(0), None).count() == 0


def test_ngrams_are_counted_inside_words():
    ids, owner = toxicity.features_of(["abc", "b", "abc"])
    by = [sorted(ids[owner == n].tolist()) for n in range(3)]
    assert by[0] == by[2] and len(by[0]) == sum(max(0, 5 - n + 1) for n in toxicity.ORDERS) and len(by[1]) == 1
    assert len(toxicity.features_of([])[0]) == 0


def test_items_that_share_an_id_are_all_looked_for(spark):
    draw = random.Random(6)
    items = [" ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(30)) for _ in range(12)]
    docs = spark.createDataFrame([(n, "before it " + t + " after it", 1) for n, t in enumerate(items)], "doc_id long, text string, __g1 int")
    for ids in (range(12), [5] * 12):
        benchmark = spark.createDataFrame(list(zip(ids, items)), "item_id long, text string")
        found = decontaminate.contaminated(docs, benchmark).collect()
        assert {(r["id"], r["item"]) for r in found} == set(zip(range(12), ids)) and len(found) == 12
    assert decontaminate.drop_contaminated(docs, benchmark).count() == 0


def test_ranges_are_read_in_tasks_of_their_own(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).alias("html"))
    folder = warc.write_archives(warc.planned(pages.repartition(2)))
    ranges = warc.byte_ranges(spark, folder, 1 << 14)
    number = ranges.count()
    tasks = ranges.select(F.spark_partition_id().alias("p")).distinct().count()
    assert number > 20 and tasks > number / 2
    assert warc.read_archives(spark, folder, 1 << 14).count() == 3000


def test_buckets_out_of_reach_are_not_sent(spark):
    heads = spark.createDataFrame([(2, 0, 10.0), (2, 1, float("-inf")), (3, 2, 1.0)], "dim int, q_block long, need double")
    buckets = spark.createDataFrame([(2, n, float(n)) for n in range(20)], "dim int, block long, longest double")
    pairs = {(r["q_block"], r["block"]) for r in topk.reachable(heads, buckets).collect()}
    assert pairs == {(0, n) for n in range(10, 20)} | {(1, n) for n in range(20)}


def test_a_repeated_query_asks_with_its_smallest_vector(spark):
    vectors = spark.createDataFrame([(0, [9, 1]), (0, [1, 9]), (1, [10, 0]), (2, [0, 10])], "vec_id long, vector array<bigint>")
    found = [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(vectors, F.col("vec_id") == 0, k=2).orderBy("rank").collect()]
    assert found == [(1, 2, 90), (2, 1, 10)]
