"""SimHash near-dedup, line dedup, components and decontamination against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from gatewaylens.llm import components, decontaminate, line_dedup, simhash_dedup
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, k1 string"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + n, t, "en", "x") for n, t in enumerate(texts)], DOCS)


def classes(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    return {n: root(n) for n in nodes}


def sentence(draw, words):
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(words))


def edited(draw, text, times):
    words = text.split(" ")
    for _ in range(times):
        words[draw.randrange(len(words))] = "zq" + str(draw.randint(0, 999))
    return " ".join(words)


def test_components_of_paths_stars_and_nothing(spark):
    links = [(n, n + 1) for n in range(1, 60)] + [(100, n) for n in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    edges = spark.createDataFrame(links + [(None, 3)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.connected_components(edges, "a", "b").collect()}
    nodes = {x for link in links for x in link}
    assert found == classes(nodes, links)
    assert components.connected_components(edges.where("false"), "a", "b").count() == 0


def simhash_by_definition(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    runs = [" ".join(words[n:n + 3]) for n in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_classes_equal_brute_force(spark):
    draw = random.Random(1)
    texts = [None, "", " \t", "One", "one TWO", "É é A b c d", "a b c a b c a b c", "x" * 50000]
    for _ in range(25):
        base = sentence(draw, 400)
        texts += [base, base.upper(), edited(draw, base, 1), edited(draw, base, 2), sentence(draw, draw.randint(1, 40))]
    docs = docs_of(spark, texts).repartition(5)
    rows = simhash_dedup.near_duplicates(docs).collect()
    marks = {n: simhash_by_definition(t) for n, t in enumerate(texts)}
    links = [(a, b) for a in marks for b in marks if a < b and bin(marks[a] ^ marks[b]).count("1") <= 2]
    expected = classes(list(marks), links)
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in rows} == {
        n: (marks[n], expected[n]) for n in marks}
    assert all(len(r["fingerprint"]) == 16 for r in rows)
    kept = simhash_dedup.keep_first(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values()))
    assert kept.columns == docs.columns


def test_simhash_tiles_hold_a_large_group_of_near_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "TILE", 16)
    draw = random.Random(2)
    marks = {0, 3, (1 << 64) - 1}
    for _ in range(40):
        base = draw.getrandbits(64)
        marks |= {base} | {base ^ (1 << draw.randrange(64)) for _ in range(6)}
    signed = [int(np.uint64(m).astype(np.int64)) for m in marks]
    links = simhash_dedup.fingerprint_links(spark.createDataFrame([(m,) for m in signed], "fp long").repartition(4))
    found = {r["node"]: r["component"] for r in components.connected_components(links, "a", "b").collect()}
    pairs = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    expected = classes(signed, pairs)
    together = {}
    for node, name in expected.items():
        together.setdefault(name, set()).add(node)
    mine = {}
    for node in signed:
        mine.setdefault(found.get(node, node), set()).add(node)
    assert sorted(map(sorted, together.values())) == sorted(map(sorted, mine.values()))


def test_simhash_rows_without_id_repeated_rows_and_empty_table(spark):
    text = sentence(random.Random(3), 50)
    rows = [(None, text, "a", "b"), (None, text, "a", "b"), (4, text, "a", "b"), (4, text, "a", "b"), (None, "other words here", "a", "b")]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(r["component_id"] for r in simhash_dedup.near_duplicates(docs).where("fingerprint != ''").collect()
                  if r["component_id"] is not None) == [4, 4, 4, 4]
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash_dedup.keep_first(docs).collect()), key=str)
    assert kept == sorted([(4, text), (None, "other words here")], key=str)
    assert simhash_dedup.near_duplicates(docs.where("false")).count() == 0
    assert simhash_dedup.keep_first(docs.where("false")).count() == 0


def shingles(line):
    return {line[n:n + 5] for n in range(len(line) - 4)} if len(line) > 5 else {line}


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) >= 0.8


def lines_by_brute_force(texts):
    places = {}
    for n, text in enumerate(texts):
        for at, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\r"):
                places.setdefault(line.strip(" \t\r"), []).append((n, at))
    lines = sorted(places)
    links = [(a, b) for i, a in enumerate(lines) for b in lines[i + 1:] if similar(a, b)]
    groups = {}
    for line, name in classes(lines, links).items():
        groups.setdefault(name, []).extend(places[line])
    gone = {p for group in groups.values() for p in group if p != min(group)}
    return [None if t is None else "\n".join(l for at, l in enumerate(t.split("\n")) if (n, at) not in gone)
            for n, t in enumerate(texts)]


def test_line_dedup_equals_brute_force(spark):
    draw = random.Random(4)
    texts = [None, "", "\n \n", "a\na\nb", "  a \r\nlonger line of words", "x" * 3000 + "\n" + "x" * 3000 + "y"]
    pool = [sentence(draw, draw.randint(1, 60)) for _ in range(30)]
    wide = ["".join(draw.choice("漢字仮名交文章例") for _ in range(90)) for _ in range(4)]
    for _ in range(40):
        own = [draw.choice(pool + wide) for _ in range(draw.randint(1, 5))]
        own = [edited(draw, line, 1) if draw.random() < 0.4 and " " in line else line for line in own]
        texts.append("\n".join([*own, sentence(draw, 12), ""]))
    texts.append(wide[0][:40] + "例外" + wide[0][42:])
    docs = docs_of(spark, texts)
    rows = line_dedup.dedup_lines(docs, n_removed="gone").collect()
    assert {r["doc_id"]: r["text"] for r in rows} == dict(enumerate(lines_by_brute_force(texts)))
    assert rows[0].asDict().keys() == {*docs.columns, "gone"}


def test_line_dedup_of_a_large_group_of_variants(spark):
    draw = random.Random(5)
    base = sentence(draw, 60)
    texts = [edited(draw, base, draw.randint(0, 2)) for _ in range(120)] + [sentence(draw, 60)]
    assert [r["text"] for r in line_dedup.dedup_lines(docs_of(spark, texts)).orderBy("doc_id").collect()] == lines_by_brute_force(texts)


def test_pairs_of_a_large_group_of_variants_follow_its_lines(spark, monkeypatch):
    """Lines that differ from their middle in many ways: what is left after it is compared does not grow with the square of the group."""
    draw = random.Random(11)
    base = sentence(draw, 60)
    texts = [edited(draw, base, draw.choice([0, 1, 2, 3, 4, 6, 8, 10])) for _ in range(240)]
    counts, possible = [], line_dedup.possible

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return possible(pairs, *rest)

    monkeypatch.setattr(line_dedup, "possible", counted)
    kept = [r["text"] for r in line_dedup.dedup_lines(docs_of(spark, texts)).orderBy("doc_id").collect()]
    print("pairs", counts, "lines", len(set(texts)))
    assert kept == lines_by_brute_force(texts)
    assert sum(counts) < 4 * len(texts)


def test_line_dedup_rows_without_id_repeated_rows_and_empty_table(spark):
    line = sentence(random.Random(6), 20)
    docs = spark.createDataFrame([(None, line, "a", "b"), (3, line, "a", "b"), (3, line, "a", "b"), (9, line + "\nalone here now", "a", "b")], DOCS)
    kept = sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.dedup_lines(docs).collect())
    assert kept == [("3", line), ("3", line), ("9", "alone here now"), ("None", "")]
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


@pytest.mark.parametrize("edits,least", [(0, 1.0), (1, 1.0), (3, 0.97)])
def test_banding_finds_similar_lines(spark, edits, least):
    """Recall of the candidates: lines of 50 words, each with a copy in which some words are replaced."""
    draw = random.Random(7 + edits)
    lines = [sentence(draw, 50) for _ in range(150)]
    copies = [line if not edits else edited(draw, line, edits) for line in lines]
    wanted = [n for n in range(150) if lines[n] != copies[n] and similar(lines[n], copies[n])]
    docs = docs_of(spark, lines + copies)
    kept = {r["doc_id"] for r in line_dedup.dedup_lines(docs).where("text != ''").collect()}
    if wanted:
        assert sum(n + 150 not in kept for n in wanted) / len(wanted) >= least


def test_banding_finds_similar_short_lines(spark):
    """Recall by line length: lines of a few words, each with a copy in which one character is changed."""
    draw = random.Random(12)
    lines, copies, sizes = [], [], []
    for words in (5, 6, 8, 10, 15, 20, 25, 30):
        for _ in range(150):
            line = sentence(draw, words)
            at = draw.choice([0, 1, len(line) - 1, draw.randrange(len(line))])
            lines.append(line)
            copies.append(line[:at] + "z" + line[at + 1:])
            sizes.append(words)
    kept = {r["doc_id"] for r in line_dedup.dedup_lines(docs_of(spark, lines + copies)).where("text != ''").collect()}
    for words in sorted(set(sizes)):
        wanted = [n for n, size in enumerate(sizes) if size == words and similar(lines[n], copies[n])]
        assert len(wanted) > 20
        assert sum(n + len(lines) not in kept for n in wanted) / len(wanted) >= 0.99, words


def test_banding_finds_similar_lines_of_repeated_words(spark):
    base = "some words of a line that stands here again and goes on for more than a hundred characters in its whole"
    texts = [base, " ".join([base] * 4), "=" * 40, "=" * 300, "ab " * 20 + "ab", "ab " * 200 + "ab"]
    assert [r["text"] for r in line_dedup.dedup_lines(docs_of(spark, texts)).orderBy("doc_id").collect()] == lines_by_brute_force(texts)


def words_of(text):
    return __import__("re").findall(r"[^\W_]+", (text or "").lower())


def best_window(text, item):
    words, own = words_of(text), words_of(item)
    size = min(5, len(own))
    hs = [tuple(words[n:n + size]) for n in range(len(words) - size + 1)]
    target = [tuple(own[n:n + size]) for n in range(len(own) - size + 1)]
    best = 0.0
    from collections import Counter
    want = Counter(target)
    for start in range(max(1, len(hs) - len(target) + 1)):
        have = Counter(hs[start:start + len(target)])
        if have:
            common = sum((have & want).values())
            best = max(best, common / (sum(have.values()) + len(target) - common))
    return best


def test_decontamination_equals_all_windows(spark):
    draw = random.Random(8)
    items = [sentence(draw, n) for n in (14, 20, 37, 59, 5, 3, 1)] + ["rep eat rep eat rep eat rep eat rep eat rep eat", None, ""]
    texts = [None, "", "one", items[0], items[3].upper().replace(" ", ", "), "rep eat " * 20, items[5], items[6] + " x"]
    for _ in range(60):
        parts = [sentence(draw, draw.randint(0, 40))]
        for _ in range(draw.randint(0, 2)):
            parts += [edited(draw, draw.choice(items[:4]), draw.randint(0, 2)), sentence(draw, draw.randint(1, 30))]
        words = " ".join(parts).split()
        if draw.random() < 0.3 and words:
            del words[draw.randrange(len(words))]
        texts.append(" ".join(words))
    benchmark = spark.createDataFrame(list(enumerate(items)) + [(None, items[0])], "item_id long, text string")
    docs = docs_of(spark, texts)
    found = {(r["id"], r["item"]): r["similarity"] for r in decontaminate.contaminated(docs, benchmark).collect()}
    expected = {(n, k): s for n, t in enumerate(texts) for k, item in enumerate(items)
                if words_of(item) and words_of(t) and (s := best_window(t, item)) >= 0.8 - 1e-12}
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - expected[k]) < 1e-9 for k in found)
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, benchmark).collect()}
    assert kept == set(range(len(texts))) - {n for n, _ in expected}
    assert decontaminate.contaminated(docs.where("false"), benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.where("false")).count() == 0


def test_decontamination_of_repeated_rows_and_rows_without_id(spark):
    item = sentence(random.Random(9), 30)
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(None, item, "a", "b"), (None, "clean text of no item", "a", "b"), (2, item, "a", "b"), (2, item, "a", "b")], DOCS)
    assert [r["text"] for r in decontaminate.drop_contaminated(docs, benchmark).collect()] == ["clean text of no item"]
    assert decontaminate.contaminated(docs, benchmark).count() == 2


def test_simhash_of_shingles_equals_definition(spark):
    draw = random.Random(10)
    hashes = {n: [draw.getrandbits(64) for _ in range(draw.randint(1, 80))] for n in range(20)}
    rows = [(n, int(np.uint64(h).astype(np.int64)), at >> 5) for n, hs in hashes.items() for at, h in enumerate(hs)]
    found = decontaminate.simhash_of(spark.createDataFrame(rows, "k long, h long, part int"), ["k"], "h").collect()
    for r in found:
        hs = hashes[r["k"]]
        assert r["fp"] & (1 << 64) - 1 == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    near = spark.range(1).select(decontaminate.blocks(F.lit(-1).cast("long"), 22).alias("b")).first()["b"]
    assert len(near) == 23 and sum(bin(b["value"]).count("1") for b in near) == 64


def test_no_similar_pair_of_lines_fails_the_bound_and_few_others_pass(spark):
    draw = random.Random(8)
    texts = []
    for n in range(12):
        size = [5, 9, 40, 120, 300][n % 5]
        own = "".join(draw.choices("abcdefgh é\U0001F600", k=size))
        texts.append(own)
        for changes in (1, 2, 3, 6, 12):
            chars = list(own)
            for at in draw.sample(range(size), min(changes, size)):
                chars[at] = draw.choice("xyz")
            texts.append("".join(chars))
    lines = spark.createDataFrame([(n, -n, t) for n, t in enumerate(texts)], "k1 long, k2 long, line string")
    key = F.struct("k1", "k2")
    pairs = lines.select(key.alias("a")).crossJoin(lines.select(key.alias("b"))).where("a.k1 > b.k1")
    kept = {(r["a"]["k1"], r["b"]["k1"]) for r in line_dedup.possible(pairs, lines, 0.8).collect()}

    def alike(x: str, y: str) -> float:
        x, y = ({t[i:i + 5] for i in range(max(1, len(t) - 4))} for t in (x, y))
        return len(x & y) / len(x | y)

    found = {(a, b): alike(texts[a], texts[b]) for a in range(len(texts)) for b in range(a)}
    similar = {p for p, s in found.items() if s >= 0.8}
    assert similar and similar <= kept
    assert len(kept) <= len(similar) + 0.02 * len(found)


def test_only_lines_with_two_bands_in_common_with_one_line_go_on(spark):
    rows = [(1, [10, 20], 4), (2, [10, 30], 4), (3, [20, 30], 4), (4, [40, 50], 4), (5, [40, 50, 60], 6), (6, [60, 70], 4)]
    lines = spark.createDataFrame(rows, "k1 long, bands array<long>, mates long")
    assert sorted(r["k1"] for r in line_dedup._with_mates(lines).collect()) == [4, 5]


def test_runs_of_lines_are_cut_by_place(spark):
    """No matcher goes over the lines, and the runs are those of the definition, for characters of all widths."""
    texts = ["", "a", "abcde", "abcdef", "aaaaaaaa", "é漢\U0001F600字 bc", "\U0001F600" * 7 + "ab", "ein Satz über Straßen"]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    sizes = rows.select("n", F.size(line_dedup._hashes(F.col("t"))).alias("size")).collect()
    cut = [{t[i:i + 5] for i in range(max(1, len(t) - 4))} for t in texts]
    assert {r["n"]: r["size"] for r in sizes} == {n: len(c) for n, c in enumerate(cut)}
    pairs = rows.select(F.col("n").alias("x"), F.col("t").alias("left")).crossJoin(rows.select(F.col("n").alias("y"), F.col("t").alias("right")))
    for r in pairs.where("left != '' AND right != ''").select("x", "y", line_dedup.jaccard(F.col("left"), F.col("right")).alias("s")).collect():
        assert abs(r["s"] - len(cut[r["x"]] & cut[r["y"]]) / len(cut[r["x"]] | cut[r["y"]])) < 1e-9
    word = "some words of a line that has more than one hundred and sixty characters in it, so that only runs at words are taken " * 2
    lines = spark.createDataFrame([(1, "ab cd efg"), (2, " ".join(f"{n}{w}" for n, w in enumerate(word.split())))], "k1 long, line string")
    runs = line_dedup._sampled(lines)
    assert "regexp" not in runs._jdf.queryExecution().toString()
    line = lines.collect()[1]["line"]
    wanted = {(1, "ab cd efg"[i:i + 5]) for i in range(5)} | {(2, line[i:i + 9]) for i in range(len(line)) if i == 0 or line[i - 1] == " "}
    hashed = spark.createDataFrame(sorted(wanted), "k1 long, run string").select("k1", F.xxhash64("run").alias("h0"))
    assert {tuple(r) for r in runs.select("k1", "h0").collect()} == {tuple(r) for r in hashed.collect()}
