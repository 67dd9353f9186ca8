"""WARC, top-k and URL filter against definitions; the registered queries against their SQL."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from compare import connect, differences  # noqa: E402

from gatewaylens.llm import topk, url_filter, warc  # noqa: E402
from gatewaylens.llm.registered import QUERIES, RULES, SQL  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, connect(SF_DIR), name, QUERIES[name], SQL[name], SF_DIR) == []


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_archives_come_back(spark):
    draw = random.Random(1)
    big = "".join(draw.choices("abcdefghij <>\r\n", k=(17 << 20)))
    long_text = "é" * 700
    rows = [(1, "http://a.b/c d", long_text, "x"), (5, None, long_text, "x"), (3, "u", long_text, "x"), (7, "u\r\nWARC-Type: x", "short", "x"),
            (8, "u", "short", "x"), (9, "u", None, "x"), (10, "u", "", "x"), (None, "u", long_text, "x"), (5, None, long_text, "x"), (11, "u", big, "x"),
            (None, "u", "only without an id" * 100, "x"), (12, "u", "WARC/1.1\r\n\r\n" * 200, "x")]
    folder = warc.write_archives(warc.planned(pages_of(spark, rows).repartition(3)))
    found = warc.read_archives(spark, folder, size=1 << 12, payload=True).collect()
    assert len(found) == len(rows)
    expected = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        same = [p for p, _, h, _ in rows if h == html and p is not None]
        refers = max(same) if len(data) >= 1000 and same and page != max(same) else None
        expected.append((str(page), len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == sorted(expected)
    texts = {r["page_id"]: bytes(r["payload"]).decode() for r in found if r["record_type"] == "response" and r["page_id"]}
    assert texts[11] == big and texts[5] == long_text and texts[9] == ""
    for size in (1 << 10, 1 << 20, 1 << 30):
        assert warc.read_archives(spark, folder, size).count() == len(rows)
    # Any reader of gzip files can read the archives.
    files = sorted(Path(folder).glob("part-*"))
    plain = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert plain.count(b"WARC-Record-ID") == len(rows)
    empty = warc.write_archives(warc.planned(pages_of(spark, rows).where("false")))
    assert warc.read_archives(spark, empty).count() == 0


def test_false_starts_belong_to_no_record():
    inner = warc.member(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n")
    records = [b"WARC/1.1\r\n\r\n" + bytes([n]) * (n * 37) for n in range(1, 40)]
    data = b"\x1f\x8b\x08junk" + b"".join(map(warc.member, records)) + b"\x1f\x8b\x08" + inner[:-5]
    for size in (7, 64, 1000, len(data)):
        found = []
        for first in range(0, len(data), size):
            found += warc.records_in(pa.BufferReader(data), first, min(first + size, len(data)))
        assert [content for _, content in found] == records
    assert gzip.GzipFile(fileobj=io.BytesIO(warc.member(records[3]))).read() == records[3]


def best_by_definition(vectors, query_ids, k):
    rows = []
    for q in query_ids:
        for own in [v for i, v in vectors if i == q][:1]:
            scores = [(-int(sum(int(a) * int(b) for a, b in zip(own, v))), i) for i, v in vectors if i != q and len(v) == len(own)]
            rows += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(rows)


@pytest.mark.parametrize("kind", ["plain", "copies", "skewed", "negative"])
def test_top_k_equals_all_products(spark, kind):
    draw = np.random.default_rng(2)
    base = draw.normal(0, 40, (400, 24))
    if kind == "copies":
        base[:200] = base[0]
    if kind == "skewed":
        base *= np.exp(draw.normal(0, 2, (400, 1)))
    if kind == "negative":
        base = -np.abs(base[:, :1]) @ np.ones((1, 24))
        base[::7] *= -1
    vectors = [(int(i), [int(x) for x in np.floor(v)]) for i, v in enumerate(base)] + [(1000, [3, 4]), (1010, [1, 2]), (1020, [0])]
    table = spark.createDataFrame(vectors, "vec_id long, vector array<long>").repartition(3)
    found = topk.top_k(table, F.col("vec_id") % 10 == 0, 5, bucket=32, block=16)
    mine = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())
    assert mine == best_by_definition(vectors, [i for i, _ in vectors if i % 10 == 0], 5)


def test_top_k_of_odd_rows(spark):
    big = 1 << 29
    rows = [(0, [1.5, None]), (None, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (10, [0.5, -0.25]), (20, []),
            (30, []), (40, [float(big), 1.0]), (50, [float(big), -1.0]), (60, [0.0, 0.0])]
    raw = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = raw.select("vec_id", topk.quantised(F.col("embedding")).alias("vector"))
    whole = {r["vec_id"]: r["vector"] for r in vectors.collect() if r["vector"] is not None and r["vec_id"] is not None}
    assert set(whole) == {10, 20, 30, 40, 50, 60} and whole[10] == [128, -64]
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(vectors, F.col("vec_id") % 10 == 0, 5).collect()
    small = vectors.where("vec_id NOT IN (40, 50)")
    mine = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(small, F.col("vec_id") % 10 == 0, 5).collect())
    assert mine == [(10, 1, 60, 0), (20, 1, 30, 0), (30, 1, 20, 0), (60, 1, 10, 0)]
    assert topk.top_k(small.where("false"), F.lit(True), 5).count() == 0


def judged_by_definition(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fits:
        return host, path, None, "allow"
    best = max(fits, key=lambda r: (len(r.text), len(r.host)))
    return host, path, best.text, best.verdict


URLS = ["http://WWW.Example.com/en/1", "https://example.com/en", "https://a.b.example.com/en/x?y#z", "http://notexample.com/en/", "x.net/es/",
        "ftp://q.net/es/1", "http://net/fr/", "http://x.net/fr", "http://com", "http://com/", "http://a..com/", "://.com/", "http:///x", "", None,
        "a://b://c.com/", "http://example.com?x=/en/", "http://u@example.com:80/en/", "http://" + "a." * 3000 + "net/es/", "http://é.net/es/", "plain"]


def test_url_filter_equals_definition(spark):
    draw = random.Random(3)
    rules = RULES + [url_filter.Rule(".".join(draw.choices(["a", "b", "com", "net"], k=draw.randint(1, 3))),
                                     draw.choice(["", "/", "/x", "/x/", "/x/y"]), draw.choice(["allow", "block"])) for _ in range(60)]
    first = list({r.text: r for r in reversed(rules)}.values())
    urls = URLS + ["http://" + ".".join(draw.choices(["a", "b", "com", "net"], k=draw.randint(1, 4))) + draw.choice(["", "/", "/x", "/xy", "/x/y/z", "/X/"])
                   for _ in range(400)]
    for own in (RULES, first, []):
        pages = spark.createDataFrame([(n, u, "a clash") for n, u in enumerate(urls)], "page_id long, url string, rule string")
        rows = url_filter.judge(pages, url_filter.build(spark, rules if own is first else own)).collect()
        assert len(rows) == len(urls)
        for r in rows:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged_by_definition(urls[r["page_id"]], own), urls[r["page_id"]][:80]
    assert url_filter.judge(pages.where("false"), url_filter.build(spark, RULES)).count() == 0


def test_a_digest_that_collides_decides_nothing():
    stored = {"digests": np.array([5, 5], np.uint64), "ends": np.array([0, 1, 2]), "texts": np.frombuffer(b"ab", np.uint8)}
    original = url_filter._digest
    url_filter._digest = lambda text: 5
    try:
        assert url_filter.probe(stored, [b"b", b"c", b"a"]).tolist() == [1, -1, 0]
    finally:
        url_filter._digest = original
