"""Benchmark decontamination with DataFrame functions only: SimHash of item-sized windows.

A window has as many words as the item it is compared with. Its fingerprint is the SimHash of its 5-word
shingles; blocks of the fingerprint (one more than the radius) are an index in which every pair within the radius
shares a key, and an exact similarity of weighted shingles decides.

Which windows are fingerprinted: a similar window shares shingles with its item, and the best window of a
document begins at a shared shingle or is the document's last (moving a best window to the right without
loss ends where its first shingle is shared). So windows begin there, and only where the shared shingles can
reach the similarity at all: an exact bound, nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatewaylens.llm.common import fresh_name
from gatewaylens.llm.simhash_dedup import row_digest
from gatewaylens.session import written

WORDS = 5
SIMILARITY = 0.8
# At similarity 0.8 two fingerprints differ in 10 of 64 bits on average, with a deviation of 3.
RADIUS = 22


def _words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: Column, size: int) -> Column:
    """Hash of every run of `size` words."""
    last = F.size(words) - size
    none = F.array().cast("array<bigint>")
    return F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.xxhash64(F.lit(size), *[F.get(words, i + n) for n in range(size)]),
    )).otherwise(none)


def _items(benchmark: DataFrame, text: str, id_col: str) -> DataFrame:
    """(item, name, size, shingles): items with fewer than five words have one shingle of their own size.

    `item` stands for id and text by 64 bits, `name` is the id: texts that share an id are items of their own.
    """
    known = benchmark.where(F.col(id_col).isNotNull())
    words = known.select(F.xxhash64(id_col, text).alias("item"), F.col(id_col).alias("name"), _words(F.col(text)).alias("words"))
    words = words.where("size(words) > 0").select("item", "name", "words", F.least(F.size("words"), F.lit(WORDS)).alias("size"))
    cases = F.lit(None).cast("array<bigint>")
    for size in range(1, WORDS + 1):
        cases = F.when(F.col("size") == size, _shingles(F.col("words"), size)).otherwise(cases)
    return words.select("item", "name", "size", cases.alias("shingles")).dropDuplicates(["item"])


def simhash_of(rows: DataFrame, keys: list[str], shingle: str) -> DataFrame:
    """(keys, fp): SimHash of the shingles of each key, a row for each occurrence.

    Sixteen sums hold four counters of 16 bits each; a window is far shorter than 65,536 words, and longer
    items are summed in parts of that size by their place (`part`).
    """
    spread = 0x0001000100010001
    packed = [F.sum(F.shiftrightunsigned(shingle, bit).bitwiseAND(F.lit(spread))).alias(f"s{bit}") for bit in range(16)]
    parts = rows.groupBy(*keys, "part").agg(F.count("*").alias("n"), *packed)
    lanes = [
        F.sum(F.shiftrightunsigned(f"s{bit}", 16 * lane).bitwiseAND(F.lit(0xFFFF))).alias(f"b{16 * lane + bit}")
        for bit in range(16) for lane in range(4)
    ]
    counts = parts.groupBy(*keys).agg(F.sum("n").alias("n"), *lanes)
    bits = [F.when(F.col(f"b{i}") * 2 > F.col("n"), F.lit(_bit(i))).otherwise(F.lit(0).cast("bigint")) for i in range(64)]
    fp = bits[0]
    for bit in bits[1:]:
        fp = fp.bitwiseOR(bit)
    return counts.select(*keys, fp.alias("fp"))


def _bit(i: int) -> int:
    return (1 << i) if i < 63 else -(1 << 63)


def blocks(fp: Column, radius: int) -> Column:
    """Structs (number, value): the fingerprint cut into radius + 1 blocks, one of which two near ones share."""
    cuts = [round(n * 64 / (radius + 1)) for n in range(radius + 2)]
    return F.array(*[
        F.struct(F.lit(n).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
        for n, (a, b) in enumerate(zip(cuts, cuts[1:]))
    ])


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller over sum of the larger number of times each shingle occurs."""
    common = F.aggregate(
        F.array_distinct(F.array_intersect(a, b)), F.lit(0),
        lambda total, x: total + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))),
    )
    return F.transform(F.array(common), lambda c: c / (F.size(a) + F.size(b) - c))[0]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text",
    item_id: str = "item_id", similarity: float = SIMILARITY, radius: int = RADIUS,
) -> DataFrame:
    """(id, d1, d2, item, word, distance, similarity): the best window of each document and item that are similar.

    Words are lower-case runs of letters and digits, shingles have five of them (an item with fewer words is
    one shingle, found where it stands word for word). `word` is where the window begins, the earliest of equals. d1
    and d2 stand for id and text, so rows that agree in both count once, and rows without an id are told apart
    by their text. Null and empty texts, and items without an id or a word, match nothing. Each text of an id that has several
    is compared; the best of them is the row of that id.
    """
    items = written(_items(benchmark, item_text, item_id), "items")
    parts = items.select("item", "size", F.size("shingles").alias("m"), F.explode("shingles").alias("h"))
    wanted = written(parts.distinct(), "item_shingles")
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # at most five
    if not sizes:
        sizes = [WORDS]
    longest = items.agg(F.max(F.size("shingles"))).first()[0] or 1
    d1, d2 = row_digest(id_col, text)
    marked = docs.select(F.col(id_col).alias("id"), d1.alias("d1"), d2.alias("d2"), _words(F.col(text)).alias("words"))

    hits = None
    for size in sorted(sizes):
        each = marked.select(
            "d1", "d2", (F.size("words") - size + 1).alias("n"), _shingles(F.col("words"), size).alias("hs")
        ).select("d1", "d2", "n", F.posexplode_outer("hs").alias("pos", "h"))
        found = each.join(wanted.where(F.col("size") == size), "h").select("d1", "d2", "n", "pos", "item", "size", "m")
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.distinct()
    # Hits within one window's length; the frame is in window lengths, short of one by less than half a word.
    inside = F.expr(
        "count(*) OVER (PARTITION BY d1, d2, item, size, m ORDER BY pos / CAST(m AS DOUBLE) "
        f"RANGE BETWEEN CURRENT ROW AND {1 - 1 / (2 * longest)!r}D FOLLOWING)")
    start = F.greatest(F.least("pos", F.col("n") - F.col("m")), F.lit(0))
    length = F.least("m", "n")
    shared = hits.select("*", inside.alias("shared"), start.alias("start"), length.alias("length"))
    least = (F.col("m") + F.col("length")) * (similarity / (1 + similarity)) - 1e-9
    windows = shared.where(F.col("shared") >= least).select("d1", "d2", "item", "size", "start", "length").distinct()
    by_doc = windows.groupBy("d1", "d2").agg(F.collect_list(F.struct("item", "size", "start", "length")).alias("windows"))

    joined = marked.dropDuplicates(["d1", "d2"]).join(by_doc, ["d1", "d2"])
    with_shingles = joined.select("id", "d1", "d2", "windows", *[
        _shingles(F.col("words"), size).alias(f"hs{size}") for size in sorted(sizes)])
    cut = F.lit(None).cast("array<bigint>")
    own = F.transform("windows", lambda w: F.struct(
        w["item"].alias("item"), w["start"].alias("start"), _slice_of(w, sizes, cut).alias("hs")))
    each = with_shingles.select("id", "d1", "d2", own.alias("w")).select("id", "d1", "d2", F.inline("w"))
    cutouts = written(each, "windows")

    keys = ["d1", "d2", "item", "start"]
    rows = cutouts.select(*keys, F.posexplode("hs").alias("at", "h")).withColumn("part", F.shiftright("at", 15))
    marks = simhash_of(rows, keys, "h")
    item_rows = items.select("item", "size", F.posexplode("shingles").alias("at", "h")).withColumn("part", F.shiftright("at", 15))
    item_marks = simhash_of(item_rows, ["item", "size"], "h")

    window_keys = marks.select(*keys, "fp", F.explode(blocks(F.col("fp"), radius)).alias("b")).select(*keys, "fp", "b.block", "b.value")
    item_keys = item_marks.select("item", F.col("fp").alias("item_fp"), F.explode(blocks(F.col("fp"), radius)).alias("b"))
    item_keys = item_keys.select("item", "item_fp", "b.block", "b.value")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = window_keys.join(item_keys, ["item", "block", "value"]).select(*keys, distance.alias("distance"))
    near = near.where(F.col("distance") <= radius).distinct()
    compared = near.join(cutouts, keys).join(items, "item").select(
        "id", "d1", "d2", F.col("name").alias("item"), F.col("start").alias("word"), "distance",
        weighted_similarity(F.col("hs"), F.col("shingles")).alias("similarity"))
    best = Window.partitionBy("d1", "d2", "item").orderBy(F.desc("similarity"), "word", "distance")
    enough = compared.where(F.col("similarity") >= similarity - 1e-12)
    return enough.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def _slice_of(w: Column, sizes: list[int], none: Column) -> Column:
    cut = none
    for size in sorted(sizes):
        cut = F.when(w["size"] == size, F.slice(F.col(f"hs{size}"), w["start"] + 1, w["length"])).otherwise(cut)
    return cut


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY
) -> DataFrame:
    """`docs` without the documents that hold a window similar to a benchmark item; all columns as they are."""
    found = contaminated(docs, benchmark, text, id_col, similarity=similarity)
    names = [fresh_name("g1"), fresh_name("g2")]
    gone = written(found.select(*[F.col(c).alias(n) for c, n in zip(("d1", "d2"), names)]).distinct(), "contaminated")
    d1, d2 = row_digest(id_col, text)
    return docs.join(gone, (d1 == F.col(names[0])) & (d2 == F.col(names[1])), "left_anti")
