"""Fuzzy line dedup with DataFrame functions only.

Equal lines are one row first. A line's signature is the minima of hashed character shingles; bands of them
bring lines together, the exact Jaccard similarity of all 5-character shingles decides, and a distributed
union-find leaves one line of each component.

The signature of a long line of words samples the shingles by content: those that begin at a word. Short lines and those
whose words are long have all their shingles in it. Lines near the limit between the two carry both, so that two
similar lines always share a kind. Sampling serves the candidates only; the similarity that decides is over all shingles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewaylens.llm.common import fresh_name
from gatewaylens.llm.components import connected_components
from gatewaylens.llm.simhash_dedup import row_digest
from gatewaylens.session import written

SIMILARITY = 0.8
SHINGLE = 5  # characters per shingle of the similarity
SIGNATURE_SHINGLE = 9  # bytes per sampled run of the signature; of those at every place, SHINGLE bytes
BANDS = 12  # each of three minima
SHARED = 2  # bands that similar lines share: a pair at the limit has them with a probability of 0.997, at 0.85 of 0.9998
FIELD = 21  # bits of a shingle's hash that order the shingles for one minimum; three fields a hash
KEY = 40  # bits of a band's name
SAMPLED_FROM = 100  # characters of a line's different words
WHOLE_BELOW = 160
FIRST_WORDS = 40  # of a line, from which it is first tried to tell that it is long
WORDS = 8  # of 64 bits, in which the shingles of a line are marked

_BLANK = " \t\r"


def _hashes(text: Column, size: int = SHINGLE) -> Column:
    """The hashes of the different runs of `size` characters; a shorter text is its own only run.

    A run is cut from the text at four bytes a character, where its place is known: neither a matcher nor a text for each run is needed.
    """
    def of(wide: Column) -> Column:
        last = F.greatest(F.octet_length(wide) - F.lit(4 * size), F.lit(0))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), last + 1, F.lit(4)), lambda at: F.xxhash64(F.substring(wide, at, F.lit(4 * size)))))

    return F.transform(F.array(F.encode(text, "UTF-32")), of)[0]


def jaccard(a: Column, b: Column, size: int = SHINGLE) -> Column:
    """Jaccard similarity of the sets of character shingles (by 64-bit hashes) of two texts that are not empty."""
    left, right = _hashes(a, size), _hashes(b, size)
    # Worked out once each: what an expression names twice inside a lambda is bound to a variable.
    return F.transform(
        F.array(F.struct(left.alias("x"), right.alias("y"))),
        lambda s: F.transform(
            F.array(F.size(F.array_intersect(s["x"], s["y"]))),
            lambda both: both / (F.size(s["x"]) + F.size(s["y"]) - both),
        )[0],
    )[0]


def _sampled(lines: DataFrame) -> DataFrame:
    """(k1, kind, h0): of each line, hashes of runs of bytes that begin at a word, or at every place (kind), or both.

    A line is as long as its different words, since what it repeats adds no shingles. Runs only propose candidates, so they are
    cut from the bytes, where the next one is found without reading the line from its start.
    """
    words = F.split("line", " ")
    # The first words are mostly enough to know that a line is long.
    some, all_of_them = (F.length(F.array_join(F.array_distinct(of), " ")) for of in (F.slice(words, 1, FIRST_WORDS), words))
    length = F.when(F.length("line") < SAMPLED_FROM, F.length("line")).when(some >= WHOLE_BELOW, some).otherwise(all_of_them)
    # Selected first, so that they are worked out once for both kinds.
    sized = lines.select("k1", F.col("line").cast("binary").alias("bytes"), (F.length("line") / F.size(words)).alias("per_word"), length.alias("length"))
    by_word = (F.col("per_word") <= 20) & (F.col("length") >= SAMPLED_FROM)
    by_place = ((F.col("per_word") > 12) | (F.col("length") < WHOLE_BELOW)) & (F.octet_length("bytes") >= SHINGLE)
    kinds = F.when(by_word & by_place, F.array(F.lit(False), F.lit(True))).when(by_word, F.array(F.lit(False))).when(by_place, F.array(F.lit(True)))
    last = F.octet_length("bytes") - F.when(F.col("kind"), SHINGLE - 1).otherwise(0)
    placed = sized.select("k1", "bytes", F.explode(kinds).alias("kind")).select("k1", "bytes", "kind", F.explode(F.sequence(F.lit(1), last)).alias("at"))
    begins = F.col("kind") | (F.col("at") == 1) | (F.substring("bytes", F.col("at") - 1, F.lit(1)) == F.lit(b" "))
    run = F.substring("bytes", F.col("at"), F.when(F.col("kind"), SHINGLE).otherwise(SIGNATURE_SHINGLE))
    return placed.where(begins).select("k1", "kind", F.xxhash64(run).alias("h0"))


def _short(key: Column) -> Column:
    """A key that takes less room in a shuffle; lines that agree in it by chance are candidates more, no similar ones less."""
    return F.shiftrightunsigned(key, 64 - KEY)


def _bands(distinct: DataFrame, bands: int) -> DataFrame:
    """(k1, band): one row for each line, kind and band. Lines stay in the partition that holds them.

    Half a line's key is enough here: lines that agree in it are candidates of each other's mates.
    """
    hashes = _sampled(distinct.select("k1", F.col("best.line").alias("line")))
    # A hash of its own for each band (few shingles, too, are drawn anew), cut into the fields of the band's three minima.
    drawn = hashes.select("k1", "kind", *[F.xxhash64("h0", F.lit(band)).alias(f"h{band}") for band in range(bands)])
    minima = drawn.groupBy("k1", "kind").agg(*[
        F.min(F.shiftrightunsigned(f"h{band}", n * FIELD).bitwiseAND(F.lit((1 << FIELD) - 1)).cast("int")).alias(f"m{n}_{band}")
        for band in range(bands) for n in range(3)
    ])
    keys = [_short(F.xxhash64(F.lit(band), "kind", *[f"m{n}_{band}" for n in range(3)])) for band in range(bands)]
    return minima.select("k1", F.explode(F.array(*keys)).alias("band"))


def _lines(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(id, d1, d2, line_no, line, k1, k2) for each line that is not blank; d1 and d2 stand for id and text."""
    d1, d2 = row_digest(id_col, text)
    # Marked first: what stands beside a generator in one select is worked out again for each of its rows.
    marked = docs.select(F.col(id_col).alias("id"), d1.alias("d1"), d2.alias("d2"), F.split(text, "\n").alias("lines"))
    each = marked.select("id", "d1", "d2", F.posexplode_outer("lines").alias("line_no", "raw"))
    # Only where there is something to cut: that goes through the whole line.
    ends = [end for blank in _BLANK for end in (F.startswith("raw", F.lit(blank)), F.endswith("raw", F.lit(blank)))]
    line = F.when(reduce(Column.__or__, ends), F.btrim("raw", F.lit(_BLANK))).otherwise(F.col("raw"))
    lines = each.select("id", "d1", "d2", "line_no", line.alias("line")).where("line != ''")
    return lines.select("*", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))


def _pairs_of(bands: str, pair) -> Column:
    """`pair` of every two elements of an array."""
    return F.flatten(F.transform(bands, lambda x, at: F.transform(F.slice(bands, at + 2, F.size(bands)), lambda y: pair(x, y))))


def _with_mates(lines: DataFrame) -> DataFrame:
    """Those of the lines (k1, bands, mates) that share SHARED = 2 bands with one and the same line: every two bands of a line are a key.

    Most lines share bands only with lines of which none has two of them.
    """
    keyed = lines.select("k1", F.explode(_pairs_of("bands", lambda x, y: _short(F.xxhash64(x, y)))).alias("key"))
    one = Window.partitionBy("key")
    met = keyed.select("k1", F.min("k1").over(one).alias("low"), F.max("k1").over(one).alias("high")).where("low < high")
    return lines.join(met.select("k1").distinct(), "k1", "left_semi")


def _candidates(lines: DataFrame, bands: int) -> DataFrame:
    """Lines that occur more than once or share bands: (k1, k2, n, best, bands, mates), the text in `best`.

    The distinct lines are shuffled once and read twice: by the signatures, which need no further shuffle,
    and at the end, where only lines with a mate in some band go on.
    """
    place = F.struct("line", F.col("id").isNull().alias("no_id"), "id", "line_no", "d1", "d2")
    distinct = lines.repartition("k1").groupBy("k1", "k2").agg(F.min(place).alias("best"), F.count("*").alias("n"))
    banded = _bands(distinct.where("n > 0"), bands).repartition("band")
    # Bounds of the key rather than a count: a band's rows are sorted once, and most go at once.
    one = Window.partitionBy("band")
    met = banded.select("k1", "band", F.min("k1").over(one).alias("low"), F.max("k1").over(one).alias("high"), F.count("*").over(one).alias("mates"))
    mates = met.where("low < high").groupBy("k1").agg(F.sort_array(F.collect_set("band")).alias("bands"), F.sum("mates").alias("mates"))
    # Both columns are named, so that the two readers of this need the same shuffle.
    mates = _with_mates(mates.where((F.size("bands") >= SHARED) & (F.col("mates") > 1)))
    return distinct.where("n > 0").join(mates, "k1", "left").where("n > 1 OR bands IS NOT NULL")


def _compared(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs of keys; each line's text is fetched by its key."""
    left = lines.select(F.struct("k1", "k2").alias("a"), F.col("line").alias("left"))
    right = lines.select(F.struct("k1", "k2").alias("b"), F.col("line").alias("right"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.select("a", "b", jaccard(F.col("left"), F.col("right")).alias("similarity"))


def _marks(lines: DataFrame) -> DataFrame:
    """(key, shingles, w0 ...): how many distinct shingles a line has, and a bit set for each."""
    each = lines.repartition("key").select("key", F.explode(_hashes(F.col("line"))).alias("h"))
    # Before they are aggregated: the place of a shingle's bit and its word.
    placed = each.select("key", F.expr("shiftleft(1L, CAST(h & 63 AS INT))").alias("bit"), F.expr(f"pmod(h >> 6, {WORDS})").alias("word"))
    words = [F.bit_or(F.when(F.col("word") == n, F.col("bit")).otherwise(F.lit(0))).alias(f"w{n}") for n in range(WORDS)]
    return placed.groupBy("key").agg(F.count("*").alias("shingles"), *words)


def possible(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys that may be similar enough, by a bound that no similar pair fails.

    A bit that is set for one line only stands for a shingle, at least, that the other does not have. So shingles are worked out
    once a line, and most pairs that are not similar need no comparison.
    """
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    texts = lines.select(F.struct("k1", "k2").alias("key"), "line").join(ends, "key", "left_semi")
    marks = written(_marks(texts), "marks")

    def of(side: str) -> DataFrame:
        return marks.select(F.col("key").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in marks.columns[1:]])

    def shared(x: str, y: str) -> Column:
        """The most shingles of x that y can have."""
        alone = [F.bit_count(F.col(f"{x}_w{n}").bitwiseAND(F.bitwise_not(f"{y}_w{n}"))) for n in range(WORDS)]
        return F.col(f"{x}_shingles") - sum(alone[1:], alone[0])

    most = F.least(shared("a", "b"), shared("b", "a"))
    joined = pairs.join(of("a"), "a").join(of("b"), "b")
    return joined.where(most * (1 + similarity) >= similarity * (F.col("a_shingles") + F.col("b_shingles")) - 1e-6).select("a", "b")


def _open(labelled: DataFrame) -> DataFrame:
    """(a, label, b): the stars in which lines of two components meet that share SHARED = 2 bands; b is the star's first line.

    Every two bands of a line are a key, and the star is that of the one whose first line has more mates. So two lines that
    share bands are in one star at least, and a line that shares only one band with each of its mates is in none.
    """
    mark = F.xxhash64("label")
    several = labelled.groupBy("band").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low < high").select("band")
    place = F.struct("band", "weight", "b")
    bands = labelled.join(several, "band").groupBy("a").agg(F.min("label").alias("label"), F.sort_array(F.collect_list(place)).alias("of"))
    top = lambda x, y: F.greatest(F.struct(x["weight"], x["b"]), F.struct(y["weight"], y["b"]))["b"]
    two = _pairs_of("of", lambda x, y: F.struct(F.xxhash64(x["band"], y["band"]).alias("key"), top(x, y).alias("b")))
    keyed = bands.where(F.size("of") >= SHARED).select("a", "label", F.explode(two).alias("two"))
    keyed = keyed.select("a", "label", "two.key", "two.b", mark.alias("mark"))
    one = Window.partitionBy("key")
    met = keyed.select("a", "label", "b", F.min("mark").over(one).alias("low"), F.max("mark").over(one).alias("high"))
    return met.where("low < high").select("a", "label", "b").where("a != b").distinct()


def _stars(open_rows: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """(m, a, b, label, same, apart, shingles, keep, differs): how each line a of a star differs from the star's first line b.

    `differs` are the shingles that only one of the two has, named together with b. `keep` says how many of them, the rarest
    first, hold one at least that a similar line of another component has as well (see `_meeting`).
    """
    left = lines.select(F.struct("k1", "k2").alias("a"), F.col("line").alias("left"))
    right = lines.select(F.struct("k1", "k2").alias("b"), F.col("line").alias("right"))
    sets = open_rows.join(left, "a").join(right, "b").select(
        "a", "b", "label", "same", _hashes(F.col("left")).alias("x"), _hashes(F.col("right")).alias("y"))
    one_sided = sets.select(
        "a", "b", "label", "same", F.size("x").alias("shingles"), F.size("y").alias("of_first"),
        F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("h"))
    part = (1 - similarity) / (1 + similarity)  # similar: no more one-sided shingles than this part of both lines' shingles
    over = F.size("h") - part * (F.col("shingles") + F.col("of_first"))
    # Of what differs, at least so much is common with any similar line, if this line or that one is not similar to the first.
    common = F.when(F.col("apart"), over / (1 + part)).otherwise((F.size("h") + part * (F.col("of_first") - F.col("shingles"))) / 2)
    keep = F.size("h") + 1 - F.greatest(F.ceil(common - 1e-6), F.lit(1))
    marked = one_sided.withColumn("apart", over > 1e-6).withColumn("keep", keep.cast("int"))
    named = F.transform("h", lambda h: F.xxhash64(h, F.col("b.k1"), F.col("b.k2")))
    return marked.select(F.xxhash64("a", "b").alias("m"), "a", "b", "label", "same", "apart", "shingles", "keep", named.alias("differs"))


def _meeting(stars: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of a star's lines that may be similar and are not known to be connected; no similar pair is missing.

    A shingle that x and y differ in is one in which exactly one of them differs from the first line f. So if D(x) are the shingles
    in which x differs from f, x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)|. If one of them is not similar to f, they can
    only be similar if D(x) and D(y) share enough, and so share one of the rarest in each. What is equal in all lines of a large
    group of variants, and what one line has alone, brings nothing together: the pairs follow what lines share beside the first.
    """
    part = (1 - similarity) / (1 + similarity)
    each = stars.select("m", F.explode("differs").alias("h"))
    common = each.select("m", "h", F.count("*").over(Window.partitionBy("h")).alias("n")).where("n > 1")
    ranked = common.groupBy("m").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("ranked"))
    sized = stars.select("m", "apart", "shingles", "keep", F.xxhash64("label").alias("label"), F.size("differs").alias("size"))
    # Those that no other line has come before all others.
    alone = F.col("size") - F.size("ranked")
    kept = sized.join(ranked, "m").select("*", alone.alias("alone")).where("keep > alone")
    places = kept.select("m", "apart", "shingles", "label", "size", "alone", F.posexplode(F.expr("slice(ranked, 1, keep - alone)")).alias("at", "of"))
    places = places.select("m", "apart", "shingles", "label", "size", (F.col("size") - F.col("alone") - F.col("at")).alias("left"), F.col("of.h").alias("h"))
    places = written(places, "places")

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("h", *[F.col(c).alias(f"{name}_{c}") for c in ("m", "apart", "shingles", "label", "size", "left")])

    enough = (F.col("x_size") + F.col("y_size") - part * (F.col("x_shingles") + F.col("y_shingles"))) / 2 - 1e-6
    # At the first that two lines share, what is left of each must be enough. Of two lines that are both apart the pair comes once.
    once = (F.col("x_m") > F.col("y_m")) | ~F.col("y_apart")
    met = side(places.where("apart"), "x").join(side(places, "y"), "h").where(
        (F.col("x_label") != F.col("y_label")) & once & (F.least("x_left", "y_left") >= enough)).select("x_m", "y_m").distinct()
    x, y = stars.select(F.col("m").alias("x_m"), F.col("a").alias("x")), stars.select(F.col("m").alias("y_m"), F.col("a").alias("y"))
    return met.join(x, "x_m").join(y, "y_m").select(F.least("x", "y").alias("b"), F.greatest("x", "y").alias("a")).distinct()


def line_links(candidates: DataFrame, similarity: float = SIMILARITY, compare=_compared) -> DataFrame:
    """(a, b): enough similar pairs to connect all lines that share SHARED bands and are similar, or linked by such.

    First every line of a band is compared with the band's first line, if it shares SHARED bands with it: as many pairs as rows. The
    first is the line that shares bands with most others: of a group of variants one near their middle. What remains are
    pairs of a band whose lines are not yet connected. They are found by the shingles in which both differ from the first
    line, and those are compared that have enough shingles in common by their marks. `compare` gives (a, b, similarity) for pairs of keys.
    """
    lines = candidates.where("bands IS NOT NULL").select("k1", "k2", F.col("best.line").alias("line"), "bands", "mates")
    members = written(lines.select(F.struct("k1", "k2").alias("a"), "mates", "bands", F.explode("bands").alias("band")), "members")
    firsts = members.groupBy("band").agg(F.max(F.struct("mates", "a", "bands")).alias("first"))
    firsts = firsts.select("band", F.col("first.mates").alias("weight"), F.col("first.a").alias("b"), F.col("first.bands").alias("b_bands"))
    with_first = members.join(firsts, "band").where("a != b").select("a", "b", "band", "weight", _mates("bands", "b_bands").alias("near"))
    with_first = written(with_first, "with_first")
    compared = compare(with_first.where("near").select("a", "b").distinct(), lines)
    links = written(compared.where(F.col("similarity") >= similarity).select("a", "b"), "links")
    labels = connected_components(links, "a", "b")
    labelled = with_first.join(labels.select(F.col("node").alias("a"), "component"), "a", "left").select(
        "a", "b", "band", "weight", F.coalesce("component", "a").alias("label"))
    opened = _open(written(labelled, "labelled"))
    firsts_labels = labels.select(F.col("node").alias("b"), "component")
    opened = opened.join(firsts_labels, "b", "left").select("a", "b", "label", (F.col("label") == F.coalesce("component", "b")).alias("same"))
    stars = written(_stars(opened, lines, similarity), "stars")
    also = stars.where("NOT apart AND NOT same").select("a", "b")
    found = compare(possible(_meeting(stars, similarity), lines, similarity), lines).where(F.col("similarity") >= similarity).select("a", "b")
    return links.unionByName(also).unionByName(written(found, "links"))


def _mates(x: str, y: str) -> Column:
    return F.size(F.array_intersect(x, y)) >= SHARED


def repeated_lines(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY, bands: int = BANDS
) -> DataFrame:
    """(d1, d2, removed): the numbers of the lines to drop, for each document that has any."""
    candidates = written(_candidates(_lines(docs, text, id_col), bands), "candidates")
    links = line_links(candidates, similarity)
    labels = connected_components(links, "a", "b")
    keyed = candidates.select(F.struct("k1", "k2").alias("key"), "n", "best")
    placed = keyed.join(labels, keyed["key"] == labels["node"], "left").where("n > 1 OR component IS NOT NULL")
    placed = placed.select("key", F.coalesce("component", "key").alias("component"), F.struct(
        "best.no_id", "best.id", "best.line_no", "best.d1", "best.d2").alias("at"))
    first = placed.groupBy("component").agg(F.min("at").alias("first"))
    keeps = written(placed.join(first, "component").select("key.k1", "key.k2", "first"), "keeps")
    found = _lines(docs, text, id_col).select("k1", "k2", "d1", "d2", "line_no").join(keeps, ["k1", "k2"])
    gone = found.where("NOT (d1 = first.d1 AND d2 = first.d2 AND line_no = first.line_no)")
    return gone.groupBy("d1", "d2").agg(F.collect_set("line_no").alias("removed"))


def dedup_lines(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY, bands: int = BANDS,
    n_removed: str | None = None,
) -> DataFrame:
    """`docs` with one line of each component of similar lines left in `text`.

    A line is what stands between line feeds, without blanks at its ends. The line that stays is the first by
    (id, line number), rows without an id last. Blank lines stay, a null text stays null, and a document all of
    whose lines go keeps an empty text. Rows that agree in id and text are treated alike: they keep the same
    lines. Other columns are not touched; `n_removed` names a further column with the number of lines dropped.
    """
    d1, d2, removed = fresh_name("d1"), fresh_name("d2"), fresh_name("removed")
    gone = written(repeated_lines(docs, text, id_col, similarity, bands).toDF(d1, d2, removed), "removed")
    marks = [c.alias(n) for c, n in zip(row_digest(id_col, text), (d1, d2))]
    joined = docs.select("*", *marks).join(gone, [d1, d2], "left")
    left = F.filter(F.split(text, "\n"), lambda line, n: ~F.array_contains(removed, n))
    joined = joined.withColumn(text, F.when(F.col(removed).isNull(), F.col(text)).otherwise(F.array_join(left, "\n")))
    if n_removed:
        joined = joined.withColumn(n_removed, F.coalesce(F.size(removed), F.lit(0)))
    return joined.select(*[f"`{c}`" for c in docs.columns if c != n_removed], *([n_removed] if n_removed else []))
