"""Prefix trie of conversations by a van Emde Boas recursion over the depth.

Sequences are cut at half of a power of two that is longer than all of them. What stands before the cut is named, and the
names are the leaves of an upper trie and the roots of lower forests. Both are smaller problems of one kind, so every
level of the recursion solves all of its problems in one job: a row is (root, segment), and after as many levels as the
longest conversation has binary digits each segment is one turn, an edge of the trie. Blocks of turns are named from
the bottom by their halves, so no task ever holds a conversation: a level needs pairs of rows only.

Totals are grafted upward. First each node gets the total of the block of depths that begins at it, from blocks of
half that height. Then, from the highest cuts to the lowest, the finished totals of the lower roots are added to the nodes
one block above. Each step halves its rows, so all steps together handle as many rows as there are turns, a few times over.

Turns, blocks and prefixes are named by 128 bits (two XXH64 values with different seeds in front).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewaylens.operators.ordered import numbered
from gatewaylens.session import written

WORD = r"[^\x20\x09-\x0D]+"
ROOT = 0  # both halves of the root's name
IDS_PER_PIECE = 50_000  # conversation ids that one row of text holds while they are hashed
TURNS_PER_TASK = 20_000  # a level's tables are written in so many files that this is a task's share of the turns
LEAST_TASKS = 24


def _name(salt: int, *parts: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), F.lit(salt), *parts) for seed in (11, 23)]


def _pair(columns: list[Column], h: str, g: str) -> list[Column]:
    return [columns[0].alias(h), columns[1].alias(g)]


class _Tables:
    """Tables of the levels. Each is at most a few rows for a turn; many tiny partitions would cost a file each, level by level."""

    def __init__(self, turns: int) -> None:
        self.files = max(LEAST_TASKS, -(-turns // TURNS_PER_TASK))

    def written(self, rows: DataFrame, name: str) -> DataFrame:
        return written(rows.coalesce(self.files), name)


def coded_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n, h, g, words): turns numbered from 1 by `turn` (null first), with the name of (role, text) and the words of the text.

    A null role or text counts as empty; rows without a conversation are left out. Turns with one number are ordered by
    name, so rows that repeat one another are turns that repeat one another. Other columns are not read.
    """
    r, t = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), *_pair(_name(1, F.octet_length(r), r, t), "h", "g"),
        F.regexp_count(t, F.lit(WORD)).cast("bigint").alias("words"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("turn").asc_nulls_first(), F.col("h"), F.col("g"), F.col("row")]
    return numbered(rows, ["conv"], order, "n").select("conv", "n", "h", "g", "words")


def rebuilt(coded: DataFrame, shared: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first `shared` turns of conversation `base`, then go on with their own after as many.

    Both are expressions over `conv`; `shared` must be small and bounded. Gives (conv, pos, h, g, words) with `pos` from 0, and
    (conv, length) of every conversation, those without turns included. A base without rows gives no turns.
    """
    own = coded.groupBy("conv").agg(F.max("n").alias("own"))
    own = written(own.select("conv", "own", shared.cast("bigint").alias("shared"), base.alias("base")), "conversations")
    given = F.least("shared", F.coalesce("base_own", F.lit(0).cast("bigint")))
    plan = own.join(own.select(F.col("conv").alias("base"), F.col("own").alias("base_own")), "base", "left").select(
        "conv", "base", "shared", given.alias("given"), (given + F.greatest(F.col("own") - F.col("shared"), F.lit(0))).alias("length"))
    plan = written(plan, "rebuilt")
    most = plan.agg(F.max("given")).first()[0] or 0
    heads = coded.where(F.col("n") <= most).withColumnRenamed("conv", "base").join(plan.select("conv", "base", "given"), "base")
    heads = heads.where("n <= given").select("conv", (F.col("n") - 1).alias("pos"), "h", "g", "words")
    tails = coded.join(plan.select("conv", "shared", "given"), "conv").where("n > shared")
    tails = tails.select("conv", (F.col("n") - 1 - F.col("shared") + F.col("given")).alias("pos"), "h", "g", "words")
    return heads.unionByName(tails), plan.select("conv", "length")


def _blocks(turns: DataFrame, lengths: DataFrame, height: int, tables: _Tables) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Per level the distinct blocks of 2^level turns with their halves; per conversation the node at which it ends, and its one block of the top level."""
    digits = []
    halves: list[DataFrame] = [None]
    current = turns.select("conv", F.col("pos").alias("at"), "h", "g", F.lit(True).alias("whole"))
    for level in range(height + 1):
        if level:
            side = F.col("at") % 2
            first, second = side == 0, side == 1
            joined = current.groupBy("conv", F.shiftright("at", 1).alias("at")).agg(
                *[F.max(F.when(first, F.col(c))).alias(f"{c}1") for c in ("h", "g", "whole")],
                *[F.max(F.when(second, F.col(c))).alias(f"{c}2") for c in ("h", "g", "whole")])
            marks = [F.coalesce(c, F.lit(0).cast("bigint")) for c in ("h2", "g2")]
            name = _name(100 + level, F.col("h1"), F.col("g1"), F.col("h2").isNotNull().cast("int"), *marks)
            current = tables.written(joined.select("conv", "at", *_pair(name, "h", "g"), F.coalesce(F.col("whole1") & F.col("whole2"), F.lit(False)).alias("whole"),
                                                   "h1", "g1", "whole1", "h2", "g2"), "blocks")
            halves.append(current.select("h", "g", "h1", "g1", "whole1", "h2", "g2").distinct())
        # The binary digits of a length are the blocks that make it up.
        digit = current.join(lengths, "conv").where(
            ((F.shiftright("length", level) % 2) == 1) & (F.col("at") == F.shiftright("length", level + 1) * 2))
        digits.append(digit.select("conv", F.lit(-level).alias("level"), "h", "g"))
    rows = digits[0]
    for more in digits[1:]:
        rows = rows.unionByName(more)
    root = F.struct(F.lit(ROOT).cast("bigint").alias("h"), F.lit(ROOT).cast("bigint").alias("g"))

    def step(node: Column, block: Column) -> Column:
        return F.struct(*_pair(_name(7, node["h"], node["g"], block["h"], block["g"]), "h", "g"))

    path = F.sort_array(F.collect_list(F.struct("level", "h", "g")))  # at most one element per level
    ends = rows.groupBy("conv").agg(F.aggregate(path, root, step).alias("end"))
    ends = lengths.join(ends, "conv", "left").select(
        "conv", *[F.coalesce(F.col("end")[c], F.lit(ROOT).cast("bigint")).alias(c) for c in ("h", "g")])
    return halves, ends, current


def _cut(top: DataFrame, halves: list[DataFrame], height: int, tables: _Tables) -> tuple[DataFrame, dict[int, DataFrame], dict[int, DataFrame]]:
    """Edges of the trie, and per level the cut nodes with the root above and with the cut nodes below.

    A problem is (root, segment) with the node at its end (b) where one is cut there, and with the number and the smallest of its conversations.
    """
    problems = top.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("conv").alias("conv")).select(
        F.lit(ROOT).cast("bigint").alias("rh"), F.lit(ROOT).cast("bigint").alias("rg"), "h", "g",
        F.lit(None).cast("bigint").alias("bh"), F.lit(None).cast("bigint").alias("bg"), F.lit(0).cast("bigint").alias("depth"), "n", "conv")
    above, below = {}, {}
    for level in range(height, 0, -1):
        mid = _name(7, F.col("rh"), F.col("rg"), F.col("h1"), F.col("g1"))
        met = problems.join(halves[level], ["h", "g"]).select(
            "rh", "rg", "h1", "g1", "h2", "g2", "bh", "bg", "depth", "n", "conv",
            *[F.when(F.col("whole1"), m).alias(name) for m, name in zip(mid, ("mh", "mg"))])
        met = tables.written(met, "cut")
        upper = met.groupBy("rh", "rg", F.col("h1").alias("h"), F.col("g1").alias("g"), F.col("mh").alias("bh"), F.col("mg").alias("bg"), "depth").agg(
            F.sum("n").alias("n"), F.min("conv").alias("conv"))
        lower = met.where("h2 IS NOT NULL").select(
            F.col("mh").alias("rh"), F.col("mg").alias("rg"), F.col("h2").alias("h"), F.col("g2").alias("g"), "bh", "bg",
            (F.col("depth") + (1 << (level - 1))).alias("depth"), "n", "conv")
        above[level] = met.where("mh IS NOT NULL").select("mh", "mg", "rh", "rg").distinct()
        below[level] = lower.where("bh IS NOT NULL").select("bh", "bg", "rh", "rg")
        problems = upper.unionByName(lower)
    edges = problems.select(F.col("bh").alias("nh"), F.col("bg").alias("ng"), "rh", "rg", (F.col("depth") + 1).alias("depth"), "h", "g",
                            F.col("n").alias("n_convs"), F.col("conv").alias("conv_id"))
    return tables.written(edges, "edges"), above, below


def _graft(values: DataFrame, above: dict[int, DataFrame], below: dict[int, DataFrame], height: int, names: list[str], tables: _Tables) -> DataFrame:
    """(nh, ng, depth) with the sums of `names` over each node's subtree; `values` has the same columns."""
    def gathered(rows: DataFrame) -> DataFrame:
        return rows.groupBy("nh", "ng", "depth").agg(*[F.sum(c).alias(c) for c in names])

    def moved(rows: DataFrame, links: DataFrame, node: tuple[str, str], level: int) -> DataFrame:
        met = rows.join(links.select(F.col(node[0]).alias("nh"), F.col(node[1]).alias("ng"), "rh", "rg"), ["nh", "ng"])
        return met.select(F.col("rh").alias("nh"), F.col("rg").alias("ng"), (F.col("depth") - (1 << (level - 1))).alias("depth"), *names)

    done: dict[int, DataFrame] = {}  # by level: nodes whose depth has so many zero digits, with the total of their block
    current = values
    for level in range(1, height + 1):
        odd = (F.shiftright("depth", level - 1) % 2) == 1
        done[level - 1] = current.where(odd)
        current = tables.written(gathered(current.where(~odd).unionByName(moved(done[level - 1], above[level], ("mh", "mg"), level))), "block-totals")
    finished = current  # the root
    for level in range(height, 0, -1):
        lower = moved(finished, below[level], ("bh", "bg"), level)
        finished = finished.unionByName(tables.written(gathered(done[level - 1].unionByName(lower)), "totals"))
    return finished


def _hashes(ends: DataFrame, tables: _Tables) -> DataFrame:
    """(h, g, ends_sha256): SHA-256 of each node's ending conversations in order.

    Rows are numbered in (node, conversation) order over even chunks and become pieces of text; only the pieces of a node, as a
    stream, pass through one task, since SHA-256 is sequential. Nothing of a node is collected.
    """
    placed = numbered(ends.select("h", "g", "conv"), ["h", "g"], [F.col("conv")], "n")
    piece = F.expr(f"(n - 1) div {IDS_PER_PIECE}")
    pieces = placed.groupBy("h", "g", piece.alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    ordered = pieces.repartition("h", "g").coalesce(tables.files).sortWithinPartitions("h", "g", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, made = None, None, []
        for batch in batches:
            for h, g, ids in zip(batch.column("h").to_pylist(), batch.column("g").to_pylist(), batch.column("ids").to_pylist()):
                if node != (h, g):
                    if node is not None:
                        made.append((*node, digest.hexdigest()))
                    node, digest = (h, g), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if made:
                yield _rows(made)
                made = []
        if node is not None:
            yield _rows([(*node, digest.hexdigest())])

    return ordered.mapInArrow(run, "h long, g long, ends_sha256 string")


def _rows(made: list[tuple[int, int, str]]) -> pa.RecordBatch:
    h, g, text = zip(*made)
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(text)], names=["h", "g", "ends_sha256"])


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations, the empty one (the root) included.

    `turns` has (conv, pos, h, g, words) as `rebuilt` gives them, `lengths` every (conv, length). Columns: conv_id (smallest member),
    depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless nodes of the subtree), saved_tokens (over
    the subtree, (n_convs - 1) times the words of the last text), ends_sha256 (of the members that end here). Without
    conversations there are no rows.
    """
    turns, lengths = written(turns, "turns"), written(lengths, "lengths")
    longest, every = (n or 0 for n in lengths.agg(F.max("length"), F.sum("length")).first())
    height, tables = max(1, int(longest).bit_length()), _Tables(int(every))
    halves, ends, top = _blocks(turns, lengths, height, tables)
    ends = tables.written(ends, "ends")
    edges, above, below = _cut(top, halves, height, tables)
    zero = F.lit(0).cast("bigint")
    root = lengths.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0").select(
        F.lit(ROOT).cast("bigint").alias("nh"), F.lit(ROOT).cast("bigint").alias("ng"), F.lit(None).cast("bigint").alias("rh"),
        F.lit(None).cast("bigint").alias("rg"), zero.alias("depth"), zero.alias("words"), "n_convs", "conv_id")
    words = turns.groupBy("h", "g").agg(F.max("words").alias("words"))
    children = edges.groupBy(F.col("rh").alias("nh"), F.col("rg").alias("ng")).agg(F.count("*").alias("n_children"))
    nodes = edges.join(words, ["h", "g"]).drop("h", "g").unionByName(root).join(children, ["nh", "ng"], "left")
    nodes = tables.written(nodes.withColumn("n_children", F.coalesce("n_children", zero)), "nodes")
    values = nodes.select("nh", "ng", "depth", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
                          ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = _graft(values, above, below, height, ["n_leaves", "saved_tokens"], tables).drop("depth")
    parents = nodes.select(F.col("nh").alias("rh"), F.col("ng").alias("rg"), F.col("conv_id").alias("parent_conv_id"))
    hashed = _hashes(ends, tables).select(F.col("h").alias("nh"), F.col("g").alias("ng"), "ends_sha256")
    found = nodes.join(totals, ["nh", "ng"]).join(parents, ["rh", "rg"], "left").join(hashed, ["nh", "ng"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
