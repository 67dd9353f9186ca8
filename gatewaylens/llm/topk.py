"""Exact top-k by inner product: norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets of like length. A query's k-th best score so far, divided by its
own length and that of a bucket's longest vector, is the cosine that a vector of the bucket needs: the bucket's
local threshold. Above 1 the bucket is skipped; a high one prunes by coordinates (what the query's largest
coordinates leave open bounds the rest), a low one by length alone. What remains is multiplied exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatewaylens.llm.common import fresh_name
from gatewaylens.session import written

BUCKET = 2048  # vectors
QUERY_BLOCK = 512  # queries
COORDINATE_FROM = 0.6  # local cosine threshold from which coordinates prune better than lengths
FOCUS = 8  # coordinates
SEEDS = 2  # longest buckets of a dimension that give the first thresholds
EXACT = float(1 << 53)


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null for a vector that is null, or has a null or non-finite one."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(
        vector.isNotNull() & F.coalesce(sound, F.lit(False)),
        F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint")))


def _blobs(vectors: DataFrame, size: int, order: list[Column]) -> DataFrame:
    """Rows (dim, block, longest, ids, data): up to `size` vectors of one dimension, sorted by `order`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, dim, number, task = [], [], None, 0, None

        def block() -> pa.RecordBatch:
            data = np.array(rows, np.int64).reshape(len(rows), dim)
            length = np.sqrt((data.astype(np.float64) ** 2).sum(axis=1)).max() if dim else 0.0
            return pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()), "block": pa.array([(task << 32) + number], pa.int64()),
                "longest": pa.array([float(length)]), "ids": pa.array([ids], pa.list_(pa.int64())),
                "data": pa.array([data.tobytes()], pa.binary())})

        for batch in batches:
            for i, v, t in zip(*(batch.column(c).to_pylist() for c in ("i", "v", "task"))):
                task = t if task is None else task
                if rows and (len(rows) == size or len(v) != dim):
                    yield block()
                    ids, rows, number = [], [], number + 1
                dim = len(v)
                ids.append(i)
                rows.append(v)
        if rows:
            yield block()

    placed = vectors.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select("i", "v", F.spark_partition_id().cast("bigint").alias("task"))
    return placed.mapInArrow(run, "dim int, block bigint, longest double, ids array<bigint>, data binary")


def _long_products(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    exact = rows.astype(object) @ query.astype(object)
    if len(exact) and max(abs(exact.min()), abs(exact.max())) >= 1 << 63:
        raise OverflowError("an inner product does not fit into 64 bits")
    return exact.astype(np.int64)


def _best_of(queries, q_ids, rows, ids, longest, least, k) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query its k best of one bucket that reach its threshold; rows are sorted by length, longest first."""
    q_real, r_real = queries.astype(np.float64), rows.astype(np.float64)
    q_len = np.sqrt((q_real ** 2).sum(axis=1))
    r_len = np.sqrt((r_real ** 2).sum(axis=1))
    small = float(np.abs(q_real).max(initial=0)) * float(np.abs(r_real).max(initial=0)) * max(1, rows.shape[1]) < EXACT
    slack = 1 + 1e-9  # bounds are in doubles; rounding must not cut a true result
    bounded = np.isfinite(least)
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(bounded & (least > 0), least / np.maximum(q_len * longest, 1e-300), -np.inf)
    for n in np.flatnonzero(local <= slack):
        pick = np.arange(len(rows))
        if least[n] > 0 and bounded[n]:
            # By length: rows that are long enough; they come first.
            order_len = np.maximum.accumulate(r_len[::-1])[::-1]
            pick = pick[: np.searchsorted(-order_len, -least[n] / max(q_len[n], 1e-300) / slack, "right")]
            if local[n] >= COORDINATE_FROM and len(pick) > 32 and rows.shape[1] > FOCUS:
                focus = np.argsort(-np.abs(q_real[n]), kind="stable")[:FOCUS]
                part = r_real[np.ix_(pick, focus)] @ q_real[n, focus]
                rest_q = np.sqrt(max(q_len[n] ** 2 - (q_real[n, focus] ** 2).sum(), 0.0))
                rest_r = np.sqrt(np.maximum(r_len[pick] ** 2 - (r_real[np.ix_(pick, focus)] ** 2).sum(axis=1), 0.0))
                pick = pick[part + rest_q * rest_r * slack + 1e-6 * (1 + abs(least[n])) >= least[n]]
        if not len(pick):
            continue
        # Every sum of whole numbers below 2^53 is exact in doubles.
        scores = (r_real[pick] @ q_real[n]).astype(np.int64) if small else _long_products(queries[n], rows[pick])
        own = ids[pick]
        keep = own != q_ids[n]
        if bounded[n]:
            keep &= scores >= least[n]
        scores, own = scores[keep], own[keep]
        if len(scores) > k:
            limit = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = scores >= limit
            scores, own = scores[near], own[near]
        top = np.lexsort((own, -scores))[:k]
        yield np.full(len(top), q_ids[n]), own[top], scores[top]


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """(q, i, score) from rows that hold a block of queries with thresholds and a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at] for c in batch.schema.names}
                dim = row["dim"].as_py()
                q_ids, ids = (np.array(row[c].as_py(), np.int64) for c in ("q_ids", "ids"))
                queries = np.frombuffer(row["q_data"].as_py(), np.int64).reshape(len(q_ids), dim)
                rows = np.frombuffer(row["data"].as_py(), np.int64).reshape(len(ids), dim)
                least = np.full(len(q_ids), -np.inf)
                for one in row["least"].as_py() or []:
                    least[q_ids == one["q"]] = one["least"]
                found = list(_best_of(queries, q_ids, rows, ids, row["longest"].as_py(), least, k))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["q", "i", "score"])

    columns = ["dim", "q_ids", "q_data", "least", "ids", "data", "longest"]
    return pairs.select(*columns).mapInArrow(run, "q bigint, i bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "i")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _met(pairs: DataFrame, blocks: DataFrame, buckets: DataFrame) -> DataFrame:
    """The vectors of each pair of a query block and a bucket, which are paired by their names alone."""
    with_rows = pairs.select("q_block", "block").join(buckets, "block")
    return with_rows.join(blocks.select("q_block", "q_ids", "q_data"), "q_block")


def reachable(heads: DataFrame, buckets: DataFrame) -> DataFrame:
    """Pairs of a query block (dim, q_block, need) and a bucket (dim, block, longest) that can hold a result."""
    return heads.join(buckets, "dim").where(F.col("longest") * (1 + 1e-9) >= F.col("need"))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "vector",
    bucket: int = BUCKET, block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, id, score): the k highest inner products of each query with every other row.

    `vector` holds whole numbers (`quantised` makes them); null vectors and rows with a null id take no part, and
    vectors meet only those of their own dimension. Ties go to the smaller id. Rows with the query's id are its own, and of several
    the smallest vector asks; of other repeated ids each row counts. A query with fewer than k others gets them all. Products must fit into 64 bits.
    """
    sound = vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    length = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    flag = fresh_name("query")
    rows = sound.select(F.col(id_col).cast("bigint").alias("i"), F.col(vector).alias("v"), is_query.alias(flag))
    by_length = [F.size("v"), F.desc(length), F.col("i")]
    buckets = written(_blobs(rows.select("i", "v"), bucket, by_length), "buckets")
    asked = written(rows.where(flag).groupBy("i").agg(F.min("v").alias("v")), "asked")
    blocks = written(
        _blobs(asked, block, [F.size("v"), F.xxhash64("i"), F.col("i")]).select(
            "dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "queries")
    # The longest buckets of each dimension first: their k-th scores are thresholds for all others.
    seeds = buckets.select("dim", "block", "longest").groupBy("dim").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("longest", "block")), asc=False), 1, SEEDS).alias("top"))
    seeds = written(seeds.select("dim", F.explode("top.block").alias("block")), "seeds")
    no_bound = F.lit(None).cast("array<struct<q:bigint,least:double>>")
    heads = blocks.select("dim", "q_block")
    first = _met(heads.join(seeds, "dim"), blocks, buckets).withColumn("least", no_bound)
    started = written(_ranked(_search(first.repartition("q_block", "block"), k), k), "first")
    bounds = started.where(F.col("rank") == k).select(F.col("q"), F.col("score").cast("double").alias("least"))
    place = blocks.select("dim", "q_block", F.explode("q_ids").alias("q"))
    known = place.join(bounds, "q", "left").join(asked.select(F.col("i").alias("q"), F.sqrt(length).alias("norm")), "q")
    bounds = known.where("least IS NOT NULL").groupBy("q_block").agg(F.collect_list(F.struct("q", "least")).alias("least"))
    # A bucket can add to a block only if its longest vector reaches the k-th score of one of its queries (by Cauchy and Schwarz;
    # the factor covers rounding). The other pairs are dropped by these two numbers, before any vector is sent.
    reach = F.when(F.col("least").isNull() | (F.col("norm") == 0), F.lit(float("-inf"))).otherwise(F.col("least") / F.col("norm"))
    heads = written(known.groupBy("dim", "q_block").agg(F.min(reach).alias("need")), "needs")
    others = buckets.select("dim", "block", "longest").join(seeds, ["dim", "block"], "left_anti")
    rest = _met(reachable(heads, others), blocks, buckets).join(bounds, "q_block", "left")
    found = _search(rest.repartition("q_block", "block"), k).unionByName(started.select("q", "i", "score"))
    return _ranked(found, k).select(
        F.col("q").alias("query_id"), "rank", F.col("i").alias(id_col), "score")
