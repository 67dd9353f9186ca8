"""What a sweep moves beside its rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from gatewaylens.operators import sweep


def test_a_skyline_comes_with_a_chunk_and_not_with_each_of_its_rows(spark):
    probes = spark.range(400).select("id", F.lit("k").alias("name"), F.timestamp_micros(F.col("id") * 10 + 5).alias("at"))
    spans = spark.range(60).select("id", F.lit("k").alias("name"), F.timestamp_micros(F.col("id") * 10).alias("begin"), F.array(-F.col("id")).alias("rank"))
    found = sweep.best_live(
        probes, spans, lambda: F.col("name"), "at", F.col("begin"), F.timestamp_micros(5000 - F.col("id") * 7), F.col("rank"), F.struct("id"), "best", 4)
    joined = found._jdf.queryExecution().analyzed().toString().split("Join LeftOuter", 1)[1].split("\n", 1)[0]
    assert "pos#" in joined and "chunk#" not in joined  # the place of a chunk's first row
    rows = found.collect()
    assert len(rows) == 400
    for row in rows:
        live = [n for n in range(60) if n * 10 < row["id"] * 10 + 5 < 5000 - n * 7]
        assert (row["best"]["id"] if row["best"] else None) == (min(live) if live else None)


def test_ranks_of_all_kinds():
    assert sweep._ranks(pa.array([[3, -1], [2, 5]])) == [(3, -1), (2, 5)]
    assert sweep._ranks(pa.array([[9], [3, -1], [2, 5]])[1:]) == [(3, -1), (2, 5)]
    assert sweep._ranks(pa.array([[3], [2, 5]])) == [(3,), (2, 5)]
    assert sweep._ranks(pa.array([7, 1])) == [7, 1]
    assert sweep._ranks(pa.array(["b", "a"])) == ["b", "a"]
    assert sweep._ranks(pa.array([], pa.list_(pa.int64()))) == []


def test_a_chunk_closes_with_the_spans_that_live_on():
    columns = {"chunk": [4] * 5, "key_": ["a", "b", "b", "b", "b"], "at_": [1, 2, 3, 4, 9], "end_": [99, 8, 50, 40, None],
               "rank_": [[9], [8], [1], [2], None], "load_": ["x", "gone", "long", "best", None]}
    batch = pa.RecordBatch.from_pydict(columns)
    kinds = {"place": pa.int64(), "first_key": pa.string(), "last_key": pa.string(), "single": pa.bool_(), "newest": pa.int64(),
             "ranks": pa.list_(pa.list_(pa.int64())), "ends": pa.list_(pa.int64()), "loads": pa.list_(pa.string())}
    for cut in range(6):
        (closed,) = sweep._closing(iter([batch.slice(0, cut), batch.slice(cut)]), pa.schema(kinds))
        (row,) = closed.to_pylist()
        assert row == {"place": 4, "first_key": "a", "last_key": "b", "single": False, "newest": 9,
                       "ranks": [[1], [2]], "ends": [50, 40], "loads": ["long", "best"]}
