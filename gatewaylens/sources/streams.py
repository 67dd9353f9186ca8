"""File streams and idempotent stream sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewaylens.session import new_path

# Input of one micro-batch. Keyed decisions hold a key's rows of a batch in memory, so theirs is small;
# aggregations combine rows before the shuffle and can take far more at once.
BYTES_PER_BATCH = 1 << 40
BYTES_PER_KEYED_BATCH = 1 << 30


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None,
    bytes_per_batch: int | None = BYTES_PER_BATCH,
) -> DataFrame:
    """Parquet files of a folder (or one table) as a stream; either limit bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    elif bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.parquet(path)


def run_available(stream: DataFrame, mode: str, each, checkpoint: str) -> None:
    """Work through all input there is, in micro-batches, and stop."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(each)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def write_changes(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Keep the changed rows of each micro-batch of an aggregation under the batch's own number.

    A batch that is run again after a failure overwrites its own folder, so repeats change nothing.
    """
    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_available(stream, "update", each, checkpoint)


def latest_rows(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest version of every row written by `write_changes`."""
    values = [c for c in changes.columns if c not in (*keys, "batch")]
    number = F.col("batch").cast("bigint")
    return changes.groupBy(*keys).agg(*[F.max_by(v, number).alias(v) for v in values])


def compact_changes(spark: SparkSession, path: str, target: str, keys: Sequence[str]) -> None:
    """The newest version of every row as a table of its own, under the number of the last batch."""
    changes = spark.read.parquet(path)
    last = changes.agg(F.max(F.col("batch").cast("bigint"))).first()[0]
    latest_rows(changes, keys).write.mode("overwrite").parquet(f"{target}/batch={last}")


def append_decisions(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Rows of a stateful operator to parquet files, each exactly once."""
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def fresh_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """A new output folder and its checkpoint folder."""
    path = new_path(spark, name)
    return f"{path}/rows", f"{path}/checkpoint"
