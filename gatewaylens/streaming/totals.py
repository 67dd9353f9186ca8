"""Running totals and the live feed over the request-log stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewaylens.operators import tokens, usage
from gatewaylens.sources.streams import latest_rows, run_available, write_changes


def stream_system_totals(log: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """System totals after all input: counts per New York date are the state, so late rows find their date."""
    spark = log.sparkSession
    write_changes(usage.daily_totals(log), path, checkpoint)
    return usage.totals_from_daily(latest_rows(spark.read.parquet(path), ["ny_date"]))


def stream_key_totals(log: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Totals per key after all input; rows of a key are combined before the shuffle of each batch."""
    spark = log.sparkSession
    write_changes(usage.key_totals(log), path, checkpoint)
    return latest_rows(spark.read.parquet(path), ["api_key"])


def stream_recent(log: DataFrame, path: str, checkpoint: str, n: int = 1000) -> DataFrame:
    """The newest n requests: each micro-batch merges its own newest n with those of the batch before.

    The versions are numbered by batch, so a batch that runs again reads the same version and rewrites its own.
    """
    spark = log.sparkSession
    columns = ["id", "api_key", "method", "path", "status", "created_at"]

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.select(*columns)
        if number > 0:
            rows = rows.unionByName(spark.read.parquet(_version(path, number - 1)))
        rows.orderBy(F.desc("id")).limit(n).write.mode("overwrite").parquet(_version(path, number))
        last.append(number)

    last: list[int] = []
    run_available(log, "append", each, checkpoint)
    if last:
        return spark.read.parquet(_version(path, last[-1]))
    kept = spark.read.parquet(path)
    return kept.where(F.col("version") == kept.select(F.max("version")).scalar()).drop("version")


def _version(path: str, number: int) -> str:
    return f"{path}/version={number}"


def stream_token_status(events: DataFrame, pool: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Token states after all events: the last changing event and the refusals per token are the state."""
    spark: SparkSession = events.sparkSession
    write_changes(tokens.status_changes(events), path, checkpoint)
    return tokens.status_from_changes(latest_rows(spark.read.parquet(path), ["token_id"]), pool)
