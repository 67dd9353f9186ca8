"""Totals that outlive the log: what each batch of requests adds is kept as a delta, and the log may be pruned at any time.

A delta has a row per key and New York date. It lies in a folder under its batch's number, so a batch that runs again replaces its
own delta and counts once. Every `FAN_IN` deltas are merged into one of the next level. A reader folds the fewest folders that make
up all batches: at most `FAN_IN` per level, whatever the number of batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewaylens.functions import columns as C
from gatewaylens.operators.usage import totals_from_daily

FAN_IN = 8
GRAIN = ("api_key", "ny_date")


def deltas(log: DataFrame) -> DataFrame:
    """What rows of the log add, by key and date."""
    return log.groupBy("api_key", C.ny_date(F.col("created_at")).alias("ny_date")).agg(
        F.count("*").alias("requests"), F.count_if("cache_hit").alias("cached"), F.max("created_at").alias("last_used"))


def merged(parts: DataFrame) -> DataFrame:
    """Deltas of any batches as one; the order and the grouping do not matter."""
    return parts.groupBy(*GRAIN).agg(F.sum("requests").alias("requests"), F.sum("cached").alias("cached"), F.max("last_used").alias("last_used"))


def _folder(path: str, level: int, number: int) -> str:
    return f"{path.rstrip('/')}/level={level}/part={number}"


def post(batch: DataFrame, number: int, path: str) -> None:
    """Keeps the delta of batch `number` (from 0, without gaps) and merges each row of FAN_IN that it completes."""
    spark = batch.sparkSession
    deltas(batch).write.mode("overwrite").parquet(_folder(path, 0, number))
    level = 0
    while (number + 1) % FAN_IN == 0:
        parts = [_folder(path, level, n) for n in range(number - FAN_IN + 1, number + 1)]
        number, level = number // FAN_IN, level + 1
        merged(spark.read.parquet(*parts)).write.mode("overwrite").parquet(_folder(path, level, number))


def folders(batches: int, path: str) -> list[str]:
    """The fewest folders that hold the deltas of the first `batches` batches, each once."""
    found, level, count = [], 0, batches
    while count:
        whole = count // FAN_IN * FAN_IN
        found += [_folder(path, level, n) for n in range(whole, count)]
        count, level = count // FAN_IN, level + 1
    return found


def read(spark: SparkSession, batches: int, path: str) -> DataFrame:
    """Requests, hits and last use by key and date over all batches."""
    return merged(spark.read.parquet(*folders(batches, path)))


def key_totals(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("api_key").agg(F.sum("requests").alias("total"), F.sum("cached").alias("cached"), F.max("last_used").alias("last_used"))


def system_totals(ledger: DataFrame) -> DataFrame:
    return totals_from_daily(ledger.groupBy("ny_date").agg(F.sum("requests").alias("requests"), F.sum("cached").alias("cached")))
