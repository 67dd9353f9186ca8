"""Reading and writing gateway tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gatewaylens.functions import columns as C
from gatewaylens.schemas import REQUEST_LOG


def log_rows(requests: DataFrame) -> DataFrame:
    """Served requests as rows of the log: the key only as its hash, and the date the log is split by."""
    return requests.select(
        "id", C.sha256_hex(C.trimmed(F.col("api_key"))).alias("api_key"), "method", "path", "status", "cache_hit",
        "created_at", F.to_date("created_at").alias("log_date"),
    )


def append_log(rows: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery | None:
    """Append rows of the log to date folders, from a table or (with a checkpoint folder) from a stream.

    Rebalancing by date gives each date few files, and splits a date that holds most of the rows.
    """
    if rows.isStreaming:
        writer = rows.writeStream.format("parquet").partitionBy("log_date").option("path", path)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    rows.hint("rebalance", "log_date").write.mode("append").partitionBy("log_date").parquet(path)
    return None


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log; filters on `log_date` read only the folders of those dates."""
    return spark.read.schema(T.StructType([*REQUEST_LOG.fields, T.StructField("log_date", T.DateType())])).parquet(path)


def write_version(table: DataFrame, root: str, version: int) -> str:
    """A full new state of a small mutable table; readers of older versions are not disturbed."""
    path = f"{root.rstrip('/')}/version={version}"
    table.write.mode("errorifexists").parquet(path)
    return path


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/version={version}")


REPORT_TIMES = {name: "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" for name in ("timestampFormat", "timestampNTZFormat")}


def to_json_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines, written by the tasks that computed it; times keep their microseconds."""
    report.write.mode("overwrite").options(**REPORT_TIMES).json(path)


def read_json_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(**REPORT_TIMES).json(path)


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text log files as one column `line`."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_database_table(
    spark: SparkSession, url: str, table: str, split_column: str | None = None,
    bounds: tuple[int, int] | None = None, parts: int = 16, **options: str,
) -> DataFrame:
    """A database table; with a numeric split column and its bounds it is read in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split_column and bounds:
        reader = reader.options(
            partitionColumn=split_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts)
        )
    return reader.load()


def write_database_table(table: DataFrame, url: str, name: str, **options: str) -> None:
    """Append to a database table; `batchsize` and others go through as options."""
    table.write.format("jdbc").options(url=url, dbtable=name, **options).mode("append").save()
