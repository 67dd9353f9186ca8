"""The registry of client keys."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewaylens.functions import columns as C


def onboard_keys(plain: DataFrame) -> DataFrame:
    """Register keys in bulk: rows of the registry, one per hash (the lowest id). Of the key only hash, hint and prefix are kept.

    Needs `id, plain_key, rate_text, hc_username, app_name, machine, created_at`.
    """
    key = F.col("plain_key")
    # Hint and prefix follow from the key as the hash does, so they may join the grouping.
    made = plain.select(
        "id", C.sha256_hex(key).alias("key_hash"), C.key_hint(key).alias("key_hint"), C.key_prefix(key).alias("key_prefix"),
        C.rate_or_default(F.col("rate_text")).alias("rate_limit_per_sec"), "hc_username", "app_name", "machine", "created_at",
    )
    carried = ["hc_username", "app_name", "machine", "rate_limit_per_sec", "created_at"]
    first = made.groupBy("key_hash", "key_hint", "key_prefix").agg(
        F.min("id").alias("id"), *[F.min_by(c, "id").alias(c) for c in carried]
    )
    return first.select("id", "key_hash", "key_hint", "key_prefix", *carried, F.lit(False).alias("disabled"))


def mask_collisions(plain: DataFrame) -> DataFrame:
    """How many keys share each masked form."""
    return plain.groupBy(C.mask_key(F.col("plain_key")).alias("masked")).agg(F.count("*").alias("keys"))


def idle_keys(keys: DataFrame, log: DataFrame, since: dt.datetime) -> DataFrame:
    """Ids of keys without a request since a time. The log shrinks to its distinct keys before the join."""
    used = log.where(F.col("created_at") >= C.instant(since)).select("api_key").distinct()
    return keys.select("id", "key_hash").join(used, F.col("key_hash") == F.col("api_key"), "left_anti").select("id")


def disable_keys(keys: DataFrame, ids: DataFrame) -> DataFrame:
    """The registry with the named keys disabled, and which of them were not before."""
    marked = keys.join(ids.select("id").distinct().withColumn("named", F.lit(True)), "id", "left")
    named = F.coalesce("named", F.lit(False))
    return marked.select(
        *[c for c in keys.columns if c != "disabled"],
        (F.col("disabled") | named).alias("disabled"),
        (named & ~F.col("disabled")).alias("newly_disabled"),
    )
