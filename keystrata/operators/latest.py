"""Newest version of each key, with deletes.

One aggregate does it, with partial results before the shuffle, so a key with a third of all writes sends one row a
task.  ``max_by`` returns the value at the largest order even if that value is null, which is how a delete hides older
versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import placed


def latest(log: DataFrame, order: str = "seq", *keys: str, carry: str | None = None) -> DataFrame:
    """(keys, order, value): the newest row of each key; deletes stay, as null.  ``carry`` names one more of its columns."""
    keys = keys or ("key",)
    more = [F.max_by(carry, order).alias(carry)] if carry else []
    return log.groupBy(*keys).agg(F.max(order).alias(order), F.max_by("value", order).alias("value"), *more)


def live(log: DataFrame, order: str = "seq") -> DataFrame:
    """Keys that have a value."""
    return latest(log, order).where("value IS NOT NULL").select("key", "value")


def deleted(log: DataFrame, order: str = "seq") -> DataFrame:
    return latest(log, order).where("value IS NULL").select("key")


def get(log: DataFrame, key, order: str = "seq") -> DataFrame:
    """No row or one; the filter reaches the scan before the aggregate."""
    return live(log.where(F.col("key") == key), order)


def multi_get(log: DataFrame, probes: DataFrame, order: str = "seq") -> DataFrame:
    """(key, value, found) for each distinct probe; the log is reduced to the probed keys before it is aggregated.

    Spark broadcasts the probes if they are small by its statistics and shuffles both sides if not."""
    wanted = probes.select("key").distinct()
    state = live(log.join(wanted, "key", "left_semi"), order)
    return wanted.join(state, "key", "left").select("key", "value", F.col("value").isNotNull().alias("found"))


def ordered_scan(log: DataFrame, order: str = "seq") -> DataFrame:
    """Live keys with their rank in key order, 1 first."""
    return placed(live(log, order), "key").select("key", "value", F.col("place").alias("rank"))


def live_count(log: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    """Live keys and deletes in each group of runs."""
    newest = latest(log, order, *keys, "key")
    return newest.groupBy(*keys).agg(F.count_if(F.col("value").isNotNull()).alias("live"), F.count_if(F.col("value").isNull()).alias("tombstones"))
