"""Inputs of the queries, derived from the tables that a folder holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import flush
from ..operators.segments import rotate

SEGMENT_BYTES = 16384
EXACT_BYTES = 2048
BLOCK = 1024
SPLIT = 2048


def changelog(spark: SparkSession, folder: str) -> DataFrame:
    """Events as changes of users; errors delete."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    cents = F.round(F.col("value") * 100).cast("long").cast("string")
    value = F.when(F.col("event_type") != "error", F.concat_ws("|", "event_type", cents))
    return events.select(F.col("event_id").alias("seq"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), value.alias("value"))


def orders_log(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as changes of customers; pending ones delete."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    value = F.when(F.col("o_orderstatus") != "P", cents)
    return orders.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"), value.alias("value"))


def segmented(spark: SparkSession, folder: str) -> DataFrame:
    return rotate(changelog(spark, folder), SEGMENT_BYTES)


def runs(spark: SparkSession, folder: str) -> DataFrame:
    return flush(segmented(spark, folder))


def probes(spark: SparkSession, folder: str) -> DataFrame:
    """Every user, and as many keys that are not there."""
    users = changelog(spark, folder).select("key").distinct()
    return users.union(users.select(F.concat(F.lit("none:"), "key")))


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/customer.parquet").select(F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("key"))


def absent(spark: SparkSession, n: int = 20_000) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit("miss:"), F.col("id").cast("string")).alias("key"))
