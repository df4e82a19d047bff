"""Writes as rows: puts, deletes, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import MAX_KEY, MAX_VALUE


def put(df: DataFrame, seq: Column, key: Column, value: Column) -> DataFrame:
    """Change-log rows that set keys; a null value is a delete."""
    return df.select(seq.cast("long").alias("seq"), key.alias("key"), value.alias("value"))


def delete(df: DataFrame, seq: Column, key: Column) -> DataFrame:
    return df.select(seq.cast("long").alias("seq"), key.alias("key"), F.lit(None).cast("binary").alias("value"))


def status(key: Column, value: Column) -> Column:
    """ok, or why a write is refused; keys may be empty, values may not, null values are deletes."""
    return (
        F.when(F.octet_length(key) > MAX_KEY, "key_too_large")
        .when(F.octet_length(value) > MAX_VALUE, "value_too_large")
        .when(F.octet_length(value) == 0, "empty_value")
        .otherwise("ok")
    )


def validated(log: DataFrame) -> DataFrame:
    """The log, failing the job on a row that may not be written."""
    verdict = status(F.col("key"), F.col("value"))
    checked = F.when(verdict == "ok", F.col("key")).otherwise(F.raise_error(F.concat(verdict, F.lit(" at seq "), F.col("seq").cast("string"))))
    return log.select("seq", checked.cast(log.schema["key"].dataType).alias("key"), "value")


def record_bytes(key: Column, value: Column) -> Column:
    """What a record adds to a memtable."""
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")
