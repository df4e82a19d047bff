"""Schemas, limits and errors of versioned key-value change logs.

A change log is ordered by ``seq`` (unique); a null value is a delete (a tombstone).  Keys and values are byte strings:
BINARY, or STRING where the bytes are valid UTF-8, which order alike."""

from __future__ import annotations

from pyspark.sql import types as T

#: Limits and thresholds of the data model.
MAX_KEY = 128
MAX_VALUE = 4096
MEMTABLE_BYTES = 4 << 20
BLOCK_BYTES = 4096
FILE_BYTES = 64 << 20
COMPACT_TRIGGER = 4
BLOOM_RATE = 0.01
BLOOM_MAX_HASHES = 10


def changelog_schema(kind: T.DataType | None = None) -> T.StructType:
    kind = kind or T.BinaryType()
    return T.StructType([T.StructField("seq", T.LongType(), False), T.StructField("key", kind, False), T.StructField("value", kind, True)])


RUN_SCHEMA = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("seq", T.LongType(), False), T.StructField("value", T.BinaryType(), True)])


class StoreError(Exception):
    """Base of the errors below."""


class NotFound(StoreError):
    """The key has no live value."""


class Closed(StoreError):
    """The store is closed."""


class InvalidValue(StoreError):
    """An empty value, which would read as a delete."""


class TooLarge(StoreError):
    """A key or value beyond the limits."""


class Corrupt(StoreError):
    """Bytes that fail a check."""
