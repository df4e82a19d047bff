"""Byte-level column functions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def octets(c: Column) -> Column:
    """Bytes of a string or binary; null counts as 0."""
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def u32(c: Column) -> Column:
    """Four bytes, the least significant first."""
    part = [F.lpad(F.hex(F.shiftrightunsigned(c.cast("long"), n).bitwiseAND(255)), 2, "0") for n in (0, 8, 16, 24)]
    return F.unhex(F.concat(*part))


def byte_values(c: Column) -> Column:
    """Array of the bytes of a string or binary as numbers."""
    digits = F.hex(c.cast("binary"))
    n = (F.length(digits) / 2).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
