"""Hashes of keys for Bloom filters: 32-bit FNV-1a, and CRC-32 made odd."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import BLOOM_MAX_HASHES, BLOOM_RATE
from .encoding import byte_values

#: Offset basis and prime of 32-bit FNV.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
LOW32 = 4294967295


def fnv1a32(key: Column) -> Column:
    """32-bit FNV-1a as a long; products stay below 2**57, so ANSI arithmetic is safe."""
    return F.aggregate(byte_values(key), F.lit(FNV_OFFSET).cast("long"), lambda h, b: (h.bitwiseXOR(b) * FNV_PRIME).bitwiseAND(LOW32))


def second_hash(key: Column) -> Column:
    return F.crc32(key.cast("binary")).bitwiseOR(F.lit(1).cast("long"))


def bloom_params(n: int, rate: float = BLOOM_RATE) -> tuple[int, int]:
    """Bits (a multiple of 8) and hashes for n keys; no keys count as one, an odd rate as one in a hundred."""
    n = max(n, 1)
    rate = rate if 0 < rate < 1 else 0.01
    bits = -(-int(-n * math.log(rate) / math.log(2) ** 2) // 8) * 8
    return max(bits, 8), min(max(int(bits / n * math.log(2)), 1), BLOOM_MAX_HASHES)


def bloom_params_columns(n: Column, rate: float = BLOOM_RATE) -> tuple[Column, Column]:
    """The same from a column of key counts."""
    n = F.greatest(n.cast("double"), F.lit(1.0))
    raw = F.floor(-n * math.log(rate) / (math.log(2) * math.log(2)))
    bits = F.greatest((F.ceil(raw / 8) * 8).cast("long"), F.lit(8).cast("long"))
    hashes = F.least(F.greatest(F.floor(bits / n * math.log(2)), F.lit(1)), F.lit(BLOOM_MAX_HASHES)).cast("int")
    return bits, hashes


def bloom_bits(h1: Column, h2: Column, bits: Column, hashes: Column) -> Column:
    """Array of the bit positions of a key."""
    i = F.sequence(F.lit(0), hashes - 1)
    return F.transform(i, lambda k: (h1 + k * h2).bitwiseAND(F.lit(LOW32)) % bits)
