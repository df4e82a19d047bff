"""Bloom filters as sets of bit positions, and their use to leave runs out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bloom_bits, bloom_params, fnv1a32, second_hash
from ..model import BLOOM_RATE


def hashes(keys: DataFrame) -> DataFrame:
    return keys.select("key", fnv1a32(F.col("key")).alias("h1"), second_hash(F.col("key")).alias("h2"))


def key_bits(keys: DataFrame, bits: int, n_hashes: int) -> DataFrame:
    h = hashes(keys)
    return h.select("key", F.explode(bloom_bits(F.col("h1"), F.col("h2"), F.lit(bits).cast("long"), F.lit(n_hashes))).alias("bit"))


def build(keys: DataFrame, n: int, rate: float = BLOOM_RATE) -> DataFrame:
    """(bit): the set bits of a filter for n keys."""
    bits, n_hashes = bloom_params(n, rate)
    return key_bits(keys, bits, n_hashes).select("bit").distinct()


def probe(filter_bits: DataFrame, probes: DataFrame, n: int, rate: float = BLOOM_RATE) -> DataFrame:
    """(key, may_contain): no false negatives."""
    bits, n_hashes = bloom_params(n, rate)
    asked = key_bits(probes.select("key").distinct(), bits, n_hashes)
    set_bits = filter_bits.select("bit", F.lit(1).alias("hit"))
    return asked.join(set_bits, "bit", "left").groupBy("key").agg((F.min(F.coalesce("hit", F.lit(0))) == 1).alias("may_contain"))
