"""In how many documents does each of very many 64-bit keys occur?

Batches of documents send their distinct keys, sorted, 4 bytes each, to the task of the key's range, and get back one
byte a key, in the order they were sent; a repeated computation of the batch can then look its keys up.  Nothing is
kept per document, a hot key costs one entry a batch, and ranges of hashed keys are equally full.

A batch sends at most ``FAN`` rows.  Where there are more ranges than that, it sends to groups of ranges, and a task for
each group of ``FAN`` batches and group of ranges sums their keys up and splits them, again into at most as many rows as
there are ranges in a group; answers go the same way back.  So rows stay in proportion to the input, each with some
dozens of keys, up to FAN * FAN batches and ranges, which is 64 TB of text; a hot key is one entry a group by then.

Keys are told apart by log2(parts) + 32 bits, with parts in proportion to the input, so two keys are taken for one with
a small chance at any size.  Answers are therefore upper bounds, which callers use to discard keys, never to accept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, trim

#: Most rows that a batch, or a group of batches, sends: a power of two.
FAN = 4096
REQUEST = "bucket int, part int, keys binary, counts binary"
ANSWER = "bucket int, part int, classes binary"
_REQUEST = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


@dataclass(frozen=True)
class Ranges:
    """How many ranges of keys there are, and into how many groups they go: both powers of two."""

    parts: int
    groups: int

    @property
    def more(self) -> int:
        """log2 of the ranges in a group."""
        return (self.parts // self.groups).bit_length() - 1

    def short(self, keys: np.ndarray) -> np.ndarray:
        """What tells keys apart: the number of the range, and 32 bits more."""
        return keys >> U64(32 - (self.parts.bit_length() - 1))


def ranges_for(total_bytes: int, least: int) -> Ranges:
    """A range for about 6 MB of text."""
    want, n = max(total_bytes / 6e6, least), 1
    while n < want:
        n *= 2
    return Ranges(n, min(n, FAN))


def _packed(values: np.ndarray) -> bytes:
    """Ascending numbers as their steps, byte by byte."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def _unpacked(blob: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def _split(bucket: int, short: np.ndarray, counts: np.ndarray, first: int, ranges: int, bits: int, kind: type) -> Iterator[dict]:
    """Rows for distinct ascending keys of ``bits`` bits below the number of their range, which is one of ``ranges``
    from ``first`` on."""
    bounds = np.searchsorted(short, (np.arange(ranges + 1, dtype=U64) + U64(first)) << U64(bits))
    low = (short & U64((1 << bits) - 1)).astype(kind)
    for k in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[k], bounds[k + 1]
        yield {"bucket": bucket, "part": first + int(k), "keys": _packed(low[a:b]), "counts": zstandard.ZstdCompressor(level=1).compress(counts[a:b].tobytes())}


def request(bucket: int, keys: np.ndarray, ranges: Ranges) -> Iterator[dict]:
    """Rows for a batch; a key given k times counts as k documents."""
    short = np.sort(ranges.short(keys))
    places = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]])) if len(short) else np.zeros(0, np.int64)
    counts = np.diff(np.append(places, len(short))).astype(np.uint32)
    yield from _split(bucket, short[places], counts, 0, ranges.groups, 32 + ranges.more, np.uint64 if ranges.more else np.uint32)


def request_table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, _REQUEST)


def _rows(t: pa.Table, kind: type) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [_unpacked(x, kind) for x in t["keys"].to_pylist()], [np.frombuffer(zstandard.decompress(x), np.uint32) for x in t["counts"].to_pylist()]


def _answer(t: pa.Table) -> pa.Table:
    keys, counts = _rows(t, np.uint32)
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    group = np.cumsum(new) - 1
    sums = np.bincount(group, weights=np.concatenate(counts)[order]).astype(np.int64)
    classes = np.zeros(len(sums), np.uint8)
    many = sums > 1
    classes[many] = np.floor(np.log2(np.maximum(sums[many] - 1, 1))).astype(np.uint8) + 1
    back = np.empty(len(every), np.uint8)
    back[order] = classes[group]
    pack, at, blobs = zstandard.ZstdCompressor(level=1), 0, []
    for k in keys:
        blobs.append(pack.compress(back[at : at + len(k)].tobytes()))
        at += len(k)
    trim()
    return pa.table({"bucket": t["bucket"], "part": t["part"], "classes": pa.array(blobs, pa.binary())})


def count(requests: DataFrame, ranges: Ranges) -> DataFrame:
    """For each request row the class of each key: 0 for one document, else the bit length of the count less one."""
    more = ranges.more
    if not more:
        return requests.groupBy("part").applyInArrow(_answer, ANSWER)

    def summed(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Keys of each batch; distinct ones of all, and their counts."""
        keys, counts = _rows(t, np.uint64)
        every, which = np.unique(np.concatenate(keys), return_inverse=True)
        return keys, every, np.bincount(which, weights=np.concatenate(counts)).astype(np.uint32)

    def gather(t: pa.Table) -> pa.Table:
        _, every, counts = summed(t)
        first = t["part"][0].as_py() << more
        trim()
        return request_table(list(_split(t["cell"][0].as_py(), every + U64(first << 32), counts, first, 1 << more, 32, np.uint32)))

    def back(t: pa.Table, answers: pa.Table) -> pa.Table:
        keys, every, _ = summed(t)
        blobs = sorted(zip(answers["part"].to_pylist(), answers["classes"].to_pylist(), strict=True))
        classes = np.frombuffer(b"".join(zstandard.decompress(c) for _, c in blobs), np.uint8)
        if len(classes) != len(every):
            raise ValueError("the keys of a group of batches differ from those that were counted")
        pack = zstandard.ZstdCompressor(level=1)
        trim()
        return pa.table({"bucket": t["bucket"], "part": t["part"], "classes": pa.array([pack.compress(classes[np.searchsorted(every, k)].tobytes()) for k in keys], pa.binary())})

    cells = requests.withColumn("cell", F.expr(f"bucket div {ranges.groups}").cast("int"))
    answered = cells.groupBy("cell", "part").applyInArrow(gather, REQUEST).groupBy("part").applyInArrow(_answer, ANSWER)
    answered = answered.select(F.col("bucket").alias("cell"), F.shiftright("part", more).alias("group"), "part", "classes")
    return cells.groupBy("cell", "part").cogroup(answered.groupBy("cell", "group")).applyInArrow(back, ANSWER)


class Answers:
    """Looks keys up in what a batch got back."""

    def __init__(self, table: pa.Table, keys: np.ndarray, ranges: Ranges):
        self.ranges = ranges
        self.short = np.unique(ranges.short(keys))
        rows = sorted(zip(table["part"].to_pylist(), table["classes"].to_pylist(), strict=True))
        self.classes = np.frombuffer(b"".join(zstandard.decompress(c) for _, c in rows), np.uint8)
        if len(self.classes) != len(self.short):
            raise ValueError("the batch's keys differ from those that were counted")

    def of(self, keys: np.ndarray) -> np.ndarray:
        return self.classes[np.searchsorted(self.short, self.ranges.short(keys))]
