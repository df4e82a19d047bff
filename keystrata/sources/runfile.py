"""Binary run files: blocks, index, Bloom filter, footer.

Blocks hold records (key length, value length, key, value) in key order, each block with its length and CRC-32 before
it; files of the first version have bare blocks.  The index has the last key and offset of each block.  All integers are
little-endian.  Parquet is the engine's own run format; this one is for files that come from or go elsewhere."""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.hashing import FNV_OFFSET, FNV_PRIME, LOW32, bloom_params
from ..model import BLOCK_BYTES, BLOOM_MAX_HASHES, MAX_KEY, MAX_VALUE, Corrupt

#: Footer marks of the two versions, and the flag for double hashing.
MAGIC = 0x53494C544B5632
MAGIC_V1 = 0x53494C544B56
DOUBLE_HASH = 1 << 31
FOOTER = struct.Struct("<qqqq")


def fnv1a32(key: bytes) -> int:
    h = FNV_OFFSET
    for b in key:
        h = (h ^ b) * FNV_PRIME & LOW32
    return h


class Bloom:
    """A filter over keys; ``double`` is False for old filters, which test one hash."""

    def __init__(self, bits: int, hashes: int, data: bytearray, double: bool = True):
        self.bits, self.hashes, self.data, self.double = bits, hashes, data, double

    @classmethod
    def of(cls, keys: list[bytes], rate: float = 0.01) -> Bloom:
        bits, hashes = bloom_params(len(keys), rate)
        out = cls(bits, hashes, bytearray((bits + 7) // 8))
        for k in keys:
            for p in out.places(k):
                out.data[p >> 3] |= 1 << (p & 7)
        return out

    def places(self, key: bytes) -> Iterator[int]:
        first, step = fnv1a32(key), zlib.crc32(key) | 1
        for i in range(self.hashes if self.double else 1):
            yield ((first + i * step) & LOW32) % self.bits

    def may_contain(self, key: bytes) -> bool:
        return all(self.data[p >> 3] >> (p & 7) & 1 for p in self.places(key))

    def dump(self) -> bytes:
        return struct.pack("<II", self.bits, self.hashes | (DOUBLE_HASH if self.double else 0)) + bytes(self.data)

    @classmethod
    def load(cls, data: bytes) -> Bloom:
        if len(data) < 8:
            raise Corrupt("Bloom filter cut short")
        bits, coded = struct.unpack_from("<II", data)
        hashes, size = coded & ~DOUBLE_HASH, (bits + 7) // 8
        if not bits or not hashes or hashes > BLOOM_MAX_HASHES or len(data) < 8 + size:
            raise Corrupt("odd Bloom filter")
        return cls(bits, hashes, bytearray(data[8 : 8 + size]), bool(coded & DOUBLE_HASH))


def _record(key: bytes, value: bytes | None) -> bytes:
    return struct.pack("<II", len(key), len(value or b"")) + key + (value or b"")


def blocks_of(records: list[tuple[bytes, bytes | None]], limit: int = BLOCK_BYTES) -> list[tuple[bytes, bytes]]:
    """(last key, payload) of each block."""
    out: list[tuple[bytes, bytes]] = []
    for key, value in records:
        r = _record(key, value)
        if out and len(out[-1][1]) + len(r) <= limit:
            out[-1] = (key, out[-1][1] + r)
        else:
            out.append((key, r))
    return out


def dump(records: list[tuple[bytes, bytes | None]], limit: int = BLOCK_BYTES, framed: bool = True) -> bytes:
    """A run file of records with unique keys in order."""
    body, index = b"", []
    for last, payload in blocks_of(records, limit):
        index.append(struct.pack("<I", len(last)) + last + struct.pack("<q", len(body)))
        body += (struct.pack("<II", len(payload), zlib.crc32(payload)) if framed else b"") + payload
    listed = struct.pack("<I", len(index)) + b"".join(index)
    bloom = Bloom.of([k for k, _ in records]).dump()
    at = len(body)
    return body + listed + bloom + FOOTER.pack(at + len(listed), at, len(listed), MAGIC if framed else MAGIC_V1)


class RunFile:
    """A run file's parts, checked when opened; blocks are checked when read."""

    def __init__(self, data: bytes):
        if len(data) < FOOTER.size:
            raise Corrupt("no footer")
        self.data = data
        bloom_at, index_at, index_size, magic = FOOTER.unpack(data[-FOOTER.size :])
        end = len(data) - FOOTER.size
        if magic not in (MAGIC, MAGIC_V1):
            raise Corrupt("odd footer mark")
        if index_at < 0 or index_size < 0 or bloom_at < 0 or index_at + index_size != bloom_at or bloom_at > end:
            raise Corrupt("odd offsets")
        self.framed, self.index_at = magic == MAGIC, index_at
        self.last_keys, self.offsets = self._index(data[index_at:bloom_at])
        self.bloom = Bloom.load(data[bloom_at:end]) if bloom_at < end else None

    @staticmethod
    def _index(data: bytes) -> tuple[list[bytes], list[int]]:
        keys, offsets, at = [], [], 4
        if not data:
            return keys, offsets
        if len(data) < 4:
            raise Corrupt("index cut short")
        for _ in range(struct.unpack_from("<I", data)[0]):
            if at + 4 > len(data):
                raise Corrupt("index cut short")
            n = struct.unpack_from("<I", data, at)[0]
            if n > MAX_KEY or at + 12 + n > len(data):
                raise Corrupt("index cut short")
            keys.append(data[at + 4 : at + 4 + n])
            offsets.append(struct.unpack_from("<q", data, at + 4 + n)[0])
            at += 12 + n
        return keys, offsets

    def payload(self, block: int) -> bytes:
        a, b = self.offsets[block], self.offsets[block + 1] if block + 1 < len(self.offsets) else self.index_at
        raw = self.data[a:b]
        if not 0 <= a <= b <= self.index_at:
            raise Corrupt("block out of bounds")
        if not self.framed:
            return raw
        if len(raw) < 8:
            raise Corrupt("block cut short")
        n, crc = struct.unpack_from("<II", raw)
        if n != len(raw) - 8 or zlib.crc32(raw[8:]) != crc:
            raise Corrupt("block check failed")
        return raw[8:]

    def records(self) -> Iterator[tuple[bytes, bytes | None]]:
        for block in range(len(self.offsets)):
            yield from self._of(self.payload(block))

    @staticmethod
    def _of(payload: bytes) -> Iterator[tuple[bytes, bytes | None]]:
        at = 0
        while at < len(payload):
            if at + 8 > len(payload):
                raise Corrupt("record cut short")
            n, m = struct.unpack_from("<II", payload, at)
            if n > MAX_KEY or m > MAX_VALUE or at + 8 + n + m > len(payload):
                raise Corrupt("odd record")
            yield payload[at + 8 : at + 8 + n], payload[at + 8 + n : at + 8 + n + m] if m else None
            at += 8 + n + m

    def get(self, key: bytes) -> tuple[bool, bytes | None]:
        """(found, value or None for a delete)."""
        if self.bloom and not self.bloom.may_contain(key):
            return False, None
        block = bisect.bisect_left(self.last_keys, key)
        if block == len(self.last_keys):
            return False, None
        for k, v in self._of(self.payload(block)):
            if k >= key:
                return k == key, v if k == key else None
        return False, None


def encode_runs(runs: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """runs (run, key, value): (run, content), one file each; a run is as large as a memtable."""

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        rows = list(zip((k.encode() if isinstance(k, str) else k for k in t["key"].to_pylist()), (v.encode() if isinstance(v, str) else v for v in t["value"].to_pylist()), strict=True))
        return pa.table({"run": t["run"][:1], "content": pa.array([dump(rows, limit)], pa.binary())})

    return runs.select("run", "key", "value").groupBy("run").applyInArrow(one, "run long, content binary")


def decode_runs(files: DataFrame) -> DataFrame:
    """files (run, content): (run, block, key, value, crc of the block); a damaged file fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f, out = RunFile(content), []
                for block in range(len(f.offsets)):
                    payload = f.payload(block)
                    out += [(number, block, k, v, zlib.crc32(payload)) for k, v in f._of(payload)]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["run", "block", "key", "value", "crc"])

    return files.select("run", "content").mapInArrow(run, "run long, block long, key binary, value binary, crc long")
