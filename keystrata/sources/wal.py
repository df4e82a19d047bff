"""Binary write-ahead logs.

A record is, little-endian: CRC-32 of all that follows, key length, value length (0: a delete), key, value.  Replay is
tolerant: a record whose check fails is skipped, and a record that cannot be (too large, or cut short) ends the segment
with what was read so far."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.encoding import u32
from ..model import MAX_KEY, MAX_VALUE, InvalidValue, TooLarge

HEAD = struct.Struct("<III")


def encode(key: bytes, value: bytes | None) -> bytes:
    if len(key) > MAX_KEY or len(value or b"") > MAX_VALUE:
        raise TooLarge("key or value beyond the limits")
    if value == b"":
        raise InvalidValue("an empty value would read as a delete")
    body = struct.pack("<II", len(key), len(value or b"")) + key + (value or b"")
    return struct.pack("<I", zlib.crc32(body)) + body


def encode_column(key: Column, value: Column) -> Column:
    """The same inside the JVM."""
    key, value = key.cast("binary"), F.coalesce(value.cast("binary"), F.unhex(F.lit("")))
    body = F.concat(u32(F.octet_length(key)), u32(F.octet_length(value)), key, value)
    return F.concat(u32(F.crc32(body)), body)


def replay(data: bytes) -> tuple[list[tuple[bytes, bytes | None]], int]:
    """Records in order, and how many were skipped.  A header that is cut short is not counted as skipped."""
    out, skipped, at = [], 0, 0
    while at + HEAD.size <= len(data):
        crc, n_key, n_value = HEAD.unpack_from(data, at)
        end = at + HEAD.size + n_key + n_value
        if n_key > MAX_KEY or n_value > MAX_VALUE or end > len(data):
            skipped += 1
            break
        if zlib.crc32(data[at + 4 : end]) == crc:
            key = data[at + HEAD.size : at + HEAD.size + n_key]
            out.append((key, data[at + HEAD.size + n_key : end] if n_value else None))
        else:
            skipped += 1
        at = end
    return out, skipped


REPLAYED = "path string, pos long, key binary, value binary"


def replay_column(files: DataFrame) -> DataFrame:
    """files (path, content): records with their place in their segment; a segment is a few MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, _ = replay(content or b"")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array([k for k, _ in rows], pa.binary()), pa.array([v for _, v in rows], pa.binary())],
                    ["path", "pos", "key", "value"],
                )

    return files.select("path", "content").mapInArrow(run, REPLAYED)


def replay_stats(files: DataFrame) -> DataFrame:
    """(path, recovered, skipped) of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [replay(c or b"") for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r, _ in found], pa.int64()), pa.array([s for _, s in found], pa.int64())], ["path", "recovered", "skipped"])

    return files.select("path", "content").mapInArrow(run, "path string, recovered long, skipped long")


def read_segments(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, content, order columns) of the log segments that a pattern finds, by any file system Spark knows."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select("path", "content", *segment_order(F.col("path"), F.col("modificationTime")))


def segment_order(path: Column, modified: Column) -> tuple[Column, Column]:
    """(ts, name) to order segments by, oldest first: 0 for active.wal, the number of active-<number>.wal, else the
    time of the file in nanoseconds; equal ones by path."""
    name = F.element_at(F.split(path, "/"), -1)
    number = F.regexp_extract(name, r"^active-([+-]?\d+)\.wal$", 1)
    nanos = F.unix_micros(modified.cast("timestamp")) * 1000
    ts = F.when(name == "active.wal", F.lit(0)).when(number != "", F.coalesce(F.try_to_number(number, F.lit("S9999999999999999999")).cast("long"), nanos)).otherwise(nanos)
    return ts.cast("long").alias("ts"), name.alias("name")


class WalDataSource(DataSource):
    """spark.read.format("keystrata_wal").option("paths", "a.wal,b.wal"): one partition for each segment file.

    For files that the executors can open; ``read_segments`` goes through Spark's own readers."""

    @classmethod
    def name(cls) -> str:
        return "keystrata_wal"

    def schema(self) -> str:
        return REPLAYED

    def reader(self, schema) -> DataSourceReader:
        return _WalReader([p for p in self.options.get("paths", self.options.get("path", "")).split(",") if p])


class _WalReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition):
        with open(partition.value, "rb") as f:
            rows, _ = replay(f.read())
        for pos, (key, value) in enumerate(rows):
            yield partition.value, pos, key, value
