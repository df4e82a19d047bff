"""Shared pieces of the corpus operators: column picking, byte-level tokenising in numpy, checkpoints.

Texts are handled as UTF-8 bytes.  The word classes used by the operators are all byte sets that contain no
UTF-8 continuation or lead byte on the separator side, so cutting bytes is the same as cutting characters.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpoint_dir

U64 = np.uint64
#: Text that a bucket holds, which bounds what a group's function keeps in memory.
BUCKET_BYTES = 4e6
#: Stands for a null id inside numpy arrays: after every real id.
NULL_ID = np.iinfo(np.int64).max

# ---------------------------------------------------------------- DataFrame helpers


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Columns by exact name and first position; other columns, however named, cannot make this ambiguous."""
    at = {new: df.columns.index(old) for new, old in names.items()}
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{i}").alias(new) for new, i in at.items()])


#: Makes an action remove its shuffle files when it is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """Materialise and cut lineage in the shared checkpoint folder, in at most ``files`` files: what is small next to
    the input must not become as many files as there are shuffle partitions.  The shuffles that led to it are removed
    at once.  So is what the driver's JVM holds of the plans before, their generated classes and broadcasts, which
    otherwise stay until its heap is full: an operator of a hundred small jobs grows by some 400 MB."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return (df.coalesce(files) if files else df).checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP, before)
        spark.sparkContext._jvm.System.gc()


#: Text that a batch of rows for Python may hold, and the setting for it.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of about ``BATCH_BYTES``, from now on in this session, unless it names a bound itself.

    Spark's own are 10,000 rows or 64 MB: of texts, some 30 MB for each task, which the JVM holds off its heap in buffers of
    powers of two, grown by copying, and keeps part of; Python holds the batch a second time.  Frames are run after they
    are returned, so the setting stays; it changes no result."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def written(df: DataFrame) -> str:
    """Path of df as Parquet in the shared folder."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4()}.parquet"
    df.write.parquet(path)
    return path


def rewritten(df: DataFrame) -> DataFrame:
    """Written as Parquet to the shared folder and read again."""
    return df.sparkSession.read.parquet(written(df))


def discard(spark: SparkSession, path: str) -> None:
    """Removes what ``written`` wrote, on whatever file system it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str, count: str, total: int, share: int = 256) -> DataFrame:
    """rows joined with table, which has one or few rows for a key and says in ``count`` how many of the ``total`` rows
    hold it.  Keys that hold a ``share``-th of all rows or more, which can only be ``share`` many and are broadcast, are
    dealt to all tasks by the column ``by``, with a copy of their rows of table for each; so no task gets more than its
    part of one key."""
    ways = shuffle_partitions(rows.sparkSession)
    is_hot = F.col(count) * share >= total
    hot = table.where(is_hot).select(F.col(key).alias("_hot")).distinct()
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    dealt = dealt.withColumn("_way", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(by), F.lit(ways))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    copies = table.withColumn("_way", F.explode(F.sequence(F.lit(0), F.when(is_hot, F.lit(ways - 1)).otherwise(F.lit(0)))))
    return dealt.join(copies, [key, "_way"]).drop("_way")


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def files_for(n: float, a_file: float) -> int:
    return max(1, math.ceil(n / a_file))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pow2_at_least(n: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, n))))


def bucketed(docs: DataFrame, n_buckets: int) -> DataFrame:
    """(doc_id, text) with the bucket of the id.  A bucket is a few MB of text and is always the same rows, so a
    later step can send an answer to it and have it recomputed after a loss.  Hot texts or sources do not matter: the id
    decides, and among rows with one id the length; rows without an id are dealt by their text."""
    nameless = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    return docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.octet_length("text"), nameless), F.lit(n_buckets)).cast("int"))


# ---------------------------------------------------------------- numpy: texts to words


def _lut(separators) -> np.ndarray:
    lut = np.ones(256, dtype=bool)
    lut[list(separators)] = False
    return lut


#: Word bytes are all but space and tab to carriage return.
WORD_SPACE = _lut([0x20, *range(0x09, 0x0E)])
#: Word bytes are ASCII letters and digits and everything beyond ASCII.
WORD_ALNUM = _lut([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: An odd 64-bit base and its inverse modulo 2**64, for hashes of substrings from one running sum.
BASE = 0x9E3779B97F4A7C15 | 1
UNBASE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = pow2_at_least(max(n, 1 << 16))
        for name, base in (("up", BASE), ("down", UNBASE)):
            row = np.full(size, base, dtype=U64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False) if not isinstance(column, pa.ChunkedArray) else ids_of(column.combine_chunks() if column.num_chunks != 1 else column.chunk(0))


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


@dataclass
class Words:
    """Words of a run of documents: byte places in data, hash, and for each document the first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # n_docs + 1 places into the arrays above

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(data: np.ndarray, offsets: np.ndarray, word: np.ndarray, lower: bool) -> Words:
    """Words of each document in data[offsets[i]:offsets[i+1]]; none crosses a document's end."""
    if lower:
        data = LOWER[data]
    n, n_docs = len(data), len(offsets) - 1
    inside = word[data]
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = False
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        edges = offsets[1:-1]
        before[edges[edges < n]] = False
        after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, offsets) if n_docs else np.zeros(1, np.int64)
    first[-1] = len(starts)
    return Words(data, starts, ends, span_hashes(data, starts, ends), first)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """64-bit hash of each byte span (equal spans, equal hashes; lengths count, as no digit is 0).

    Spans come in order and do not overlap.  They are taken about ``piece`` bytes at a time, so the running sums, 32 bytes
    for each byte, do not grow with a very long text."""
    out, i = np.empty(len(starts), U64), 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + piece, side="right")))
        n = int(ends[j - 1]) - a
        up, down = powers(n + 1)
        sums = np.empty(n + 1, U64)
        sums[0] = 0
        np.cumsum((data[a : a + n].astype(U64) + U64(1)) * up[:n], out=sums[1:])
        begin = starts[i:j] - a
        out[i:j] = mix((sums[ends[i:j] - a] - sums[begin]) * down[begin])
        i = j
    return out


#: Odd multipliers that make a window's hash depend on the order of its words.
ORDER = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def window_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each document, and n_docs + 1 places of each document's first window."""
    counts = np.maximum(np.diff(words.first) - (n - 1), 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    h = words.hashes
    m = len(h) - (n - 1)
    if m <= 0 or not first[-1]:
        return np.empty(0, U64), first
    total = h[:m] * U64(ORDER[0])
    for i in range(1, n):
        total += (h[i : m + i] << U64(i)) * U64(ORDER[i % 5]) if i > 4 else h[i : m + i] * U64(ORDER[i])
    at = np.repeat(words.first[:-1] - first[:-1], counts) + np.arange(first[-1])
    return mix(total[at]), first


def doc_runs(offsets: np.ndarray, size: int = 1 << 20) -> list[tuple[int, int]]:
    """Runs of documents of about size bytes (a longer document is a run of its own), so arrays stay small."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(max(b, a + 1), n)
        out.append((a, b))
        a = b
    return out


def table(columns: dict, schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: columns[f.name] if isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(columns[f.name], f.type) for f in schema}, schema=schema)


def trim() -> None:
    """Gives freed memory back; Python workers live on between groups, next to the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; the folder can be set by KEYSTRATA_TOKENIZERS."""
    folder = os.environ.get("KEYSTRATA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
