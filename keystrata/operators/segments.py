"""Cutting a change log into segments (memtables) by size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..model import MEMTABLE_BYTES
from .changelog import record_bytes
from .latest import latest
from .ordering import placed

#: ``rotate_exact``: writes that a range has, at least; the seq of a table without a write; newest versions before a range.
RANGE_ROWS, FRESH = 250_000, (1 << 63) - 1
TAIL = pa.schema({"next": pa.int32(), "seq": pa.int64(), "hash": pa.string(), "k": pa.int64(), "v": pa.int64()})


def running_bytes(log: DataFrame) -> DataFrame:
    """The log with ``bytes`` of each record and ``running``, the sum up to and with it in order of seq.

    Sums go by ranges of seq, so no task sees the whole log, however dense or sparse the numbers are."""
    sized = log.withColumn("bytes", record_bytes(F.col("key"), F.col("value")))
    return placed(sized, "seq", "bytes").drop("place")


def rotate(log: DataFrame, limit: int = MEMTABLE_BYTES) -> DataFrame:
    """The log with its ``segment``: a new one begins wherever the bytes written so far pass a multiple of the limit.

    A deliberate simplification of ``rotate_exact``: it counts every write, not what the memtable keeps."""
    sized = running_bytes(log)
    return sized.withColumn("segment", F.floor((F.col("running") - F.col("bytes")) / limit).cast("long")).drop("running")


def _linked(codes: np.ndarray) -> tuple[list[int], list[int]]:
    """Of each place the one before and the one after with the same code; -1 and the length where there is none."""
    before, after = np.full(len(codes), -1), np.full(len(codes), len(codes))
    order = np.argsort(codes, kind="stable")
    same = np.flatnonzero(codes[order[1:]] == codes[order[:-1]])
    before[order[same + 1]], after[order[same]] = order[same], order[same + 1]
    return before.tolist(), after.tolist()


def _fills(codes: np.ndarray, k: list[int], v: list[int], open_until: int, limit: int) -> list[int]:
    """For a table begun at each place, the place of the write that fills it, or the length if none does.  The first
    ``open_until`` places do not fill one.

    A table begun later holds no more at any write, so it is full no earlier: two places move forward, once over all."""
    before, after = _linked(codes)
    n, last = len(k), open_until - 1
    size, out = sum(k[:open_until]) + sum(v[:open_until]), []
    for begin in range(n):
        while last < n - 1 and (last < begin or size < limit):
            last += 1
            size += v[last] - v[before[last]] if before[last] >= begin else k[last] + v[last]
        out.append(last if last >= begin and size >= limit else n)
        if after[begin] > last:
            size -= k[begin] + v[begin]
    return out


def _columns(*tables: pa.Table) -> tuple[np.ndarray, list[int], list[int], list[int]]:
    """Codes of the keys, seq and the two lengths, each table in order of seq."""
    t = pa.concat_tables([x.select(["seq", "hash", "k", "v"]).sort_by("seq") for x in tables]).combine_chunks()
    codes = pc.index_in(t["hash"], pc.unique(t["hash"])).to_numpy()
    return codes, *(t[c].to_pylist() for c in ("seq", "k", "v"))


def _exits(tail: pa.Table, rows: pa.Table, limit: int) -> tuple[list[int], list[int], list[int]]:
    """(upto, leaves, closed): a range that is entered with a table begun after the ``upto`` before, and not after this
    one, is left with one begun at ``leaves`` after ``closed`` more were full; FRESH is a table without a write."""
    codes, seq, k, v = _columns(tail, rows)
    n, m = len(seq), tail.num_rows
    fills, known, upto, leaves, closed = _fills(codes, k, v, m, limit), {n: (FRESH, 0)}, [], [], []
    for entry in range(m, -1, -1):
        path, at = [], entry
        while at not in known:
            path.append(at)
            if fills[at] == n:
                known[at] = (seq[at], 0)
            else:
                at = fills[at] + 1
        for p in reversed(path):
            if p not in known:
                known[p] = (known[fills[p] + 1][0], known[fills[p] + 1][1] + 1)
        if not upto or known[entry] != (leaves[-1], closed[-1]):
            upto.append(seq[entry] if entry < m else FRESH)
            leaves.append(known[entry][0])
            closed.append(known[entry][1])
    return upto, leaves, closed


def rotate_exact(log: DataFrame, limit: int = MEMTABLE_BYTES) -> DataFrame:
    """Segments as a single writer makes them: the size is that of the memtable, which an overwrite changes by the
    difference, and the table rotates after the write that reaches the limit.

    Where a segment begins depends on where the one before it ended.  So that no task reads the whole log, each range of
    seq first says for every table it may be entered with how it is left: which tables these are is known from the
    newest versions of keys before the range, back to where they would fill a table.  One pass over the ranges then
    finds the table that each is entered with, a few rows a range, and the ranges are cut at the same time.  A task sees
    lengths and a hash of the key only, some 40 bytes a write, of one range and one table."""
    rows = max(RANGE_ROWS, limit // 4)  # some tables a range
    ranged = cut(log.select("seq", "key", "value").repartitionByRange(max(1, -(-log.count() // rows)), "seq").withColumn("range", F.spark_partition_id()))
    key = F.concat(F.xxhash64("key").cast("string"), F.lit("."), F.crc32(F.col("key").cast("binary")).cast("string"))  # 96 bits tell keys apart
    sized = ranged.select("range", F.col("seq").cast("long").alias("seq"), key.alias("hash"), F.octet_length("key").cast("long").alias("k"), F.coalesce(F.octet_length("value"), F.lit(0)).cast("long").alias("v"))

    newest = sized.groupBy("range", "hash").agg(F.max("seq").alias("seq"), F.max_by("k", "seq").alias("k"), F.max_by("v", "seq").alias("v"))
    back = Window.partitionBy("range").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    newest = cut(newest.withColumn("held", F.sum(F.col("k") + F.col("v")).over(back)).withColumn("whole", F.max("held").over(Window.partitionBy("range")) < limit).where(F.col("held") < limit))
    ordered = Window.orderBy("range")
    known = ranged.select("range").distinct().join(newest.select("range", "whole").distinct(), "range", "left").select("range", F.coalesce("whole", F.lit(False)).alias("whole"))
    known = known.select("range", F.lead("range").over(ordered).alias("next"), F.coalesce(F.lead("whole").over(ordered), F.lit(False)).alias("next_whole"))  # a row a range
    newest = newest.join(F.broadcast(known), "range").select("range", "next", "whole", "next_whole", "seq", "hash", "k", "v")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranges in order of which all keys fit one table: what may be in it comes from ranges before as well."""
        held: dict = {}

        def over(at, whole, tail):
            nonlocal held
            held = {h: x for h, x in held.items() if whole and h not in tail} | tail
            size = sum(x[1] + x[2] for x in held.values())
            for h in list(held):
                if size < limit:
                    break
                size -= sum(held.pop(h)[1:])
            if whole and at is not None:
                return pa.RecordBatch.from_pylist([{"next": at, "seq": x[0], "hash": h, "k": x[1], "v": x[2]} for h, x in held.items()], schema=TAIL)
            return pa.RecordBatch.from_pylist([], schema=TAIL)

        current, tail = None, {}
        for batch in batches:
            for r in batch.to_pylist():
                if current is not None and r["range"] != current[0]:
                    yield over(*current[1:], tail)
                    tail = {}
                current = (r["range"], r["next"], r["whole"])
                tail[r["hash"]] = (r["seq"], r["k"], r["v"])
        if current is not None:
            yield over(*current[1:], tail)

    columns = ["next", "seq", "hash", "k", "v"]
    chained = newest.where("whole OR next_whole").drop("next_whole").repartition(1).sortWithinPartitions("range", "seq").mapInArrow(merged, "next int, seq long, hash string, k long, v long")
    tails = cut(newest.where("NOT whole AND next IS NOT NULL").select(*columns).unionByName(chained))

    def exits(rows: pa.Table, tail: pa.Table) -> pa.Table:
        upto, leaves, closed = _exits(tail, rows, limit) if rows.num_rows else ([], [], [])
        at = [rows["range"][0].as_py()] * len(upto) if upto else []
        return pa.table({"range": pa.array(at, pa.int32()), "upto": pa.array(upto, pa.int64()), "leaves": pa.array(leaves, pa.int64()), "closed": pa.array(closed, pa.int64())})

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, segment, done = FRESH, 0, None
        for batch in batches:
            out = []
            for at, upto, leaves, closed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != done and begun <= upto:
                    out.append((at, begun, segment))
                    begun, segment, done = leaves, segment + closed, at
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["range", "begun", "segment"])

    left = sized.groupBy("range").cogroup(tails.groupBy("next")).applyInArrow(exits, "range int, upto long, leaves long, closed long")
    entered = cut(left.repartition(1).sortWithinPartitions("range", "upto").mapInArrow(walk, "range int, begun long, segment long"))  # a row a range

    def starts(rows: pa.Table, tail: pa.Table) -> pa.Table:
        out: list = []
        if rows.num_rows:
            state = tail.filter(pc.is_null(tail["hash"]))
            tail = tail.filter(pc.is_valid(tail["hash"]))
            codes, seq, k, v = _columns(tail, rows)
            n, m, segment = len(seq), tail.num_rows, state["segment"][0].as_py()
            held, size = dict(zip(codes[:m].tolist(), v[:m], strict=True)), sum(k[:m]) + sum(v[:m])
            out.append((seq[m], segment))
            for i, code in enumerate(codes[m:].tolist(), m):
                size += v[i] - held[code] if code in held else k[i] + v[i]
                held[code] = v[i]
                if size >= limit:
                    segment, size, held = segment + 1, 0, {}
                    if i + 1 < n:
                        out.append((seq[i + 1], segment))
        at = [rows["range"][0].as_py()] * len(out) if out else []
        return pa.table({"range": pa.array(at, pa.int32()), "seq": pa.array([x[0] for x in out], pa.int64()), "segment": pa.array([x[1] for x in out], pa.int64())})

    state = entered.select(F.col("range").alias("next"), F.col("begun").alias("seq"), F.lit(None).cast("string").alias("hash"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("v"), "segment")
    inside = tails.join(F.broadcast(entered.select(F.col("range").alias("next"), "begun")), "next").where("seq >= begun").select(*columns, F.lit(None).cast("long").alias("segment"))
    marks = sized.groupBy("range").cogroup(inside.unionByName(state).groupBy("next")).applyInArrow(starts, "range int, seq long, segment long")
    kind = {c: log.schema[c].dataType for c in ("seq", "key", "value")}
    marks = marks.select("range", F.col("seq").cast(kind["seq"]).alias("seq"), *[F.lit(None).cast(kind[c]).alias(c) for c in ("key", "value")], "segment", F.lit(True).alias("mark"))
    both = ranged.select("range", "seq", "key", "value", F.lit(None).cast("long").alias("segment"), F.lit(False).alias("mark")).unionByName(marks)
    found = both.withColumn("segment", F.max("segment").over(Window.partitionBy("range").orderBy("seq")))  # marks of the same seq included
    return found.where("NOT mark").select("seq", "key", "value", "segment")


def memtable_size(log: DataFrame) -> DataFrame:
    """Bytes and keys of each segment's memtable: its newest versions, deletes counting their key."""
    newest = latest(log, "seq", "segment", "key")
    size = record_bytes(F.col("key"), F.col("value"))
    return newest.groupBy("segment").agg(F.sum(size).alias("bytes"), F.count("*").alias("keys"))
