"""Blocks inside a run, and the sparse index over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..model import BLOCK_BYTES, FILE_BYTES
from .changelog import record_bytes
from .ordering import placed

HEADER = 8  # two lengths before each record
#: ``find_block``: probes that are looked up together, rows of the answer that a task is meant to make, most tasks.
CHUNK, TASK_ROWS, MOST_TASKS = 1024, 1_000_000, 4000


def packed(sizes: np.ndarray, limit: int) -> np.ndarray:
    """Greedy packing in order: a record that would pass the limit begins a new block, unless its block is empty."""
    out = np.empty(len(sizes), np.int64)
    block = used = 0
    for i, n in enumerate(sizes.tolist()):
        if used and used + n > limit:
            block, used = block + 1, 0
        out[i] = block
        used += n
    return out


def with_blocks(runs: DataFrame, limit: int = BLOCK_BYTES, header: int = HEADER) -> DataFrame:
    """Runs with the ``block`` of each record in key order.  A run is one group: it came from one memtable, whose size
    is bounded."""
    kind = {f.name: f.dataType.simpleString() for f in runs.schema}

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        return t.append_column("block", pa.array(packed(t["size"].to_numpy(), limit))).select(["run", "key", "value", "size", "block"])

    sized = runs.select("run", "key", "value", (record_bytes(F.col("key"), F.col("value")) + header).alias("size"))
    return sized.groupBy("run").applyInArrow(run, f"run {kind['run']}, key {kind['key']}, value {kind['value']}, size long, block long")


def block_index(blocked: DataFrame) -> DataFrame:
    """(run, block, last_key, n, bytes)."""
    return blocked.groupBy("run", "block").agg(F.max("key").alias("last_key"), F.count("*").alias("n"), F.sum("size").alias("bytes"))


def find_block(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(run, key, block): for every probe and run the first block whose last key is not smaller; -1 if there is none.

    Probes and index entries are ranked together by ranges of keys, so an entry is known by the ranks of the probes that
    it answers: those after the entry before it in its run.  Such spans are cut at every ``CHUNK`` probes and meet the
    chunk's keys, where they are unfolded row by row: a task holds a chunk of keys and no answers.  The answer has a row
    for each probe and run, so its number of rows decides how many tasks share it; chunks that are few are copied for
    as many groups of runs as it takes."""
    entries = index.select(F.col("last_key").alias("key"), "run", F.col("block").cast("long").alias("block"))
    asked = probes.select("key", F.lit(None).cast(index.schema["run"].dataType).alias("run"), F.lit(None).cast("long").alias("block")).distinct()
    ranged = cut(entries.unionByName(asked).repartitionByRange("key").withColumn("range", F.spark_partition_id()))
    asks = F.col("run").isNull()
    n, nulls, n_runs = ranged.agg(F.count_if(asks), F.count_if(asks & F.col("key").isNull()), F.count_distinct("run")).first()
    tasks = min(max(-(-n * n_runs // TASK_ROWS), 1), MOST_TASKS)
    ways = max(1, -(-2 * tasks * CHUNK // max(n, 1))) if tasks > 1 else 1

    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("range").agg(F.count_if(asks).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # a row a range
    here = Window.partitionBy("range").orderBy("key", F.col("run").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)  # a probe before an entry of its key
    ranked = ranged.withColumn("upto", F.count_if(asks).over(here)).join(F.broadcast(offsets), "range").withColumn("upto", F.col("upto") + F.col("before"))

    keys = ranked.where(asks).groupBy(F.expr(f"(upto - 1) div {CHUNK}").alias("chunk"))
    keys = keys.agg(F.sort_array(F.collect_list(F.struct("upto", "key"))).alias("found")).select("chunk", F.col("found")["key"].alias("keys"), F.explode(F.sequence(F.lit(0), F.lit(ways - 1))).alias("way"))

    down = Window.partitionBy("run").orderBy(F.desc("key"), "block")
    own = F.struct(F.lead("upto", 1, nulls).over(down).alias("lo"), F.col("upto").alias("hi"), F.min("block").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("block"))
    rest = [F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), F.lit(-1).cast("long").alias("block")) for lo, hi in ((F.col("upto"), F.lit(n)), (F.lit(0), F.lit(nulls)))]
    spans = ranked.where(~asks).repartition(tasks, "run").select("run", F.when(F.row_number().over(down) == 1, F.array(own, *rest)).otherwise(F.array(own)).alias("spans"))
    spans = spans.select("run", F.inline("spans")).where("lo < hi").withColumn("chunk", F.explode(F.expr(f"sequence(lo div {CHUNK}, (hi - 1) div {CHUNK})")))
    first = F.greatest(F.col("lo") - F.col("chunk") * CHUNK, F.lit(0))
    length = F.least(F.col("hi") - F.col("chunk") * CHUNK, F.lit(CHUNK)) - first
    spans = spans.select("run", "block", "chunk", F.pmod(F.xxhash64("run"), F.lit(ways)).cast("int").alias("way"), first.cast("int").alias("first"), length.cast("int").alias("length"))
    met = spans.repartition(tasks, "chunk", "way").join(keys.repartition(tasks, "chunk", "way"), ["chunk", "way"])
    return met.select("run", F.explode(F.slice("keys", F.col("first") + 1, F.col("length"))).alias("key"), "block")


def split_files(records: DataFrame, limit: int = FILE_BYTES, *carry: str) -> DataFrame:
    """Output files of a large compaction: (key, value, carry, size, file), cut in key order, none over ``limit`` bytes
    unless one record is.

    A new file begins wherever the bytes so far pass a multiple of the limit less the largest record, so running sums by
    ranges of keys say it and no task sees more than a range."""
    sized = records.select("key", "value", *carry, (record_bytes(F.col("key"), F.col("value")) + HEADER).alias("size"))
    rows = placed(sized, "key", "size")
    largest = rows.agg(F.max("size")).first()[0] or 0
    return rows.select("key", "value", *carry, "size", F.expr(f"(running - size) div {max(limit - largest, 1)}").alias("file"))
