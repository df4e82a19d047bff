"""One query for each operator.  Each takes (spark, folder) and returns a DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions.hashing import bloom_params_columns
from ..operators import blocks, bloom, latest, runs, segments
from ..operators.changelog import status
from ..sources import runfile, wal
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]


def live_state(spark, d):
    return latest.live(fx.changelog(spark, d))


def live_orders(spark, d):
    return latest.live(fx.orders_log(spark, d))


def put_log(spark, d):
    return fx.changelog(spark, d)


def validate_records(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    key = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    pages = spark.read.parquet(f"{d}/pages.parquet")
    long_key = F.repeat("url", 3)
    rows = docs.select(key.alias("key"), F.col("text").alias("value")).union(pages.select(long_key, F.when(F.col("page_id") % 5 == 0, F.lit("")).otherwise(F.lit("x"))))
    return rows.groupBy(status(F.col("key"), F.col("value")).alias("status")).agg(F.count("*").alias("n"))


def get_point(spark, d):
    return latest.get(fx.changelog(spark, d), "user:7")


def get_miss(spark, d):
    return latest.get(fx.changelog(spark, d), "user:none")


def multi_get(spark, d):
    return latest.multi_get(fx.changelog(spark, d), fx.probes(spark, d))


def deleted_keys(spark, d):
    return latest.deleted(fx.changelog(spark, d))


def live_count(spark, d):
    return latest.live_count(fx.segmented(spark, d), "segment")


def memtable_size(spark, d):
    return segments.memtable_size(fx.segmented(spark, d))


def rotate_segments(spark, d):
    return fx.segmented(spark, d).select("seq", "segment", "bytes")


def rotate_exact(spark, d):
    return segments.rotate_exact(fx.changelog(spark, d), fx.EXACT_BYTES).groupBy("segment").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def memtable_state(spark, d):
    return latest.latest(fx.segmented(spark, d), "seq", "segment", "key")


def flush_runs(spark, d):
    return fx.runs(spark, d)


def run_stats(spark, d):
    return runs.run_stats(fx.runs(spark, d))


def manifest_order(spark, d):
    return runs.manifest_order(fx.runs(spark, d))


def layered_get(spark, d):
    """Each run is a tier, newest first, and a key's value comes with the run that decided."""
    return runs.layered_runs(cut(fx.runs(spark, d)))


def run_get(spark, d):
    return runs.run_get(fx.runs(spark, d), 1, "user:7")


def merge_runs(spark, d):
    return runs.merge(fx.runs(spark, d))


def compact_oldest4(spark, d):
    return runs.compact(fx.runs(spark, d).where("run < 4"))


def _ordered(r: DataFrame) -> list[int]:
    return [x.run for x in runs.manifest_order(r).orderBy("ord").collect()]  # a row for each run: a manifest


def compact_after_state(spark, d):
    """All runs after the oldest four have become one."""
    r = cut(fx.runs(spark, d))
    left, _ = runs.compact_oldest(r, _ordered(r))
    return left.select("run", "key", "value")


def compact_fixpoint(spark, d):
    """All runs once no compaction is due."""
    r = cut(fx.runs(spark, d))
    left, _ = runs.compact_fixpoint(r, _ordered(r))
    return left.select("run", "key", "value")


def block_index(spark, d):
    return blocks.block_index(blocks.with_blocks(fx.runs(spark, d), fx.BLOCK))


def compact_split(spark, d):
    merged = runs.compact(fx.runs(spark, d).where("run < 4"))
    return blocks.split_files(merged, fx.SPLIT).groupBy("file").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n"), F.sum("size").alias("bytes"))


def split_files(spark, d):
    return blocks.split_files(latest.live(fx.changelog(spark, d)), fx.SPLIT).groupBy("file").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("key").alias("min_key"))


def find_block(spark, d):
    index = blocks.block_index(blocks.with_blocks(fx.runs(spark, d), fx.BLOCK))
    return blocks.find_block(index, fx.probes(spark, d))


def bloom_params_query(spark, d):
    counts = fx.customers(spark, d).agg(F.count("*").alias("n")).union(fx.runs(spark, d).groupBy("run").agg(F.count("*").alias("n")).select("n"))
    bits, hashes = bloom_params_columns(F.col("n"))
    return counts.select("n", bits.alias("bits"), hashes.alias("hashes"))


def bloom_hashes(spark, d):
    return bloom.hashes(fx.customers(spark, d))


def bloom_build(spark, d):
    keys = fx.customers(spark, d)
    return bloom.build(keys, keys.count())


def bloom_probe(spark, d):
    keys = fx.customers(spark, d)
    n = keys.count()
    return bloom.probe(bloom.build(keys, n), keys.unionByName(fx.absent(spark)), n)


def bloom_fpr(spark, d):
    keys = fx.customers(spark, d)
    n = keys.count()
    found = bloom.probe(bloom.build(keys, n), keys.unionByName(fx.absent(spark)), n)
    present = F.col("key").startswith("cust:")
    return found.agg(F.count_if(present & ~F.col("may_contain")).alias("false_negatives"), F.count_if(~present & F.col("may_contain")).alias("false_positives"), F.count_if(~present).alias("absent"))


def ordered_scan(spark, d):
    return latest.ordered_scan(fx.changelog(spark, d))


def _segment_name(c):
    return F.when(c == 0, F.lit("active.wal")).otherwise(F.concat(F.lit("active-"), c.cast("string"), F.lit(".wal")))


def wal_segment_order(spark, d):
    names = fx.segmented(spark, d).select("segment").distinct().select(_segment_name(F.col("segment")).alias("path"))
    ts, name = wal.segment_order(F.col("path"), F.lit(None).cast("timestamp"))
    return names.select(name, ts)


def recover_segments(spark, d):
    """State from segments, ordered by their names alone, with the segment that each value comes from."""
    s = fx.segmented(spark, d).withColumn("path", _segment_name(F.col("segment")))
    ts, name = wal.segment_order(F.col("path"), F.lit(None).cast("timestamp"))
    versions = s.select("key", "value", F.struct(ts.alias("ts"), "seq").alias("version"), name)
    return latest.latest(versions, "version", carry="name").where("value IS NOT NULL").select("name", "key", "value")


def wal_encode(spark, d):
    return fx.changelog(spark, d).select("seq", F.hex(wal.encode_column(F.col("key"), F.col("value"))).alias("record"))


def _segments_as_files(spark, d) -> DataFrame:
    """(path, content): the log's segments in binary; a segment is bounded by its limit."""
    s = fx.segmented(spark, d).select(F.col("segment").cast("string").alias("path"), F.struct("seq", F.hex(wal.encode_column(F.col("key"), F.col("value"))).alias("record")).alias("r"))
    joined = s.groupBy("path").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    return joined.select("path", F.unhex(F.array_join(F.col("rs")["record"], "")).alias("content"))


def wal_replay(spark, d):
    rows = wal.replay_column(_segments_as_files(spark, d))
    return rows.select(F.col("path").cast("long").alias("segment"), "pos", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def wal_replay_stats(spark, d):
    """Even segments have a damaged first record, odd ones lack their last byte."""
    files = _segments_as_files(spark, d)
    n = F.octet_length("content")
    flipped = F.concat(F.unhex(F.lit("00000000")), F.expr("substring(content, 5)"))
    damaged = F.when(F.col("path").cast("long") % 2 == 0, flipped).otherwise(F.substring("content", F.lit(1), n - 1))
    stats = wal.replay_stats(files.select("path", damaged.alias("content")))
    return stats.select(F.col("path").cast("long").alias("segment"), "recovered", "skipped")


def block_crc(spark, d):
    decoded = runfile.decode_runs(runfile.encode_runs(fx.runs(spark, d), fx.BLOCK))
    return decoded.groupBy("run", "block").agg(F.max("crc").alias("crc"), F.count("*").alias("n"))


def sst_codec(spark, d):
    decoded = runfile.decode_runs(runfile.encode_runs(fx.runs(spark, d), fx.BLOCK))
    return decoded.select("run", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


NAMED: dict[str, Query] = {
    f.__name__.removesuffix("_query"): f
    for f in (
        live_state, live_orders, put_log, validate_records, get_point, get_miss, multi_get, deleted_keys, live_count, memtable_size, rotate_segments, rotate_exact,
        memtable_state, flush_runs, run_stats, manifest_order, layered_get, run_get, merge_runs, compact_oldest4, compact_after_state, compact_fixpoint, block_index,
        compact_split, split_files, find_block, bloom_params_query, bloom_hashes, bloom_build, bloom_probe, bloom_fpr, ordered_scan, wal_segment_order, recover_segments,
        wal_encode, wal_replay, wal_replay_stats, block_crc, sst_codec,
    )
}
