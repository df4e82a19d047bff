"""Sorted runs: flush, layered reads, merge and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import COMPACT_TRIGGER
from .latest import latest


def flush(segmented: DataFrame) -> DataFrame:
    """(run, key, seq, value): the newest version of each key in each segment; deletes stay."""
    return latest(segmented, "seq", "segment", "key").select(F.col("segment").alias("run"), "key", "seq", "value")


def run_stats(runs: DataFrame) -> DataFrame:
    """What a manifest says of each run."""
    return runs.groupBy("run").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("value").isNull()).alias("n_tombstones"),
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.max("seq").alias("max_seq"),
    )


def manifest_order(runs: DataFrame) -> DataFrame:
    """Runs oldest first.  Order is by the newest write, so publishing a run twice cannot move it."""
    newest = runs.groupBy("run").agg(F.max("seq").alias("max_seq"))  # a row for each run
    return newest.select((F.row_number().over(Window.orderBy("max_seq")) - 1).cast("long").alias("ord"), "run", "max_seq")


def merge(runs: DataFrame, order: str = "run", carry: str | None = None) -> DataFrame:
    """(key, run, value): the newest run's version of each key, with its ``carry`` if named; deletes stay."""
    return latest(runs, order, carry=carry).select("key", order, "value", *([carry] if carry else []))


def layered_get(*tiers: DataFrame) -> DataFrame:
    """(key, value, tier) of live keys over tiers, newest first, each with unique keys: the first tier that holds a key
    decides, also when it holds a delete; ``tier`` is its place.  All tiers are read at once; one aggregate takes the
    place of the cascade.  Each tier is a plan of its own: runs of one table go to ``layered_runs``."""
    ranked = [t.select("key", "value", F.lit(-k).alias("tier")) for k, t in enumerate(tiers)]
    stack = ranked[0]
    for t in ranked[1:]:
        stack = stack.unionByName(t)
    return latest(stack, "tier").where("value IS NOT NULL").select("key", "value", (-F.col("tier")).alias("tier"))


def layered_runs(runs: DataFrame) -> DataFrame:
    """(key, value, run) of live keys over all runs as tiers: the newest run that holds a key decides, also when it holds
    a delete.

    A run's place in the manifest is a column, so the plan is the same for any number of runs; the manifest, a row for
    each run, goes to all tasks."""
    ranked = runs.join(F.broadcast(manifest_order(runs).select("run", "ord")), "run")
    return latest(ranked, "ord", carry="run").where("value IS NOT NULL").select("key", "value", F.col("run").cast("long").alias("run"))


def run_get(runs: DataFrame, run: int, key) -> DataFrame:
    """What one run says of a key: no row, a value, or a delete (null)."""
    return runs.where((F.col("run") == run) & (F.col("key") == key)).select("key", "value")


def compact(inputs: DataFrame, holds_oldest: bool = True, carry: str | None = None) -> DataFrame:
    """(key, run, value): one run from several, newest version first.  Deletes go only if nothing older is left that
    they hide: if the inputs hold the oldest run."""
    merged = merge(inputs, carry=carry)
    return merged.where("value IS NOT NULL") if holds_oldest else merged


def compact_oldest(runs: DataFrame, ordered: list[int], trigger: int = COMPACT_TRIGGER) -> tuple[DataFrame, list[int]]:
    """Replaces the oldest ``trigger`` runs (ordered: oldest first) by one, which keeps the number of its newest input.
    Fewer runs stay as they are."""
    if len(ordered) < trigger:
        return runs, ordered
    inputs, rest = ordered[:trigger], ordered[trigger:]
    merged = compact(runs.where(F.col("run").isin(inputs)).select("run", "key", "value"))
    out = merged.select(F.lit(inputs[-1]).cast("long").alias("run"), "key", "value")
    return out.unionByName(runs.where(F.col("run").isin(rest)).select(F.col("run").cast("long"), "key", "value")), [inputs[-1], *rest]


def compact_fixpoint(runs: DataFrame, ordered: list[int], trigger: int = COMPACT_TRIGGER) -> tuple[DataFrame, list[int]]:
    """Compacts until fewer than ``trigger`` runs are left.

    Oldest-first merging round by round gives the same content as merging once what the rounds would merge: with n
    runs the last round ends after the first n - ((n - 1) mod (trigger - 1)) of them.  So one aggregate does it."""
    n = len(ordered)
    if n < trigger:
        return runs, ordered
    merged = n - (n - 1) % (trigger - 1)
    inputs, rest = ordered[:merged], ordered[merged:]
    one = compact(runs.where(F.col("run").isin(inputs)).select("run", "key", "value"))
    out = one.select(F.lit(inputs[-1]).cast("long").alias("run"), "key", "value")
    return out.unionByName(runs.where(F.col("run").isin(rest)).select(F.col("run").cast("long"), "key", "value")), [inputs[-1], *rest]
