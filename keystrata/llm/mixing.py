"""Mixing sources to target weights by balanced (cube-method) sampling.

A document of a source whose target is r times its size is taken floor(r) times, and once more with probability
r - floor(r).  Those probabilities are not drawn one by one: the flight phase of the cube method takes three undecided
documents at a time and moves their probabilities along the one direction that keeps both the expected number of words
and the expected number of documents, until one of them is 0 or 1.  At most two documents of a group stay undecided.

Groups are slices of a source, dealt by the document's id, so a source with a third of all rows is many groups.  The
undecided rest of a group goes on to the next round, where groups of one source merge by a fan-in of 64, until each
source is one group.  Flights leave a few documents of every size alone; with the last two undecided ones they are the
landing problem, at most 66 documents a source, which go from large to small and each bring the words nearer to the
target.

Sources may be as many as they like: their order, weights and targets are DataFrames.
"""

from __future__ import annotations

import hashlib
import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import placed
from . import common as C

WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9


@dataclass
class Targets:
    """(source, rows, source_size, target) of each source; how many sources and rows there are, and rows of the largest."""

    table: DataFrame
    sources: int
    rows: int
    most: int

    def joined(self, rows: DataFrame, small: int = 100_000, share: int = 1000) -> DataFrame:
        """rows (with a source) and their source's columns.

        Up to ``small`` sources are broadcast.  Of more, those that hold a thousandth of all rows or more (a thousand of
        them at most) are; the others have no hot key and are joined by a shuffle."""
        own = self.table.withColumnRenamed("source", "_source")
        same = F.col("source").eqNullSafe(F.col("_source"))
        if self.sources <= small:
            return rows.join(F.broadcast(own), same).drop("_source")
        is_hot = F.col("rows") * share >= self.rows
        hot = F.broadcast(own.where(is_hot))
        cold = rows.join(hot, same, "left_anti").join(own.where(~is_hot), same)
        return rows.join(hot, same).unionByName(cold).drop("_source")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> Targets:
    """Targets of sources by code point, null last; weights repeat in that order.

    All sizes are shared by weight, no source getting more than ``cap`` times its own; the excess goes to the others by
    weight, again and again: each round is one aggregate, and its sums are whole numbers, so reruns agree."""
    own = C.cut(sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size")), 8)
    named = placed(own.where("source IS NOT NULL"), "source")
    last = own.where("source IS NULL").withColumn("place", F.lit(own.count()).cast("long"))  # of distinct sources
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = C.cut(named.unionByName(last).select("source", "rows", "source_size", weight.alias("weight")), 8)
    sums = table.agg(F.count("*").alias("sources"), F.sum("rows").alias("rows"), F.max("rows").alias("most"), F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level, capped = (sums["size"] or 0) / (sums.weight or 1), 0
    while True:
        full = F.col("weight") * F.lit(level) > cap * F.col("source_size")
        now = table.where(full).agg(F.count("*").alias("n"), F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
        if now.n in (capped, sums.sources):
            break
        level, capped = (sums["size"] - cap * now["size"]) / (sums.weight - now.weight), now.n
    target = F.when(full, cap * F.col("source_size")).otherwise(F.col("weight") * F.lit(level))
    return Targets(table.select("source", "rows", "source_size", target.cast("double").alias("target")), sums.sources, sums.rows or 0, sums.most or 0)


def flight(sizes: np.ndarray, chance: np.ndarray, rng: random.Random) -> tuple[np.ndarray, list[int]]:
    """Moves probabilities until at most two are undecided; keeps their sum and the sum of sizes times them."""
    p = chance.tolist()
    s = sizes.tolist()
    open_: list[int] = []
    for i in range(len(p)):
        if EPS < p[i] < 1 - EPS:
            open_.append(i)
        else:
            p[i] = float(round(p[i]))
        while len(open_) == 3:
            a, b, c = open_
            u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
            if not any(u):
                u = (1, -1, 0)
            up = min((1 - p[k]) / d if d > 0 else p[k] / -d for k, d in zip(open_, u, strict=True) if d)
            down = min(p[k] / d if d > 0 else (1 - p[k]) / -d for k, d in zip(open_, u, strict=True) if d)
            step = up if rng.random() * (up + down) < down else -down
            rest = []
            for k, d in zip(open_, u, strict=True):
                p[k] += step * d
                if EPS < p[k] < 1 - EPS:
                    rest.append(k)
                else:
                    p[k] = float(round(p[k]))
            if len(rest) == 3:  # rounding held the step back: the nearest one is decided
                k = min(rest, key=lambda k: min(p[k], 1 - p[k]))
                p[k] = float(round(p[k]))
                rest.remove(k)
            open_ = rest
    return np.array(p), open_


def land(sizes: list[int], chance: list[float]) -> list[int]:
    """0 or 1 for the last documents, from large to small: each as it brings the words taken so far nearest to the
    expected ones, the remaining ones counting as expected; ties go by the number of documents."""
    words = docs = 0.0
    take = []
    for s, p in zip(sizes, chance, strict=True):
        options = [(abs(words + (t - p) * s), abs(docs + t - p), t) for t in (0, 1)]
        t = min(options)[2]
        words, docs = words + (t - p) * s, docs + t - p
        take.append(t)
    return take


def reserved(fractional: np.ndarray, last: bool) -> np.ndarray:
    """Undecided documents (places, large to small) that a flight leaves alone, so that the landing has documents of
    every size: 64 evenly spread in the last round, four of the smaller half of a slice before."""
    n = len(fractional)
    if last:
        return np.unique(fractional[np.linspace(0, n - 1, min(n, 64)).astype(int)]) if n else fractional
    return np.unique(fractional[[n // 2, 3 * n // 4, 9 * n // 10, n - 1]]) if n >= 16 else fractional[:0]


_COLUMNS = ["doc_id", "source", "row", "size", "source_size", "target", "whole", "chance", "slice", "open"]
_ROUND = "doc_id long, source string, row long, size long, source_size long, target double, whole long, chance double, slice int, open boolean"


def _round(rows: DataFrame, seed: int, last: bool) -> DataFrame:
    """One flight in each (source, slice); in the last round also the landing."""

    def fly(t: pa.Table) -> pa.Table:
        size = t["size"].to_numpy()
        ids, row, chance = C.ids_of(t["doc_id"]), t["row"].to_numpy(), t["chance"].to_numpy()
        order = np.lexsort((row, ids, chance, -size))
        key = f"{seed}|{t['source'][0].as_py()}|{t['source'][0].as_py() is None}|{t['slice'][0].as_py()}|{len(t)}"
        rng = random.Random(hashlib.sha256(key.encode()).digest())
        size, p = size[order], chance[order]
        held = reserved(np.flatnonzero((p > EPS) & (p < 1 - EPS)), last)
        flown = np.setdiff1d(np.arange(len(p)), held)
        p[flown], left = flight(size[flown], p[flown], rng)
        left = np.union1d(flown[left], held).astype(np.int64)
        if last:
            p[left] = land(size[left].tolist(), p[left].tolist())
            left = left[:0]
        open_ = np.zeros(len(p), bool)
        open_[left] = True
        return t.take(pa.array(order)).drop_columns(["chance", "open"]).append_column("chance", pa.array(p)).append_column("open", pa.array(open_)).select(_COLUMNS)

    return rows.groupBy("source", "slice").applyInArrow(fly, _ROUND)


def draw(documents: DataFrame, targets: Targets, seed: int = 17, slice_rows: int = 2_000) -> DataFrame:
    """documents (doc_id, source, size) with their source's size and target and ``times``, how often each is taken.
    Rows with the same id and size are told apart by their number among those that are alike in all three columns."""
    # alike rows share a probability; each of them is one sampling unit
    alike = targets.joined(documents).groupBy("doc_id", "source", "size", "source_size", "target", "rows").agg(F.count("*").alias("times"))
    units = alike.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + EPS).cast("long")
    slices = F.ceil(F.col("rows") / slice_rows)
    files = C.files_for(targets.rows, 100_000)
    rows = C.cut(
        units.select(
            "doc_id", "source", "row", "size", "source_size", "target", whole.alias("whole"), F.greatest(ratio - whole, F.lit(0.0)).alias("chance"),
            F.pmod(F.xxhash64("doc_id", "row"), slices).cast("int").alias("slice"), F.lit(True).alias("open"),
        ),
        files,
    )
    decided, most, turn = None, -(-targets.most // slice_rows), 0
    while True:
        last = most <= 1
        done = C.cut(_round(rows, seed + turn, last), files)
        closed = done.where("NOT open")
        decided = closed if decided is None else decided.union(closed)
        if last:
            break
        rows = done.where("open").withColumn("slice", F.floor(F.col("slice") / 64).cast("int"))
        most, turn = -(-most // 64), turn + 1
    return decided.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.round("chance").cast("long")).alias("times"))


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken): how often the mix takes each document.

    size: words of the text (null: 0).  A null source is a source, after all others; one of size 0 takes nothing.
    Rows with one id are drawn each on its own.  An empty table gives no rows.  The same rows and seed give the same
    draw, in whatever order or partitions they come."""
    docs = C.pick(docs, doc_id="doc_id", text="text", source="source")
    sized = C.cut(docs.select("doc_id", "source", word_count("text").alias("size")))
    return draw(sized, source_targets(sized, weights, cap), seed).withColumn("taken", F.col("times") * F.col("size"))


def op1_cube_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source", "times")
