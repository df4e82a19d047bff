"""Connected components by alternating stars, all in DataFrames.

Each round links the neighbours of every node to the smallest of them, first the larger, then the smaller ones; the
number of rounds grows with the logarithm of the longest path.  A hub is one key of an aggregate with partial sums, and
of a join that deals its links to all tasks.  Every round is written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join


def _is_forest_of_stars(e: DataFrame) -> bool:
    """No node is both linked to a smaller one and the smaller one of a link, and none is linked to two."""
    heads = e.groupBy("u").agg(F.min("v").alias("x"), F.max("v").alias("y"))
    bad = heads.where("x <> y").select("u").union(heads.select("u").join(e.select(F.col("v").alias("u")), "u", "left_semi"))
    return not bad.head(1)


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """edges (a, b) of longs, in any direction, repeated or looped as may be: (node, label) for every node with an edge
    to another, label being the smallest node of its component.  No edges: no rows."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), files)
    both_ways = lambda u, v: F.explode(F.array(F.struct(F.col(u).alias("u"), F.col(v).alias("v")), F.struct(F.col(v).alias("u"), F.col(u).alias("v")))).alias("e")
    while not _is_forest_of_stars(e):
        n = 2 * e.count()
        both = e.select(both_ways("u", "v")).select("e.*")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = cut(spread_join(both, least, "u", "v", "n", n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), files)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        linked = spread_join(large, least, "u", "v", "n", n)
        to_least = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        e = cut(linked.select(to_least).select("e.*").where("u <> v").distinct(), files)
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots.select("node", F.col("node").alias("label")))
