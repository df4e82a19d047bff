"""Global places and running sums without a single task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut


def placed(df: DataFrame, by: str, amount: str | None = None) -> DataFrame:
    """df with ``place`` (1, 2, ... in order of ``by``) and, if an amount is named, ``running``, its sum so far.

    Rows are dealt to ranges of ``by`` and kept there (a second range sort might choose other bounds); a window works
    inside a range, and what came before a range is added from one row a range."""
    ranged = cut(df.repartitionByRange(by).withColumn("range", F.spark_partition_id()))
    total = F.sum(amount) if amount else F.count("*")
    sums = ranged.groupBy("range").agg(F.count("*").alias("n"), total.alias("total"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long").alias(f"{c}_before") for c in ("n", "total")])
    here = Window.partitionBy("range").orderBy(by)
    out = ranged.withColumn("place", F.row_number().over(here))
    if amount:
        out = out.withColumn("running", F.sum(amount).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(F.broadcast(offsets), "range").withColumn("place", (F.col("place") + F.col("n_before")).cast("long"))
    if amount:
        out = out.withColumn("running", (F.col("running") + F.col("total_before")).cast("long"))
    return out.drop("range", "n_before", "total_before")
