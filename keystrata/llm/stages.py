"""The operators as steps of a document pipeline: documents in, documents out.

A step keeps all columns, whatever their names, and takes the rows that its operator keeps.  Rows are matched by place,
not by id, where an id may repeat.  Executors live through all steps, so what one leaves in their memory counts in the
next: each step has rows handed to Python in small batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .jaccard_join import similar_components
from .mixing import mix, word_count
from .packing import pack_documents
from .quality import keep
from .suffix_dedup import without_repeats


def _keyed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named by place, and what they were called."""
    names = {f"_{i}": c for i, c in enumerate(docs.columns)}
    return docs.toDF(*names), names


def _id(docs: DataFrame) -> F.Column:
    return F.col(f"_{docs.columns.index('doc_id')}")


def quality_stage(docs: DataFrame) -> DataFrame:
    """Rows that the quality rules keep."""
    C.bounded_batches(docs.sparkSession)
    return keep(docs)


def near_duplicate_stage(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, and all that have none.

    Rows with one id stay if they differ in text; of rows equal in both, one stays.  Rows without an id
    cannot be named as anyone's copy and stay."""
    C.bounded_batches(docs.sparkSession)
    plain, names = _keyed(docs)
    key = f"_{docs.columns.index('doc_id')}"
    named = plain.where(F.col(key).isNotNull()).toDF(*names.values())
    found = similar_components(named).groupBy("doc_id", "component_id").agg(F.count("*").alias("_rows")).where("doc_id <=> component_id")
    joined = plain.join(found, F.col(key) == found.doc_id)
    alone = joined.where("_rows = 1").select(*names)
    text = f"_{docs.columns.index('text')}"
    repeated = joined.where("_rows > 1").select(*names).dropDuplicates([key, text])
    return alone.union(repeated).union(plain.where(F.col(key).isNull())).toDF(*names.values())


def substring_stage(docs: DataFrame) -> DataFrame:
    """Documents without the bytes that repeat an earlier document; a document that loses all its words goes."""
    C.bounded_batches(docs.sparkSession)
    return without_repeats(docs)


def mixing_stage(docs: DataFrame) -> DataFrame:
    """Documents as often as the mix takes them.  What was drawn for several rows with one id, source and number of
    words is dealt out among them, so the words taken are those drawn."""
    C.bounded_batches(docs.sparkSession)
    drawn = mix(docs).groupBy("doc_id", "source", "size").agg(F.sum("times").alias("_times"), F.count("*").alias("_rows"))
    plain, names = _keyed(docs)
    key, source, text = (F.col(f"_{docs.columns.index(c)}") for c in ("doc_id", "source", "text"))
    same = key.eqNullSafe(drawn.doc_id) & source.eqNullSafe(drawn.source) & (F.col("_size") == drawn["size"])
    joined = plain.withColumn("_size", word_count(text)).join(drawn, same).select(*names, "_size", "_times", "_rows")
    alone = joined.where("_rows = 1").select(*names, "_times")
    place = F.row_number().over(Window.partitionBy(key, source, "_size").orderBy(text))
    shared = joined.where("_rows > 1").withColumn("_place", place)
    shared = shared.select(*names, (F.floor(F.col("_times") / F.col("_rows")) + (F.col("_place") <= F.col("_times") % F.col("_rows")).cast("long")).alias("_times"))
    repeated = alone.union(shared).select(*names, F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int"))))
    return repeated.select(*names).toDF(*names.values())


def packing_stage(docs: DataFrame) -> DataFrame:
    """Where each piece of each document lies in sequences of 4096 tokens."""
    C.bounded_batches(docs.sparkSession)
    return pack_documents(docs)
