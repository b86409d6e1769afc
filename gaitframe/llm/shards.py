"""Contiguous shards of near-equal bytes, by prefix sums from per-partition totals.

Rows are laid in the order of (hash of the text, doc_id), dealt into ranges of that
order, and every range is summed. A range's start is the sum of the ranges before it;
a row's start is that plus the running sum inside its range. Cuts at equal targets give
the shard. Equal texts are neighbours; a large group of them spreads over many ranges
because doc_id is part of the key. Texts themselves are never shuffled.

Null text has size 8. Repeated rows are rows. Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitframe.llm.shared import settle


def assign(docs: DataFrame, shards: int = 24, overhead: int = 8, ranges: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document."""
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = F.col("text").cast("string").cast("binary")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
        F.xxhash64("text").alias("spot"),
    )
    laid = settle(sized.repartitionByRange(ranges, "spot", "doc_id", "size").withColumn("part", F.spark_partition_id()), "ranges")
    totals = laid.groupBy("part").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    # one row a range, whatever the number of documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    total = totals.agg(F.coalesce(F.sum("b"), F.lit(1)).alias("total"))
    inside = Window.partitionBy("part").orderBy("spot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    run = laid.withColumns({"b": F.sum("size").over(inside), "n": F.count(F.lit(1)).over(inside)})
    run = run.join(F.broadcast(starts), "part").join(F.broadcast(total))  # a row a range, and one row
    middle = 2 * (F.col("b0") + F.col("b")) - F.col("size")  # twice the middle of the row's bytes
    placed = run.withColumn("middle", middle).selectExpr("*", f"cast(least({shards} - 1, ({shards} * middle) div (2 * total)) as int) AS shard", "n0 + n - 1 AS place")
    heads = placed.groupBy("shard").agg(F.min("place").alias("head"))  # a row a shard
    return placed.join(F.broadcast(heads), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("head")).alias("slot"))
