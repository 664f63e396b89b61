"""Contiguous shards of near-equal bytes.

Rows are dealt by range of their id, each part reports its bytes and rows, a
running sum over those few totals places every part in the global order, and a
window inside each part places every row.  No task ever sees all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm._spark import durable, partitions

#: Bytes that a row costs beside its text.
ROW_OVERHEAD = 8


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 length of the text plus 8.  Documents are taken in
    the order of their ids (null first; equal ids by a hash of the text) and
    the global byte prefix sum is cut at equal targets: a document belongs to
    the shard in which its middle byte falls, so a shard misses its target by
    less than a document.  Slots count from 0 in each shard without a gap.

    Null text: size 8 and a null checksum becomes that of the empty text.
    Repeated rows each get a slot of their own.  An empty table gives an empty
    result.  Shards may stay empty where one document spans several targets.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    slim = durable(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("tie"),
        )
    )
    dealt = durable(slim.repartitionByRange(partitions(spark), "doc_id", "tie").withColumn("part", F.spark_partition_id()))
    # One row per part: the window without a key runs over partition totals only.
    in_order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(in_order), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(in_order), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy("doc_id", "tie", "size")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        dealt.withColumns({"start": F.coalesce(F.sum("size").over(before), F.lit(0)), "row": F.row_number().over(inside) - 1})
        .join(F.broadcast(offsets), "part")  # a row for each shuffle partition
        .withColumns({"start": F.col("start") + F.col("bytes_before"), "row": F.col("row") + F.col("rows_before")})
        .withColumn("shard", F.expr(f"cast(least({n_shards - 1}, ((2 * start + size) * {n_shards}) div (2 * all_bytes)) as int)"))
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(firsts), "shard").select(  # n_shards rows
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first_row")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
