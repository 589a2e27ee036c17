"""Contiguous balanced shards from global byte-size prefix sums.

Rows are put in the order of their text's hash, then key, by a range partitioning, every partition's byte and row
totals (one small row each) give each partition its global offset, and a running sum inside the
partition gives each row its global position. Cuts at equal byte targets make contiguous shards whose sizes differ by
at most about one row. Equal texts stand side by side in that order, so a cut can split one group of them at most: a
small one then goes to one side as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import materialize

#: A group of equal texts stays whole up to this share of a shard's target; a larger one is cut, as shards could not be near equal otherwise.
GROUP_SHARE = 0.02


def shard_by_bytes(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", group_share: float = GROUP_SHARE) -> DataFrame:
    """Assign every row to one of `shards` contiguous shards of near-equal bytes.

    Returns key, size (UTF-8 bytes plus 1; null text: 1), text_crc32 (null text: that of no
    bytes, 0), text_hash (that of the group of equal texts), global_row, shard, slot. A row belongs to the shard in which the
    middle of its byte range falls, so a row longer than a target leaves later shards empty rather than
    being split. Groups of equal texts of up to group_share of a target stay in one shard, by the middle of their
    range; larger ones may lie in several. Null and empty texts are one group. Repeated keys keep a fixed order by
    size and checksum; null keys come first; an empty table gives no rows; other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = docs.select(F.col(key).alias(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("text_hash"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds come from a sample, so the partitioning is fixed by writing it once; the key splits a large group.
    order = ["text_hash", F.col(key).asc_nulls_first(), "size", "text_crc32"]
    ranged = materialize(slim.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    # One row a partition: bounded by the partition count, whatever the table's size.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    shard_at = lambda middle: F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / (2 * F.col("all_bytes")))).cast("int")
    placed = (
        ranged.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("row", F.row_number().over(inside))
        .join(F.broadcast(offsets), "part")
        .withColumn("global_row", F.col("rows_before") + F.col("row") - 1)
        .withColumn("ends", F.col("bytes_before") + F.col("upto"))
        # twice the middle of the row's byte range, to stay in whole numbers
        .withColumn("shard", shard_at(2 * F.col("ends") - F.col("size")))
    )
    # A cut splits a group where a shard ends with the text that a later one begins with: one group a cut.
    ends = placed.groupBy("shard").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high"))
    split = ends.select(F.col("low").alias("text_hash")).intersect(ends.select(F.col("high").alias("text_hash")))
    groups = placed.join(F.broadcast(split), "text_hash").groupBy("text_hash", "all_bytes").agg(F.min(F.col("ends") - F.col("size")).alias("begin"), F.max("ends").alias("end"))
    small = groups.filter((F.col("end") - F.col("begin")) * shards <= group_share * F.col("all_bytes")).select("text_hash", shard_at(F.col("begin") + F.col("end")).alias("whole"))
    placed = materialize(placed.join(F.broadcast(small), "text_hash", "left").withColumn("shard", F.coalesce("whole", "shard")).select(key, "size", "text_crc32", "text_hash", "global_row", "shard"), "placed")
    first = placed.groupBy("shard").agg(F.min("global_row").alias("first_row"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(key, "size", "text_crc32", "text_hash", "global_row", "shard", (F.col("global_row") - F.col("first_row")).alias("slot"))
