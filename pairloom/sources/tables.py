"""Intermediate tables in the folder that driver and executors share, and even work for dear row-wise features."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def cleanup(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; results that still read them must be written first."""
    base = shared_folder(spark, "").rsplit("/", 1)[0]
    where = spark._jvm.org.apache.hadoop.fs.Path(base)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that only finished, written steps used, before the next large step."""
    gc.collect()
    spark._jvm.System.gc()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir.

    Where that is unset, one machine may use its own temp folder; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or tempfile.gettempdir() + '/pairloom-shared').rstrip('/')}/pairloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, label: str, schema: StructType | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read back, by its own schema or a given one of the same layout."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its place from 1 by an order without ties, in no single task.

    Rows are dealt by ranges of the order, numbered inside each range, and shifted by the sizes of the ranges before.
    """
    dealt = shared_table(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a range
    placed = dealt.withColumn("__place", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return placed.join(F.broadcast(before), "__part").select(*df.columns, (F.col("__before") + F.col("__place")).alias(name))


def tasks(spark: SparkSession) -> int:
    """Tasks for work that is dear for its bytes: as many as cores or shuffle partitions, whichever is more."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over the cores: short rows that are dear to compute would share a few tasks by their bytes."""
    return df.repartition(tasks(df.sparkSession))
