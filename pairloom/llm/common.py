"""What the training-data operators share: tables in the shared folder, row identity, key bitmaps, worker memory."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, one machine may use its own temp folder; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/") or f"{tempfile.gettempdir()}/pairloom-shared"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts the lineage.

    Lost executors lose nothing of it, and later stages reread it instead of recomputing.
    """
    path = f"{shared_dir(df.sparkSession)}/pairloom/{df.sparkSession.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._pairloom_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that only finished, written steps used, before the next large step."""
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that no later step reads."""
    path = getattr(df, "_pairloom_path", None)
    if path:
        _delete(df.sparkSession, path)


def cleanup(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; call it once the results that read them are written."""
    _delete(spark, f"{shared_dir(spark)}/pairloom/{spark.sparkContext.applicationId}")


def row_hash(key: str, text: str) -> Column:
    """Tells rows that repeat a key but hold another text apart; rows equal in both are one document."""
    return F.xxhash64(F.col(key).cast("long"), F.col(text))


#: Bounds of a key bitmap, as powers of two of its bits: 2^24 bits are 2^18 rows of 16 bytes in a broadcast.
KEY_BITS = (12, 24)


def split_by_keys(rows: DataFrame, key: list[str], keys: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key of keys.names, rows that surely have none), in the JVM and without a shuffle of rows.

    The keys set bits of a map of about 32 bits a key, within KEY_BITS, so what goes to every
    task is bounded whatever the number of keys. A full map rules nothing out, and stays right.
    """
    size = 1 << min(KEY_BITS[1], max(KEY_BITS[0], math.ceil(math.log2(32 * keys.count() + 1))))
    place = lambda cols: F.pmod(F.xxhash64(*[F.col(c).cast("long") for c in cols]), F.lit(size))
    bits = keys.select(place(names).alias("b")).groupBy(F.shiftright("b", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("__bits"))
    marked = rows.withColumn("__place", place(key)).withColumn("__word", F.shiftright("__place", 6)).join(F.broadcast(bits), "__word", "left")
    hit = F.expr("coalesce(getbit(__bits, cast(__place & 63 as int)) = 1, false)")
    return marked.filter(hit).select(*rows.columns), marked.filter(~hit).select(*rows.columns)


def matching(left: DataFrame, right: DataFrame, pairs: dict[str, str], how: str) -> DataFrame:
    """Shuffle join where left's columns equal right's, nulls included: both sides grow with the corpus, whatever their size here.

    right holds a row a key and is hashed partition by partition, so the wide rows of left are never sorted.
    """
    on = [left[a].eqNullSafe(right[b]) for a, b in pairs.items()]
    return left.join(right.hint("shuffle_hash"), on, how)


def without_rows(docs: DataFrame, key: str, text: str, lost: DataFrame) -> DataFrame:
    """docs without the rows whose key and text are named by lost (__key, __row); only rows that may be lost are joined."""
    named = docs.withColumn("__row", row_hash(key, text)).withColumn("__key", F.col(key).cast("long"))
    maybe, free = split_by_keys(named, ["__key", "__row"], lost, ["__key", "__row"])
    gone = lost.select(F.col("__key").alias("__k"), F.col("__row").alias("__r"))
    return free.union(matching(maybe, gone, {"__key": "__k", "__row": "__r"}, "left_anti")).select(*docs.columns)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(key: str, folds: int, fold: int):
    """True for the rows whose crc32(key as text) mod folds is fold."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold


def free_name(taken: list[str], name: str) -> str:
    """name, with underscores put before it until no column has it (names differ by more than case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


class Kept(dict):
    """A cache bounded by entries and by the bytes that put() counts; it starts anew when either is full."""

    def __init__(self, entries: int, size: int):
        super().__init__()
        self.entries, self.size, self.held = entries, size, 0

    def clear(self) -> None:
        super().clear()
        self.held = 0

    def put(self, key, value, size: int):
        self.held += size
        if len(self) >= self.entries or self.held > self.size:
            self.clear()
            self.held = size
        self[key] = value
        return value


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow; at the end of a task the worker, which Spark keeps, gives its memory back."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(it)
        finally:
            give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
