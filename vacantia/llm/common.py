"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from vacantia.session import cut_lineage, work_dir

#: White space of the word definition: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """A column name the frame does not have yet, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


#: Bits of the filter of ``likely``: 8 MB whatever the input.
FILTER_BITS = 1 << 26


def likely(rows: DataFrame, key: str, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose key may be among ``keys`` (same column name), before a shuffle that would carry all of them.

    A bitmap of fixed size goes to every task, so a join or grouping that follows still has to decide; it gets fewer rows, or
    in the worst case all of them.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    maps = keys.select(slot.alias("slot_")).groupBy(F.bitmap_bucket_number("slot_").alias("bucket_"))
    maps = maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot_")).alias("map_"))
    # as 64-bit numbers of eight bytes: a row reads one where it lies, while binary is copied whole, 4096 bytes, for every row that looks at a bit
    eight = lambda at: F.substring("map_", at, F.lit(8))
    number = lambda at: F.when(eight(at) == F.lit(bytes(8)), F.lit(0)).otherwise(F.conv(F.hex(eight(at)), 16, -10).cast("bigint"))
    maps = maps.select("bucket_", F.transform(F.sequence(F.lit(1), F.length("map_"), F.lit(8)), number).alias("map_"))
    marked = rows.withColumn("slot_", slot).withColumns({"bucket_": F.bitmap_bucket_number("slot_"), "bit_": F.bitmap_bit_position("slot_").cast("int")})
    met = marked.join(F.broadcast(maps), "bucket_")
    place = F.col("bit_").bitwiseAND(F.lit(63)).bitwiseXOR(F.lit(56))  # the first of eight bytes is the highest
    is_set = F.call_function("shiftright", F.get("map_", F.shiftright("bit_", 6)), place).bitwiseAND(F.lit(1)) != 0
    return met.where(is_set).select(*rows.columns)


def release() -> None:
    """Give memory that Arrow and the C library hold but do not use back to the system; Spark keeps Python workers for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The work of a task on batches, releasing memory when it ends."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            release()

    return run


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Inside, rows go to Python workers in batches of at most so many, for steps that run to their end there: Spark's default holds tens of MB
    of texts or sets in the executor and in the worker at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


#: Text or rows that are turned into Python values at once.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, nbytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many bytes, one row at least: a batch of Spark may hold 64 MB and far more as Python values."""
    step = max(1, int(len(batch) * nbytes / max(1, batch.nbytes)))
    for at in range(0, len(batch), step):
        yield batch.slice(at, step)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


__all__ = ["BLANKS", "WORD", "cut_lineage", "free_name", "lean", "likely", "partitions", "release", "slices", "small_batches", "table", "work_dir"]
