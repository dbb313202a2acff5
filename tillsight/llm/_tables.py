"""Written intermediates and fixed-size key filters shared by the operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.session import scratch_table_path


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs re-read files, not recomputed passes.  Long binary values are better
    written with ``zstd``, which needs no buffers outside the heap to be read.
    """
    spark = df.sparkSession
    path = scratch_table_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bitmap_words(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """``w``, ``v``: the 64-bit words that aren't zero of a bitmap of ``2**bits`` bits (see :func:`bitmap`)."""
    slot = F.pmod(key, F.lit(1 << bits)).cast("bigint")
    return (keys.select(slot.alias("b"))
            .select(F.shiftright("b", 6).alias("w"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("v"))
            .groupBy("w").agg(F.bit_or("v").alias("v")))


def bitmap(keys: DataFrame, key: Column, bits: int) -> np.ndarray:
    """A bitmap of ``2**bits`` bits with the bit ``pmod(key, 2**bits)`` set for every row's 64-bit ``key``.

    Its size is fixed by ``bits`` (2**23 bits: 1 MB), whatever the number of rows; only the
    aggregated non-zero 64-bit words reach the driver.  Use it to thin out rows before an exact join.
    """
    words = np.zeros((1 << bits) >> 6, dtype=np.uint64)
    got = _bitmap_words(keys, key, bits).toPandas()
    words[got["w"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64).view(np.uint64)
    return words


def without(rows: DataFrame, gone: DataFrame, key: str, bits: int = 23) -> DataFrame:
    """``rows`` less those whose ``key``, never null, is in ``gone``.

    Wide rows stay where they are unless a bitmap of the keys in ``gone`` (2**23 bits: 131,072 words at most) can't rule
    them out: only those move, to an exact join in which they aren't sorted.
    """
    gone = written(gone.select(key).distinct(), "gone")
    words = F.broadcast(written(_bitmap_words(gone, F.xxhash64(key), bits), "gone-words"))
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits)).cast("bigint")
    marked = rows.withColumn("_slot", slot).join(words, F.shiftright("_slot", 6) == F.col("w"), "left")
    hit = F.coalesce(F.expr("shiftrightunsigned(v, cast(_slot & 63 as int)) & 1") == 1, F.lit(False))
    columns = [f"`{c}`" for c in rows.columns]
    kept = marked.where(hit).select(*columns).join(gone.hint("shuffle_hash"), key, "left_anti")
    return marked.where(~hit).select(*columns).unionByName(kept)


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each 64-bit key, whether its bit is set (no false negatives)."""
    slot = keys.view(np.uint64) & np.uint64(words.size * 64 - 1)
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def ship(spark: SparkSession, value):
    """A Spark broadcast of a value whose size a parameter bounds."""
    return spark.sparkContext.broadcast(value)
