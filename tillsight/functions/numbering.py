"""Dense row numbers without collecting a key, a file or the whole table in one task.

Both functions write the rows once, count them by a small unit (a task's slice of a key, a split of a
file) and add the units before: the only window runs over that small table of counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _numbered(rows: DataFrame, keys: list[str], unit: str, name: str, start: int) -> DataFrame:
    """``rows`` (written; ``_at`` grows by one from row to row of a key's unit) with ``name`` instead of ``unit``, ``_at``.

    The offsets are written: a join with a table whose size is known doesn't move the rows where that table is small.
    """
    from tillsight.sources.bindings import written

    counts = rows.groupBy(*keys, unit).agg(F.min("_at").alias("_base"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.col(unit).alias("_unit"),
                          (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_base") + start).alias("_shift"))
    first = written(first, "offsets")
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)],
                  F.col(unit) == F.col("_unit"))
    return rows.join(first, same).select(*[f"`{c}`" for c in rows.columns if c not in (unit, "_at", name)],
                                         (F.col("_at") + F.col("_shift")).alias(name))


def dense_numbers(rows: DataFrame, keys: list[str], order: list[Column], name: str = "row_seq", start: int = 0) -> DataFrame:
    """Number the rows of each key from ``start`` on, without gaps, in the total order ``order``.

    Rows are range-partitioned by key and order, so a key that holds a third of all rows spreads over many tasks.
    Rows that agree in ``order`` are numbered in any order.  Null keys are a key of their own.
    """
    from tillsight.sources.bindings import written

    at = [F.col(f"`{k}`") for k in keys] + order
    dealt = rows.repartitionByRange(*at).sortWithinPartitions(*at).withColumn("_at", F.monotonically_increasing_id())
    # range bounds are sampled: counts and places must come from one and the same written table
    dealt = written(dealt.withColumn("_slice", F.shiftright("_at", 33)), "numbered")
    return _numbered(dealt, keys, "_slice", name, start)


def file_row_numbers(rows: DataFrame, file: str, block: str, name: str = "row_no", start: int = 1) -> DataFrame:
    """Number the rows of each file from ``start`` on, as they stand in it.

    ``rows`` are written, come from a scan whose splits start at ``block`` (ascending within a file), and have ``_at``, a
    ``monotonically_increasing_id`` given in the scan's own tasks.  ``block`` and ``_at`` are dropped.
    """
    return _numbered(rows, [file], block, name, start)
