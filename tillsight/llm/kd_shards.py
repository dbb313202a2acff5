"""Shards of near equal bytes by a k-d tree over document metadata.

The root holds all rows and ``n_shards`` shares.  A node with s shares is split along the
metadata dimension in which its rows spread widest (as a part of the whole table's spread),
at the weighted quantile that gives floor(s / 2) shares of its bytes to the left side; a
node with one share is a shard.  Equal coordinates are told apart by a hash of the row's
key, and rows of one key by numbering them, so that a source or language that holds a third of the rows is split like any other.

The quantile comes from weighted histograms: all nodes of a level are done in one pass of
1,024 bins per node and dimension, and the one bin per node that holds the quantile is
refined (1,024 bins of it again) until its bytes are below ``tolerance`` of a shard.  What
reaches the driver is bounded by shards x dimensions x bins, not by rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm._tables import written

BITS = 10          # bits of a histogram round
Q_BITS = 20        # bits of a coordinate
TIE_BITS = 40      # bits of the tie hash
KEY_BITS = Q_BITS + TIE_BITS


@dataclass
class Split:
    """A node of the current level: ``shares`` shards from number ``first`` on."""

    first: int
    shares: int
    dim: int = 0
    at: int = 0


def _key(dim: int) -> Column:
    return F.shiftleft(F.col(f"q{dim}"), TIE_BITS) + F.col("tie")


def _histogram(rows: DataFrame, dims: list[int], low_bits: int) -> dict[int, dict[int, dict[int, int]]]:
    """Bytes by node, dimension and bin (the bits of the key above ``low_bits``)."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.shiftright(_key(d), low_bits).alias("bin"))
                               for d in dims]))
    got: dict = {}
    for r in (rows.select("leaf", "weight", each.alias("x")).groupBy("leaf", "x.dim", "x.bin")
              .agg(F.sum("weight").alias("w")).collect()):
        got.setdefault(r["leaf"], {}).setdefault(r["dim"], {})[r["bin"]] = r["w"]
    return got


def _find_splits(rows: DataFrame, todo: list[Split], n_dims: int, limit: float) -> None:
    """Choose dimension and split key of every node in ``todo`` (all of one level)."""
    bits = KEY_BITS - BITS
    got = _histogram(rows.where(F.col("leaf").isin([n.first for n in todo])), list(range(n_dims)), bits)
    goal: dict[int, float] = {}
    for n in todo:
        by_dim = got.get(n.first, {0: {}})
        width = [max(by_dim[d]) - min(by_dim[d]) if by_dim.get(d) else 0 for d in range(n_dims)]
        n.dim = width.index(max(width))
        goal[n.first] = sum(by_dim[n.dim].values()) * (n.shares // 2) / n.shares
    nodes = [n for n in todo if n.first in got]
    while nodes:
        still = []
        for n in nodes:
            bins, so_far = got[n.first][n.dim], 0
            for b, w in sorted(bins.items()):
                if so_far + w >= goal[n.first] or b == max(bins):
                    break
                so_far += w
            n.at = b << bits
            if w > limit and bits > 0:
                goal[n.first] -= so_far
                still.append(n)
            elif abs(so_far + w - goal[n.first]) < abs(so_far - goal[n.first]):
                n.at = (b + 1) << bits  # the bin's far end is nearer to the goal
        nodes = still
        if nodes:
            inside = F.lit(False)
            for n in nodes:
                inside |= (F.col("leaf") == n.first) & (F.shiftright(_key(n.dim), bits)
                                                        == F.lit(n.at >> bits).cast("bigint"))
            bits -= BITS
            got = _histogram(rows.where(inside), sorted({n.dim for n in nodes}), bits)


def kd_leaves(rows: DataFrame, n_dims: int, n_shards: int, tolerance: float = 0.001) -> DataFrame:
    """``rows`` (columns q0.., tie, weight) with ``leaf``, the number of the shard.

    Each level's assignment is written, so that the next one scans a narrow table.
    """
    total = rows.agg(F.sum("weight")).first()[0] or 0
    rows = rows.withColumn("leaf", F.lit(0))
    level = [Split(0, n_shards)]
    while todo := [n for n in level if n.shares > 1]:
        _find_splits(rows, todo, n_dims, tolerance * total / n_shards)
        step = F.lit(0)
        for n in todo:
            right = (F.col("leaf") == n.first) & (_key(n.dim) >= F.lit(n.at).cast("bigint"))
            step = F.when(right, n.shares // 2).otherwise(step)
        rows = written(rows.withColumn("leaf", F.col("leaf") + step), "shard-level")
        level = [c for n in todo for c in (Split(n.first, n.shares // 2),
                                           Split(n.first + n.shares // 2, n.shares - n.shares // 2))]
    return rows


def shard(docs: DataFrame, key: str, weight: Column, dims: list[Column], n_shards: int | None = None,
          target_bytes: int | None = None, keep: dict[str, Column] | None = None) -> DataFrame:
    """Every row of ``docs`` with its ``shard`` and ``slot``.

    ``dims`` are numeric columns (null counts as the smallest value), ``weight`` a row's bytes.
    Give ``n_shards`` or ``target_bytes`` (then as many shards as fill that).  Returns ``key``,
    ``weight``, the columns ``keep``, ``shard`` (int, from 0) and ``slot`` (bigint, gapless from
    0 in each shard).  An empty table gives an empty result.  Rows that agree in key and ``keep`` are
    interchangeable and are spread like others.  The tie hash is of the key, so equal inputs, dealt over equal files,
    give equal shards.
    """
    keep = keep or {}
    raw = docs.select(F.col(key), weight.cast("bigint").alias("weight"),
                      *[c.alias(n) for n, c in keep.items()],
                      *[d.cast("double").alias(f"d{i}") for i, d in enumerate(dims)])
    raw = written(raw, "shard-rows")
    n_dims = len(dims)
    ends = raw.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"),
                   *[F.min(f"d{i}").alias(f"lo{i}") for i in range(n_dims)],
                   *[F.max(f"d{i}").alias(f"hi{i}") for i in range(n_dims)]).first()
    if n_shards is None:
        n_shards = max(1, round((ends["w"] or 0) / target_bytes))

    def coordinate(i: int) -> Column:
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        if lo is None or hi <= lo:
            return F.lit(0).cast("bigint")
        return F.coalesce(F.floor((F.col(f"d{i}") - lo) / (hi - lo) * ((1 << Q_BITS) - 1)), F.lit(0)).cast("bigint")

    # rows that agree in key and kept columns are told apart by their number within a task's rows: no group of
    # copies has to fit into one shard or one task
    same = Window.partitionBy(key, *keep, "part").orderBy("weight")
    raw = raw.withColumn("part", F.spark_partition_id()).withColumn("copy", F.row_number().over(same))
    tie = F.pmod(F.when(F.col("copy") == 1, F.xxhash64(key, *keep)).otherwise(F.xxhash64(key, *keep, "part", "copy")),
                 F.lit(1 << TIE_BITS))
    rows = raw.select(key, "weight", *keep, *[coordinate(i).alias(f"q{i}") for i in range(n_dims)], tie.alias("tie"))
    rows = kd_leaves(written(rows, "shard-keys"), n_dims, n_shards)
    # slots: rows are numbered in chunks of a shard, chunks follow one another
    chunks = 8 * max(1, -(-(ends["n"] or 0) // (n_shards * 400_000)))
    placed = rows.select(key, "weight", *keep, F.col("leaf").alias("shard"), "tie",
                         F.pmod(F.col("tie"), F.lit(chunks)).alias("chunk"))
    counts = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "chunk").orderBy("tie", key, *keep)
    numbered = placed.withColumn("at", F.row_number().over(inside))
    return (numbered.join(offsets, ["shard", "chunk"])
            .select(key, "weight", *keep, "shard", (F.col("offset") + F.col("at") - 1).alias("slot")))
