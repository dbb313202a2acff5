"""Exact, linearly interpolated quantiles per key without concentrating a key in one task.

``percentile`` keeps a value→count map per group and merges it in one task per key;
for a store holding a third of all orders that is one huge buffer.  Here instead:

1. range-partition by (keys, value) — the sampler spreads a hot key over many partitions
   and partition ids increase with (key, value);
2. rank rows inside each (partition, key) slice;
3. count rows per (partition, key) — a table bounded by partitions + keys — and turn it
   into a per-key running offset (a window over that small table);
4. global rank = offset + local rank; only the two ranks around each quantile position
   survive the filter, and a final aggregate per key interpolates between them.

Interpolation matches Spark's ``percentile``: position = q·(n − 1),
value = (⌈pos⌉ − pos)·v[⌊pos⌋] + (pos − ⌊pos⌋)·v[⌈pos⌉].
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.session import ensure_checkpoint_dir


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], prefix: str = "q") -> DataFrame:
    s = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    s = s.repartitionByRange(*keys, "_v").withColumn("_pid", F.spark_partition_id())
    s = s.withColumn("_lr", F.row_number().over(Window.partitionBy("_pid", *keys).orderBy("_v")))
    # range bounds are sampled: ranks and counts must come from one and the same partitioning
    ensure_checkpoint_dir(s.sparkSession)
    s = s.checkpoint()
    cnt = s.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.select("_pid", *keys, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
                     F.sum("_c").over(Window.partitionBy(*keys)).alias("_n"))
    r = s.join(off, ["_pid", *keys]).withColumn("_rank", F.col("_off") + F.col("_lr") - 1)
    pos = [(F.col("_n") - 1).cast("double") * q for q in qs]
    keep = F.lit(False)
    for p in pos:
        keep = keep | (F.col("_rank") == F.floor(p)) | (F.col("_rank") == F.ceil(p))
    picked = r.filter(keep)
    aggs = []
    for i, p in enumerate(pos):
        lo = F.max(F.when(F.col("_rank") == F.floor(p), F.col("_v")))
        hi = F.max(F.when(F.col("_rank") == F.ceil(p), F.col("_v")))
        pp = F.first(p)
        aggs += [lo.alias(f"_lo{i}"), hi.alias(f"_hi{i}"), pp.alias(f"_p{i}")]
    g = picked.groupBy(*keys).agg(*aggs)
    out = [F.col(k) for k in keys]
    for i, _ in enumerate(qs):
        p, lo, hi = F.col(f"_p{i}"), F.col(f"_lo{i}"), F.col(f"_hi{i}")
        val = F.when(F.ceil(p) == F.floor(p), lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi)
        out.append(val.alias(f"{prefix}{i}"))
    return g.select(*out)
