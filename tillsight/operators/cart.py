"""Cart composition (A38–A45): cart sizes, ticket statistics and buckets, weekly cart
size, unit segments, multi-unit buckets, single-unit products."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.config import DEFAULT_REPORT, ReportConfig
from tillsight.functions.quantiles import exact_quantiles
from tillsight.operators._common import STORE, dbl, limits, rnd, slots, top_k, trunc_int
from tillsight.operators.summary import order_totals


def cart_distribution(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """Orders by number of distinct products."""
    return order_totals(lines).groupBy(STORE, F.col("unique_products").alias("products_in_cart")).agg(
        F.count(F.lit(1)).alias("count"))


def ticket_stats(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """int of mean, median, p25, p75 (linear interpolation) and max order total per store.

    The quantiles are exact and distributed (:func:`exact_quantiles`): a store with most
    of the orders is spread over many range partitions instead of one percentile buffer.
    """
    o = order_totals(lines).select(STORE, dbl("ticket_dec").alias("t"))
    m = o.groupBy(STORE).agg(F.avg("t").alias("mean"), F.max("t").alias("max"), F.count(F.lit(1)).alias("orders"))
    q = exact_quantiles(o, [STORE], "t", [0.25, 0.5, 0.75])
    return m.join(q, STORE).select(
        STORE, "orders",
        trunc_int("mean").alias("mean"),
        trunc_int("q1").alias("median"),
        trunc_int("q0").alias("p25"),
        trunc_int("q2").alias("p75"),
        trunc_int("max").alias("max"),
    )


def ticket_buckets(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """Orders per right-closed bin ``(lo, hi]``; every bin present (0 when empty); totals
    outside the bins are not counted.  The bin is a ``CASE`` on the order total (Spark's
    Bucketizer is left-closed)."""
    t = dbl("ticket_dec")
    o = order_totals(lines)
    stores = o.select(STORE).distinct()
    if getattr(cfg, "table", None) is None:
        bins, labels = list(cfg.ticket_bins), list(cfg.ticket_labels)
        ix = F.lit(None).cast("int")
        for i in range(len(labels) - 1, -1, -1):
            ix = F.when((t > bins[i]) & (t <= bins[i + 1]), F.lit(i)).otherwise(ix)
        dom_arr = F.array(*[F.struct(F.lit(i).alias("bucket_ix"), F.lit(lab).alias("bucket")) for i, lab in enumerate(labels)])
        dom = stores.select(STORE, F.inline(dom_arr))
    else:
        # a store's own bins: the bin is the number of edges below the total
        o, (edges,) = limits(o, cfg, "ticket_bins")
        at = F.size(F.filter(edges, lambda e: e < t)) - 1
        ix = F.when((at >= 0) & (at < F.size(edges) - 1), at)
        stores, (names,) = limits(stores, cfg, "ticket_labels")
        dom = stores.select(STORE, F.posexplode(names).alias("bucket_ix", "bucket"))
    o = o.select(STORE, ix.alias("bucket_ix")).filter(F.col("bucket_ix").isNotNull())
    counts = o.groupBy(STORE, "bucket_ix").agg(F.count(F.lit(1)).alias("count"))
    return dom.join(counts, [STORE, "bucket_ix"], "left").select(
        STORE, "bucket_ix", "bucket", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def cart_weekly(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """Mean lines per order per ISO week (an order spanning two weeks counts in both)."""
    per = slots(lines).groupBy(STORE, "year_week", "order_id").agg(F.sum("n_lines").alias("items"))
    return per.groupBy(STORE, F.col("year_week").alias("week")).agg(rnd(F.avg("items"), 4).alias("avg_items"))


def cart_segments(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """Orders of exactly one unit vs two or more units (1 < units < 2 is in neither)."""
    o = order_totals(lines)
    items, t = F.col("items_dec"), F.col("ticket_dec")
    s = o.groupBy(STORE).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(items == 1).alias("o1"), dbl(F.avg(F.when(items == 1, t))).alias("t1"),
        F.count_if(items >= 2).alias("o2"), dbl(F.avg(F.when(items >= 2, t))).alias("t2"),
    )
    seg = F.array(
        F.struct(F.lit("1 unidad").alias("segment"), F.col("o1").alias("orders"), F.col("t1").alias("avg")),
        F.struct(F.lit("2+ unidades").alias("segment"), F.col("o2").alias("orders"), F.col("t2").alias("avg")),
    )
    x = s.select(STORE, "n", F.inline(seg))
    return x.select(
        STORE, "segment", "orders",
        F.when(F.col("n") > 0, F.round(F.col("orders") / F.col("n") * 100.0, 1)).otherwise(0.0).alias("share_pct"),
        F.coalesce(rnd("avg", 2), F.lit(0.0)).alias("avg_ticket"),
    )


def multi_buckets(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """Orders of 2+ units by 2, 3, 4+ units (fraction truncated), share inside 2+."""
    o = order_totals(lines).filter(F.col("items_dec") >= 2)
    n_items = F.col("items_dec").cast("double").cast("bigint")
    b = o.select(
        STORE, "order_id", F.col("ticket_dec").alias("t"),
        F.when(F.col("items_dec") >= 4, F.lit("4+ unidades")).otherwise(F.concat(n_items.cast("string"), F.lit(" unidades"))).alias("bucket"),
        F.when(F.col("items_dec") >= 4, F.lit(2)).otherwise(n_items - 2).cast("int").alias("bucket_ix"),
    )
    g = b.groupBy(STORE, "bucket_ix", "bucket").agg(F.count(F.lit(1)).alias("orders"), dbl(F.avg("t")).alias("avg"))
    w = Window.partitionBy(STORE)
    return g.select(
        STORE, "bucket_ix", "bucket", "orders", rnd("avg", 2).alias("avg_ticket"),
        F.round(F.col("orders") / F.sum("orders").over(w) * 100.0, 2).alias("share_multi_pct"),
    )


def single_unit_products(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """One-unit orders: product of the order's first line, orders and mean ticket per
    product; at least ``min_single_ticket_orders``; top k by orders, ticket."""
    one = order_totals(lines).filter(F.col("items_dec") == 1).select(STORE, "order_id")
    rows = lines.join(one, [STORE, "order_id"], "left_semi")
    per = rows.groupBy(STORE, "order_id").agg(
        F.min_by("product", F.struct("row_seq", "product")).alias("product"),
        F.sum("total").alias("ticket_dec"))
    g = per.groupBy(STORE, "product").agg(F.count(F.lit(1)).alias("orders"), dbl(F.avg("ticket_dec")).alias("avg"))
    g, (least, k) = limits(g, cfg, "min_single_ticket_orders", "top_n_single_ticket_products")
    g = g.filter(F.col("orders") >= least).withColumn("avg_ticket", rnd("avg", 2))
    return top_k(g, k,
                 [F.col("orders").desc(), F.col("avg_ticket").desc(), F.col("product")]).select(
        STORE, "rank", "product", "orders", "avg_ticket")
