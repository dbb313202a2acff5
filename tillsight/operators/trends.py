"""Trends (A46) and anomalous days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.config import DEFAULT_REPORT, ReportConfig
from tillsight.operators._common import STORE, dbl, limits, shared, slots, top_k, trunc_int


def trend_months(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """Per store: months, base month (first) and compare month (last, or next-to-last when
    the last has fewer than ``trend_partial_month_days`` observed days and there are more
    than two months)."""
    m = lines.select(STORE, "year_month", "sale_date").distinct().groupBy(STORE, "year_month").agg(F.count("sale_date").alias("days"))
    w = Window.partitionBy(STORE).orderBy(F.col("year_month").desc())
    m = m.withColumn("from_end", F.row_number().over(w))
    s = m.groupBy(STORE).agg(
        F.count(F.lit(1)).alias("n_months"),
        F.min("year_month").alias("base_month"),
        F.max(F.when(F.col("from_end") == 1, F.col("year_month"))).alias("last_month"),
        F.max(F.when(F.col("from_end") == 1, F.col("days"))).alias("last_days"),
        F.max(F.when(F.col("from_end") == 2, F.col("year_month"))).alias("prev_month"),
    )
    s, (partial_days, least) = limits(s, cfg, "trend_partial_month_days", "trend_min_months")
    cmp = F.when((F.col("last_days") < partial_days) & (F.col("n_months") > 2), F.col("prev_month")).otherwise(F.col("last_month"))
    return s.select(STORE, "n_months", "base_month", cmp.alias("compare_month")).filter(
        F.col("n_months") >= least)


def product_trends(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """Growing and declining products, base month vs compare month.

    Eligible: base revenue ≥ ``trend_min_base_revenue`` and base orders ≥
    ``trend_min_base_orders``; products absent in the compare month drop out; growth %
    kept when |g| > 10; top k up (desc) and down (asc), 1 dp.  Both months come from
    one monthly aggregate with conditional sums (no self join of the line table).
    """
    elig, k, change = _eligible(lines, cfg)
    elig = elig.withColumn("eligible_count", F.count(F.lit(1)).over(Window.partitionBy(STORE)))
    growth = (dbl("cmp_rev") - dbl("base_rev")) / dbl("base_rev") * 100.0
    gr = elig.filter(F.col("cmp_rev").isNotNull()).withColumn("g", growth).filter(F.abs("g") > change)
    up = top_k(gr.filter(F.col("g") > 0), k, [F.col("g").desc(), F.col("product")]).withColumn("direction", F.lit("up"))
    down = top_k(gr.filter(F.col("g") < 0), k, [F.col("g").asc(), F.col("product")]).withColumn("direction", F.lit("down"))
    return up.unionByName(down).select(
        STORE, "direction", "rank", "product", F.round("g", 1).alias("growth_pct"),
        "base_month", "compare_month", "eligible_count")


def _eligible(lines: DataFrame, cfg: ReportConfig) -> tuple[DataFrame, Column, Column]:
    """Products with enough revenue and orders in the base month, and the limits of the lists and of a change."""
    # written: an aggregate is taken for as large as its lines, which would all be moved by store for a row of each
    months = shared(lines, "trend_months", lambda: trend_months(lines, cfg), always=True)
    mp = lines.join(months.select(STORE, "base_month", "compare_month"), STORE).filter(
        (F.col("year_month") == F.col("base_month")) | (F.col("year_month") == F.col("compare_month")))
    is_b, is_c = F.col("year_month") == F.col("base_month"), F.col("year_month") == F.col("compare_month")
    g = mp.groupBy(STORE, "product", "base_month", "compare_month").agg(
        F.sum(F.when(is_b, F.col("total"))).alias("base_rev"),
        F.count_distinct(F.when(is_b, F.col("order_id"))).alias("base_orders"),
        F.sum(F.when(is_c, F.col("total"))).alias("cmp_rev"),
    )
    g, (revenue, orders, change, k) = limits(g, cfg, "trend_min_base_revenue", "trend_min_base_orders",
                                             "trend_min_abs_growth_pct", "trend_top_k")
    return g.filter((dbl("base_rev") >= revenue) & (F.col("base_orders") >= orders)), k, change


def trend_status(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """One row for every store, trends or not: months seen, the two months compared (empty with too few) and how many
    products were eligible (0 if none)."""
    seen = slots(lines).groupBy(STORE).agg(F.count_distinct("year_month").alias("n_months"))
    months = trend_months(lines, cfg).drop("n_months")
    n = _eligible(lines, cfg)[0].groupBy(STORE).agg(F.count(F.lit(1)).alias("eligible_count"))
    return seen.join(months, STORE, "left").join(n, STORE, "left").select(
        STORE, "n_months", F.coalesce("base_month", F.lit("")).alias("base_month"),
        F.coalesce("compare_month", F.lit("")).alias("compare_month"),
        F.coalesce("eligible_count", F.lit(0)).cast("bigint").alias("eligible_count"))


def anomaly_days(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """Days with revenue beyond mean ± k·σ (sample σ) of the store's daily revenue.

    Strict comparisons; top k high (desc) and low (asc); z 1 dp; σ null or 0 → none.
    Mean and σ are per-store windows over *daily* aggregates.
    """
    d = slots(lines).groupBy(STORE, "sale_date").agg(F.sum("total").alias("rev_dec"), F.count_distinct("order_id").alias("orders"))
    w = Window.partitionBy(STORE)
    d = d.withColumn("revenue", dbl("rev_dec")).withColumn("mu", F.avg("revenue").over(w)).withColumn(
        "sd", F.stddev_samp("revenue").over(w))
    d = d.filter(F.col("sd").isNotNull() & (F.col("sd") > 0))
    d, (width, k) = limits(d, cfg, "anomaly_std_threshold", "anomaly_top_k")
    hi = top_k(d.filter(F.col("revenue") > F.col("mu") + width * F.col("sd")), k,
               [F.col("revenue").desc(), F.col("sale_date")]).withColumn("kind", F.lit("high"))
    lo = top_k(d.filter(F.col("revenue") < F.col("mu") - width * F.col("sd")), k,
               [F.col("revenue").asc(), F.col("sale_date")]).withColumn("kind", F.lit("low"))
    return hi.unionByName(lo).select(
        STORE, "kind", "rank", "sale_date", F.date_format("sale_date", "dd MMM").alias("date_label"),
        trunc_int("revenue").alias("revenue"), "orders",
        F.round((F.col("revenue") - F.col("mu")) / F.col("sd"), 1).alias("z_score"),
        trunc_int("mu").alias("avg_daily_revenue"), trunc_int("sd").alias("std_daily_revenue"),
    )
