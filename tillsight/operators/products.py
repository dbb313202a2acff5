"""Products: revenue Pareto, top-N, category totals (sales report ``products`` module)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.config import DEFAULT_REPORT, ReportConfig
from tillsight.operators._common import STORE, category_months, dbl, limits, product_grain, rnd, top_k


def product_stats(lines: DataFrame) -> DataFrame:
    """One row per (store, product): units, revenue (exact decimal), distinct orders,
    mean line unit price, first non-null category."""
    return product_grain(lines).drop("avg_margin", "n_margin")


def products_pareto(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """All products ranked by revenue with cumulative share and the Pareto count.

    ``n_pareto`` counts products whose *rounded* cumulative share is ≤ the threshold
    (at least 1); the product that crosses the threshold is not counted.
    """
    stats = product_stats(lines)
    order = [F.col("revenue_dec").desc(), F.col("product").asc()]
    w_cum = Window.partitionBy(STORE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    w_all = Window.partitionBy(STORE)
    ranked = (
        stats.withColumn("rank", F.row_number().over(Window.partitionBy(STORE).orderBy(*order)))
        .withColumn("cum_dec", F.sum("revenue_dec").over(w_cum))
        .withColumn("store_rev_dec", F.sum("revenue_dec").over(w_all))
        .withColumn("cum_rev_pct", F.round(dbl("cum_dec") / dbl("store_rev_dec") * 100.0, 1))
        .withColumn("rev_share", F.round(dbl("revenue_dec") / dbl("store_rev_dec") * 100.0, 2))
    )
    ranked, (threshold,) = limits(ranked, cfg, "pareto_threshold")
    in_p = F.col("cum_rev_pct") <= threshold
    return ranked.select(
        STORE,
        "rank",
        "product",
        "category",
        dbl("units_dec").alias("units"),
        dbl("revenue_dec").alias("revenue"),
        "orders",
        rnd("avg_price_dec", 2).alias("avg_price"),
        "cum_rev_pct",
        "rev_share",
        in_p.alias("in_pareto"),
        F.greatest(F.count_if(in_p).over(w_all), F.lit(1)).alias("n_pareto"),
        F.count(F.lit(1)).over(w_all).alias("total_products"),
    )


def products_top_n(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    ranked = products_pareto(lines, cfg)
    held, (k,) = limits(ranked, cfg, "top_n_products")
    return held.filter(F.col("rank") <= k).select(*ranked.columns)


def category_totals(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """Revenue per category, descending, with its share of the store."""
    agg = category_months(lines).groupBy(STORE, "category").agg(F.sum("total").alias("revenue_dec"))
    ranked = top_k(agg, None, [F.col("revenue_dec").desc(), F.col("category").asc()])
    return ranked.select(
        STORE, "rank", "category",
        dbl("revenue_dec").alias("revenue"),
        F.round(dbl("revenue_dec") / dbl(F.sum("revenue_dec").over(Window.partitionBy(STORE))) * 100.0, 2).alias("share_pct"),
    )
