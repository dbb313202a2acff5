"""Profitability (A18–A26): profit per product from observed margins, profit Pareto,
volume×margin classes, margin by category, margin-weighted pairs, top 5 per category.

Products without any observed margin are excluded (no imputation).  All windows run over
per-product aggregates partitioned by store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.config import DEFAULT_REPORT, ReportConfig
from tillsight.operators._common import STORE, dbl, limits, product_grain, rnd, top_k
from tillsight.operators.basket import high_lift_pairs


def margin_products(lines: DataFrame) -> DataFrame:
    """(store, product): units, revenue (all lines), orders, mean observed margin, category."""
    g = product_grain(lines).drop("avg_price_dec", "n_margin")
    return g.filter(F.col("avg_margin").isNotNull()).withColumn(
        "profit", dbl("revenue_dec") * F.col("avg_margin") / 100.0)


def profitability(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """Products by profit with cumulative/share %, Pareto flag and count, class and thresholds."""
    p = margin_products(lines)
    order = [F.col("profit").desc(), F.col("product")]
    w_all = Window.partitionBy(STORE)
    w_cum = Window.partitionBy(STORE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    p = (
        p.withColumn("rank", F.row_number().over(Window.partitionBy(STORE).orderBy(*order)))
        .withColumn("cum_profit_pct", F.round(F.sum("profit").over(w_cum) / F.sum("profit").over(w_all) * 100.0, 1))
        .withColumn("profit_share", F.round(F.col("profit") / F.sum("profit").over(w_all) * 100.0, 2))
        .withColumn("orders_median", F.median(dbl("orders")).over(w_all))
        .withColumn("margin_median", F.median("avg_margin").over(w_all))
    )
    p, (threshold,) = limits(p, cfg, "margin_pareto_threshold")
    in_p = F.col("cum_profit_pct") <= threshold
    hv, hm = F.col("orders") >= F.col("orders_median"), F.col("avg_margin") >= F.col("margin_median")
    cls = F.when(hv & hm, "Champion").when(hv, "Tractor").when(hm, "Gem").otherwise("Niche")
    return p.select(
        STORE, "rank", "product", "category", dbl("units_dec").alias("units"), dbl("revenue_dec").alias("revenue"),
        "orders", rnd("avg_margin", 4).alias("avg_margin"), rnd("profit", 2).alias("profit"),
        "cum_profit_pct", "profit_share", in_p.alias("in_profit_pareto"),
        F.greatest(F.count_if(in_p).over(w_all), F.lit(1)).alias("n_profit_pareto"),
        cls.alias("class"), rnd("orders_median", 4).alias("orders_median"), rnd("margin_median", 4).alias("margin_median"),
    )


def margin_status(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """One row for every store, margins or not: whether there are any, the share of lines with one (1 dp) and
    the profit Pareto count (0 without margins)."""
    n = lines.groupBy(STORE).agg(F.count(F.lit(1)).alias("n"), F.count("margin_pct").alias("with_margin"))
    pareto = profitability(lines, cfg).groupBy(STORE).agg(F.first("n_profit_pareto").alias("n_profit_pareto"))
    has = F.col("with_margin") > 0
    return n.join(pareto, STORE, "left").select(
        STORE, has.alias("has_margin_data"), has.alias("margin_available"),
        F.round(F.col("with_margin") / F.col("n") * 100.0, 1).alias("margin_row_coverage_pct"),
        F.coalesce("n_profit_pareto", F.lit(0)).cast("bigint").alias("n_profit_pareto"))


def class_counts(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    return profitability(lines, cfg).groupBy(STORE, "class").agg(F.count(F.lit(1)).alias("products"))


def margin_by_category(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """Mean of line margins per category (lines with a margin), descending, plus the
    store's share of lines that carry a margin."""
    w = Window.partitionBy(STORE)
    g = lines.groupBy(STORE, "category").agg(
        F.avg("margin_pct").alias("avg_margin"), F.count("margin_pct").alias("margin_lines"),
        F.count(F.lit(1)).alias("lines"))
    g = g.withColumn("coverage_pct", F.round(F.sum("margin_lines").over(w) / F.sum("lines").over(w) * 100.0, 1))
    g = g.filter(F.col("avg_margin").isNotNull())
    return top_k(g, None, [F.col("avg_margin").desc(), F.col("category")]).select(
        STORE, "rank", "category", rnd("avg_margin", 4).alias("avg_margin"), "coverage_pct")


def margin_weighted_pairs(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """High-lift pairs where both products have margin: ``lift · margin(b) / 100`` (3 dp)."""
    hl = high_lift_pairs(lines, cfg)
    mp = margin_products(lines).select(STORE, "product", "avg_margin")
    a = mp.select(STORE, F.col("product").alias("product_a"))
    b = mp.select(STORE, F.col("product").alias("product_b"), F.col("avg_margin").alias("margin_b"))
    j = hl.join(a, [STORE, "product_a"], "left_semi").join(b, [STORE, "product_b"])
    return j.select(
        STORE, "rank", F.col("product_a").alias("antecedent"), F.col("product_b").alias("consequent"),
        F.col("lift").alias("original_lift"), F.round(F.col("lift") * F.col("margin_b") / 100.0, 3).alias("margin_weighted_score"))


def category_top_profit(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """Top k products by profit inside each category; categories ranked by total orders."""
    p = profitability(lines, cfg)
    p = p.withColumn("category_orders", F.sum("orders").over(Window.partitionBy(STORE, "category")))
    t = top_k(p.drop("rank"), cfg.category_top_k_profit, [F.col("profit").desc(), F.col("product")],
              partition=(STORE, "category"), rank_col="rank_in_category")
    cats = p.select(STORE, "category", "category_orders").distinct()
    cats = top_k(cats, None, [F.col("category_orders").desc(), F.col("category")], rank_col="category_rank")
    return t.join(cats.select(STORE, "category", "category_rank"), [STORE, "category"]).select(
        STORE, "category_rank", "category", "category_orders", "rank_in_category", "product", "profit", "orders", "avg_margin", "class")
