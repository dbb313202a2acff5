"""Interactive slice (P21, B1–B7): the report re-aggregated over a date/weekday filter.

Same names as the report modules, different semantics on purpose (SURVEY §2.12):
weekday totals are zero (not null) for absent days; an order is attributed to the day
and hour of its *first* line; cumulative shares are unrounded; profitability uses only
lines that carry a margin and recomputes its medians inside the slice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.config import DAY_ORDER, DEFAULT_REPORT, ReportConfig
from tillsight.operators._common import STORE, dbl, first_value, top_k, weekday_domain
from tillsight.operators import timeline as TL

WEEKEND = ("Sáb", "Dom")


@dataclass(frozen=True)
class SliceFilter:
    date_from: str | None = None
    date_to: str | None = None
    days: tuple[str, ...] = DAY_ORDER
    kind: str = "all"  # all | workdays | weekend


def apply_filter(lines: DataFrame, f: SliceFilter) -> DataFrame:
    """Inclusive dates; weekday in ``days`` (empty → no rows); workdays/weekend."""
    cond = F.col("weekday").isin(*f.days) if f.days else F.lit(False)
    if f.date_from:
        cond = cond & (F.col("sale_date") >= F.lit(f.date_from).cast("date"))
    if f.date_to:
        cond = cond & (F.col("sale_date") <= F.lit(f.date_to).cast("date"))
    if f.kind == "workdays":
        cond = cond & ~F.col("weekday").isin(*WEEKEND)
    elif f.kind == "weekend":
        cond = cond & F.col("weekday").isin(*WEEKEND)
    return lines.filter(cond)


def daily(lines: DataFrame, f: SliceFilter, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """B1."""
    return TL.daily(apply_filter(lines, f), cfg)


def dow(lines: DataFrame, f: SliceFilter, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """B2: zero, not null, for absent weekdays."""
    return TL.dow(apply_filter(lines, f), cfg, zero_fill=True)


def weekly(lines: DataFrame, f: SliceFilter, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """B2: ISO weeks of the slice."""
    return TL.weekly(apply_filter(lines, f), cfg)


def monthly_category(lines: DataFrame, f: SliceFilter, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """B2: month by category of the slice."""
    return TL.monthly_category(apply_filter(lines, f), cfg)


def order_snapshots(lines: DataFrame) -> DataFrame:
    """Per (store, order): first line's date/day/hour, ticket (exact decimal), distinct products."""
    first = F.struct("row_seq", "sale_date", "sale_hour")
    return lines.groupBy(STORE, "order_id").agg(
        F.min_by(F.struct("sale_date", "weekday", "weekday_ix", "sale_hour"), first).alias("f"),
        F.sum("total").alias("ticket"),
        F.count_distinct("product").alias("products_in_cart"),
    ).select(STORE, "order_id", "f.*", "ticket", "products_in_cart")


def heatmap(lines: DataFrame, f: SliceFilter, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """Per (hour, weekday) cell of order snapshots — orders, mean orders per calendar
    weekday in [from, to], mean products per cart, mean ticket.  Every observed hour × 7 days."""
    s = order_snapshots(apply_filter(lines, f))
    cells = s.groupBy(STORE, "sale_hour", "weekday_ix").agg(
        F.count(F.lit(1)).alias("orders"), dbl(F.avg("ticket")).alias("avg_ticket"), F.avg("products_in_cart").alias("avg_items_per_cart"))
    grid = weekday_domain(s.select(STORE, "sale_hour").distinct(), ["sale_hour"])
    lo = F.lit(f.date_from).cast("date") if f.date_from else None
    hi = F.lit(f.date_to).cast("date") if f.date_to else None
    if lo is None or hi is None:
        bounds = lines.groupBy(STORE).agg(F.min("sale_date").alias("lo"), F.max("sale_date").alias("hi"))
    else:
        bounds = s.select(STORE).distinct().select(STORE, lo.alias("lo"), hi.alias("hi"))
    cal = bounds.select(STORE, F.explode(F.sequence("lo", "hi")).alias("d")).groupBy(STORE, F.weekday("d").alias("weekday_ix")).agg(
        F.count(F.lit(1)).alias("n_days"))
    j = grid.join(cells, [STORE, "sale_hour", "weekday_ix"], "left").join(cal, [STORE, "weekday_ix"], "left")
    orders = F.coalesce("orders", F.lit(0)).cast("bigint")
    return j.select(
        STORE, "sale_hour", "weekday_ix", F.col("weekday").alias("day"), orders.alias("orders"),
        F.round(orders / F.coalesce(F.col("n_days"), F.lit(1)), 4).alias("avg_orders_per_day"),
        F.round(F.coalesce("avg_items_per_cart", F.lit(0.0)), 4).alias("avg_items_per_cart"),
        F.round(F.coalesce("avg_ticket", F.lit(0.0)), 4).alias("avg_ticket"))


def products(lines: DataFrame, f: SliceFilter, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """Products by revenue with unrounded share and cumulative share (reported at 4 dp)."""
    x = apply_filter(lines, f)
    g = x.groupBy(STORE, "product").agg(
        dbl(F.sum("total")).alias("revenue"), dbl(F.sum("quantity")).alias("units"),
        F.count_distinct("order_id").alias("orders"), dbl(F.avg("unit_price")).alias("avg_price"),
        first_value("category").alias("category"))
    order = [F.col("revenue").desc(), F.col("product")]
    w_all = Window.partitionBy(STORE)
    w_cum = Window.partitionBy(STORE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    share = F.col("revenue") / F.sum("revenue").over(w_all) * 100.0
    g = g.withColumn("rev_share", share).withColumn("cum_rev_pct", F.sum(share).over(w_cum))
    g = top_k(g, None, order)
    return g.select(STORE, "rank", "product", F.coalesce("category", F.lit("Otros")).alias("category"), "revenue", "units", "orders",
                    F.round("avg_price", 4).alias("avg_price"), F.round("rev_share", 4).alias("rev_share"),
                    F.round("cum_rev_pct", 4).alias("cum_rev_pct"))


def ticket(lines: DataFrame, f: SliceFilter, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """Order tickets attributed to the first line's weekday and hour; per-hour orders
    and mean ticket, baseline, 0.6-quantile cutoff and the unrounded gap of opportunity hours."""
    s = order_snapshots(apply_filter(lines, f))
    h = s.groupBy(STORE, "sale_hour").agg(F.count(F.lit(1)).alias("orders"), dbl(F.avg("ticket")).alias("avg_ticket"))
    base = s.groupBy(STORE).agg(dbl(F.avg("ticket")).alias("baseline"))
    cut = h.groupBy(STORE).agg(F.percentile(dbl("orders"), cfg.opportunity_quantile).alias("cutoff"))
    j = h.join(base, STORE).join(cut, STORE)
    opp = (F.col("orders") >= F.col("cutoff")) & (F.col("avg_ticket") < F.col("baseline"))
    gap = F.when(F.col("baseline") > 0, (F.col("baseline") - F.col("avg_ticket")) / F.col("baseline") * 100.0).otherwise(0.0)
    return j.select(STORE, "sale_hour", "orders", F.round("avg_ticket", 4).alias("avg_ticket"), F.round("baseline", 4).alias("baseline"),
                    F.round("cutoff", 4).alias("cutoff"), opp.alias("is_opportunity"),
                    F.when(opp, F.round(gap, 4)).alias("gap_pct"))


def day_ticket(lines: DataFrame, f: SliceFilter, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """B6 by weekday: all seven days, zero orders and zero mean when absent."""
    s = order_snapshots(apply_filter(lines, f))
    g = s.groupBy(STORE, "weekday_ix").agg(F.count(F.lit(1)).alias("orders"), dbl(F.avg("ticket")).alias("avg_ticket"))
    dom = weekday_domain(s.select(STORE).distinct())
    return dom.join(g, [STORE, "weekday_ix"], "left").select(
        STORE, "weekday_ix", F.col("weekday").alias("day"), F.coalesce("orders", F.lit(0)).cast("bigint").alias("orders"),
        F.round(F.coalesce("avg_ticket", F.lit(0.0)), 4).alias("avg_ticket"))


def profitability(lines: DataFrame, f: SliceFilter, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """Margin lines only; per product revenue/units/orders/mean margin/profit; medians
    and classes inside the slice; profit share and cumulative share; rank in category
    (categories ordered by their best product)."""
    x = apply_filter(lines, f).filter(F.col("margin_pct").isNotNull())
    g = x.groupBy(STORE, "product").agg(
        dbl(F.sum("total")).alias("revenue"), dbl(F.sum("quantity")).alias("units"),
        F.count_distinct("order_id").alias("orders"), F.avg("margin_pct").alias("avg_margin"),
        first_value("category").alias("category"))
    g = g.withColumn("category", F.coalesce("category", F.lit("Otros"))).withColumn("profit", F.col("revenue") * F.col("avg_margin") / 100.0)
    w_all = Window.partitionBy(STORE)
    order = [F.col("profit").desc(), F.col("product")]
    g = (g.withColumn("om", F.median(dbl("orders")).over(w_all)).withColumn("mm", F.median("avg_margin").over(w_all)))
    hv, hm = F.col("orders") >= F.col("om"), F.col("avg_margin") >= F.col("mm")
    g = g.withColumn("class", F.when(hv & hm, "Champion").when(hv, "Tractor").when(hm, "Gem").otherwise("Niche"))
    tot = F.sum("profit").over(w_all)
    share = F.col("profit") / F.when(tot != 0, tot).otherwise(1.0) * 100.0
    g = g.withColumn("profit_share", share).withColumn(
        "cum_profit_pct", F.sum(share).over(Window.partitionBy(STORE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    g = top_k(g, None, order)
    g = g.withColumn("rank_in_category", F.row_number().over(Window.partitionBy(STORE, "category").orderBy(*order))).withColumn(
        "category_first_rank", F.min("rank").over(Window.partitionBy(STORE, "category"))).withColumn(
        "category_orders", F.sum("orders").over(Window.partitionBy(STORE, "category")))
    return g.select(STORE, "rank", "product", "category", "revenue", "units", "orders", F.round("avg_margin", 4).alias("avg_margin"),
                    F.round("profit", 4).alias("profit"), "class", F.round("profit_share", 4).alias("profit_share"),
                    F.round("cum_profit_pct", 4).alias("cum_profit_pct"), "rank_in_category", "category_first_rank", "category_orders",
                    F.round("om", 4).alias("orders_median"), F.round("mm", 4).alias("margin_median"))


def margin_by_category(lines: DataFrame, f: SliceFilter, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    x = apply_filter(lines, f).filter(F.col("margin_pct").isNotNull())
    g = x.groupBy(STORE, F.coalesce("category", F.lit("Otros")).alias("category")).agg(F.avg("margin_pct").alias("avg_margin"))
    return top_k(g, None, [F.col("avg_margin").desc(), F.col("category")]).withColumn("avg_margin", F.round("avg_margin", 4))


def interactive_base(lines: DataFrame) -> DataFrame:
    """The row-level projection the slice re-aggregates (12 columns; margin null
    when absent)."""
    return lines.select(
        STORE, F.date_format("sale_date", "yyyy-MM-dd").alias("date_str"), "year_week", "year_month",
        F.col("weekday").alias("day"), F.col("sale_hour").alias("hour"), "order_id", "product", "category",
        dbl("quantity").alias("quantity"), dbl("unit_price").alias("unit_price"), dbl("total").alias("total"), "margin_pct")
