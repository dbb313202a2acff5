"""Ticket and opportunity windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.config import DEFAULT_REPORT, ReportConfig
from tillsight.operators._common import STORE, dbl, rnd, slots, top_k, weekday_domain


def order_slots(lines: DataFrame) -> DataFrame:
    """Ticket per (store, order, weekday, hour): an order spanning two hours has two slots."""
    return slots(lines).groupBy(STORE, "order_id", "weekday_ix", "sale_hour").agg(F.sum("total").alias("ticket"))


def day_ticket(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """Distinct orders and mean slot ticket per weekday; all 7 days (closed day: 0 orders, null ticket)."""
    s = order_slots(lines)
    g = s.groupBy(STORE, "weekday_ix").agg(F.count_distinct("order_id").alias("orders"), dbl(F.avg("ticket")).alias("avg"))
    dom = weekday_domain(s.select(STORE).distinct())
    return dom.join(g, [STORE, "weekday_ix"], "left").select(
        STORE, "weekday_ix", F.col("weekday").alias("day"),
        F.coalesce("orders", F.lit(0)).cast("bigint").alias("orders"), rnd("avg", 2).alias("avg_ticket"))


def hour_ticket(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    return hour_ticket_raw(lines).drop("avg_raw")


def hour_ticket_raw(lines: DataFrame) -> DataFrame:
    s = order_slots(lines)
    return s.groupBy(STORE, "sale_hour").agg(
        F.count_distinct("order_id").alias("orders"), dbl(F.avg("ticket")).alias("avg_raw")
    ).withColumn("avg_ticket", rnd("avg_raw", 2))


def opportunity_hours(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """Busy hours with a below-average ticket.

    Busy: orders ≥ the ``opportunity_quantile`` (linear) of hourly orders; below average:
    mean ticket < the store's mean slot ticket.  Gap % 1 dp; top k by orders, gap, hour.
    """
    s = order_slots(lines)
    base = s.groupBy(STORE).agg(dbl(F.avg("ticket")).alias("baseline"))
    h = hour_ticket_raw(lines)
    cut = h.groupBy(STORE).agg(F.percentile(dbl("orders"), cfg.opportunity_quantile).alias("cutoff"))
    j = h.join(base, STORE).join(cut, STORE)
    opp = j.filter((F.col("orders") >= F.col("cutoff")) & (F.col("avg_raw") < F.col("baseline")))
    opp = opp.withColumn("gap_pct", F.when(F.col("baseline") > 0,
                                             F.round((F.col("baseline") - F.col("avg_raw")) / F.col("baseline") * 100.0, 1)).otherwise(0.0))
    return top_k(opp, cfg.opportunity_top_k, [F.col("orders").desc(), F.col("gap_pct").desc(), F.col("sale_hour")]).select(
        STORE, "rank", "sale_hour", "orders", "avg_ticket", "gap_pct", rnd("baseline", 2).alias("baseline_ticket"))
