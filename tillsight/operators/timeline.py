"""Timeline (A7–A13): daily with trailing means, weekly, weekday, heatmap, hourly,
monthly by category, and peak moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.config import DEFAULT_REPORT, ReportConfig
from tillsight.operators._common import STORE, category_months, dbl, rnd, slots, weekday_domain


def _sales():
    return [F.sum("total").alias("revenue_dec"), F.count_distinct("order_id").alias("orders"),
            F.sum("quantity").alias("units_dec")]


def daily(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """Per (store, date): revenue, orders, units and the trailing ``rolling_window``-row means
    (min one row).  The window runs over daily aggregates partitioned by store."""
    d = slots(lines).groupBy(STORE, "sale_date").agg(*_sales())
    w = Window.partitionBy(STORE).orderBy("sale_date").rowsBetween(-(cfg.rolling_window - 1), 0)
    return d.select(
        STORE, "sale_date",
        dbl("revenue_dec").alias("revenue"), "orders", dbl("units_dec").alias("units"),
        rnd(F.avg("revenue_dec").over(w), 2).alias("rolling_rev"),
        rnd(F.avg("orders").over(w), 4).alias("rolling_orders"),
    )


def weekly(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    w = slots(lines).groupBy(STORE, "year_week").agg(*_sales())
    return w.select(STORE, "year_week", dbl("revenue_dec").alias("revenue"), "orders", dbl("units_dec").alias("units"))


def dow(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT, zero_fill: bool = False) -> DataFrame:
    """Per store and weekday, all seven days in canonical order.

    Absent days give null (the report module) or zero (``zero_fill``, the slice variant)."""
    agg = slots(lines).groupBy(STORE, "weekday_ix").agg(
        F.sum("total").alias("revenue_dec"), F.count_distinct("order_id").alias("orders"))
    dom = weekday_domain(agg.select(STORE).distinct())
    j = dom.join(agg, [STORE, "weekday_ix"], "left")
    rev, orders = dbl("revenue_dec"), F.col("orders")
    if zero_fill:
        rev, orders = F.coalesce(rev, F.lit(0.0)), F.coalesce(orders, F.lit(0)).cast("bigint")
    return j.select(STORE, "weekday_ix", F.col("weekday").alias("day"), rev.alias("revenue"), orders.alias("orders"))


def heatmap(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """Distinct orders per (store, hour, weekday) in long form.

    Rows exist for every hour observed in the store × seven weekdays; a cell is 0 when
    the weekday occurs in the store at another hour, null when it never occurs (the
    pivot's absent column)."""
    cells = slots(lines).groupBy(STORE, "sale_hour", "weekday_ix").agg(F.count_distinct("order_id").alias("orders"))
    hours = cells.select(STORE, "sale_hour").distinct()
    present = cells.select(STORE, "weekday_ix").distinct().withColumn("present", F.lit(True))
    grid = weekday_domain(hours, ["sale_hour"])
    j = grid.join(cells, [STORE, "sale_hour", "weekday_ix"], "left").join(present, [STORE, "weekday_ix"], "left")
    return j.select(
        STORE, "sale_hour", "weekday_ix", F.col("weekday").alias("day"),
        F.when(F.col("present"), F.coalesce("orders", F.lit(0))).cast("bigint").alias("orders"),
    )


def hourly(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    h = slots(lines).groupBy(STORE, "sale_hour").agg(F.sum("total").alias("revenue_dec"), F.count_distinct("order_id").alias("orders"))
    return h.select(STORE, "sale_hour", dbl("revenue_dec").alias("revenue"), "orders")


def monthly_category(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    m = category_months(lines).withColumnRenamed("total", "revenue_dec")
    return m.select(STORE, F.col("year_month").alias("month"), "category", dbl("revenue_dec").alias("revenue"))


def peak_moments(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """Best hour (ties: lowest hour), best weekday (ties: canonical order) and best
    weekday×hour cell (ties: weekday text, then hour) by distinct orders."""
    h = hourly(lines, cfg).groupBy(STORE).agg(
        F.min_by("sale_hour", F.struct(-F.col("orders"), F.col("sale_hour"))).alias("best_hour"))
    held = slots(lines)
    d = held.groupBy(STORE, "weekday_ix", "weekday").agg(F.count_distinct("order_id").alias("orders")).groupBy(STORE).agg(
        F.min_by("weekday", F.struct(-F.col("orders"), F.col("weekday_ix"))).alias("best_day"))
    c = held.groupBy(STORE, "weekday", "sale_hour").agg(F.count_distinct("order_id").alias("orders")).groupBy(STORE).agg(
        F.min_by(F.struct("weekday", "sale_hour", "orders"),
                 F.struct(-F.col("orders"), F.col("weekday"), F.col("sale_hour"))).alias("cell"))
    return h.join(d, STORE).join(c, STORE).select(
        STORE, "best_hour", "best_day",
        F.format_string("%s %d:00", F.col("cell.weekday"), F.col("cell.sale_hour")).alias("best_combo"),
        F.col("cell.orders").alias("best_combo_orders"),
    )
