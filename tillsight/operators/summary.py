"""Summary (A1) and data-quality coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.config import DEFAULT_REPORT, ReportConfig
from tillsight.functions.dates import days_in_month, iso_year_week, year_month
from tillsight.operators._common import STORE, product_grain, rnd, shared, slots, trunc_int
from tillsight.operators.clean import quality_days, quality_of_days


def order_sets(lines: DataFrame) -> DataFrame:
    """One row per (store, order): lines, revenue, units, its products (sorted) and number of categories.

    The sets stand in for distinct counts, which would move every line once per counted column.  An order has
    at most one entry per catalog item.  Written once per report run, for order totals and baskets.
    """
    return shared(lines, "order_sets", lambda: lines.groupBy(STORE, "order_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("total").alias("ticket_dec"),
        F.sum("quantity").alias("items_dec"),
        F.array_sort(F.collect_set("product")).alias("basket"),
        F.size(F.collect_set("category")).cast("bigint").alias("categories"),
    ))


def order_totals(lines: DataFrame) -> DataFrame:
    """One row per (store, order): lines, revenue, units, distinct products/categories.

    The per-order aggregate is the shared input of summary, cart and ticket operators; it is
    shuffled on (store, order), and written once per report run when the run shares intermediates.
    """
    return order_sets(lines).select(STORE, "order_id", "n_lines", "ticket_dec", "items_dec",
                                    F.size("basket").cast("bigint").alias("unique_products"), "categories")


def summary(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    """One row per store: revenue, orders, units, products, multi-line orders, dates."""
    per_order = order_totals(lines)
    s1 = per_order.groupBy(STORE).agg(
        F.sum("ticket_dec").alias("revenue_dec"),
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("items_dec").alias("units_dec"),
        F.count_if(F.col("n_lines") >= 2).alias("multi_item_orders"),
        F.avg("n_lines").alias("avg_lines"),
    )
    s2 = slots(lines).groupBy(STORE).agg(F.min("sale_date").alias("date_min"), F.max("sale_date").alias("date_max"))
    n = product_grain(lines).groupBy(STORE).agg(F.count("product").alias("unique_products"))
    s = s1.join(s2, STORE).join(n, STORE)
    rev_int = trunc_int("revenue_dec")
    return s.select(
        STORE,
        rev_int.alias("total_revenue"),
        "total_orders",
        trunc_int("units_dec").alias("total_units"),
        F.when(F.col("total_orders") > 0, trunc_int(rev_int.cast("double") / F.col("total_orders"))).otherwise(0).alias("avg_ticket"),
        rnd("avg_lines", 1).alias("avg_items_per_order"),
        "unique_products",
        "multi_item_orders",
        F.round(F.col("multi_item_orders") / F.col("total_orders") * 100.0, 1).alias("multi_item_pct"),
        "date_min",
        "date_max",
        F.date_format("date_min", "dd MMM").alias("date_min_label"),
        F.date_format("date_max", "dd MMM yyyy").alias("date_max_label"),
    )


def coverage(lines: DataFrame) -> DataFrame:
    """Per store: observed vs calendar days, missing days, incomplete ISO weeks, partial months."""
    return _coverage_of_days(slots(lines).select(STORE, "sale_date", "year_week", "year_month").distinct())


def _coverage_of_days(days: DataFrame) -> DataFrame:
    """:func:`coverage` of the distinct (store, date) of the lines."""
    span = days.groupBy(STORE).agg(
        F.min("sale_date").alias("date_min"),
        F.max("sale_date").alias("date_max"),
        F.count(F.lit(1)).alias("observed_days"),
    ).withColumn("range_days", F.datediff("date_max", "date_min") + 1)
    weeks = days.groupBy(STORE, "year_week").agg(F.count(F.lit(1)).alias("d")).groupBy(STORE).agg(
        F.count_if(F.col("d") < 7).alias("incomplete_weeks"))
    months = partial_months(days).groupBy(STORE).agg(F.count(F.lit(1)).alias("partial_months"))
    return (
        span.join(weeks, STORE)
        .join(months, STORE, "left")
        .select(
            STORE, "date_min", "date_max", "observed_days", "range_days",
            (F.col("range_days") - F.col("observed_days")).alias("missing_days"),
            "incomplete_weeks",
            F.coalesce("partial_months", F.lit(0)).cast("bigint").alias("partial_months"),
        )
    )


def partial_months(lines_or_days: DataFrame) -> DataFrame:
    """Months with fewer observed days than calendar days: (store, month, observed, month_days)."""
    d = lines_or_days.select(STORE, "sale_date", "year_month").distinct()
    m = d.groupBy(STORE, "year_month").agg(
        F.count_distinct(F.dayofmonth("sale_date")).alias("observed_days"),
        F.max(days_in_month("sale_date")).alias("month_days"),
    )
    return m.filter(F.col("observed_days") < F.col("month_days")).select(
        STORE, F.col("year_month").alias("month"), "observed_days", "month_days")


def incomplete_weeks(lines: DataFrame) -> DataFrame:
    """ISO weeks with fewer than 7 distinct observed dates."""
    w = lines.groupBy(STORE, "year_week").agg(F.count_distinct("sale_date").alias("observed_days"))
    return w.filter(F.col("observed_days") < 7)


def risk_level(dropped_pct, missing_days):
    return (
        F.when((dropped_pct >= 10) | (missing_days > 7), "high")
        .when((dropped_pct >= 3) | (missing_days > 0), "medium")
        .otherwise("low")
    )


def quality_of(typed: DataFrame) -> DataFrame:
    """:func:`quality_coverage` of coerced rows, which are read and parsed once: their counts per day are written."""
    from tillsight.sources.bindings import written

    days = written(quality_days(typed), "quality-days")
    valid = days.filter("valid_rows > 0").select(
        STORE, "sale_date", iso_year_week("sale_date").alias("year_week"), year_month("sale_date").alias("year_month"))
    return _with_coverage(quality_of_days(days), _coverage_of_days(valid))


def quality_coverage(lines: DataFrame, quality: DataFrame) -> DataFrame:
    """Quality counts joined with coverage and the risk level (high when a store has no valid line)."""
    return _with_coverage(quality, coverage(lines))


def _with_coverage(quality: DataFrame, cov: DataFrame) -> DataFrame:
    q = quality.join(cov, STORE, "left")
    return q.select(
        STORE, "initial_rows", "valid_rows", "dropped_rows", "dropped_pct", "invalid_dates",
        "invalid_quantity", "invalid_unit_price", "invalid_total", "invalid_hour",
        "margin_missing", "margin_invalid", "date_min", "date_max", "observed_days", "range_days",
        F.coalesce("missing_days", F.lit(0)).alias("missing_days"),
        F.coalesce("incomplete_weeks", F.lit(0)).alias("incomplete_weeks"),
        F.coalesce("partial_months", F.lit(0)).alias("partial_months"),
        F.when(F.col("valid_rows") == 0, "high").otherwise(
            risk_level(F.col("dropped_pct"), F.coalesce("missing_days", F.lit(0)))).alias("risk_level"),
        F.format_string("Cobertura del %d/%d días entre %s y %s.", "observed_days", "range_days",
                        F.date_format("date_min", "yyyy-MM-dd"), F.date_format("date_max", "yyyy-MM-dd")).alias("coverage_note"),
    )

