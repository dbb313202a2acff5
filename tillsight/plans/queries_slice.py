"""Registered queries of the interactive slice."""

from __future__ import annotations

from tillsight.config import DAY_ORDER
from tillsight.operators import slice as SL
from tillsight.plans import oracle_sql as O
from tillsight.plans.oracle_sql import R
from tillsight.plans.registry import CFG_A, register, with_ctes
from tillsight.sources import bindings as B

F_EVENTS = SL.SliceFilter("2024-01-05", "2024-01-25", tuple(d for d in DAY_ORDER if d != "Dom"), "all")
F_LINES = SL.SliceFilter("1997-01-01", "1998-12-31", DAY_ORDER, "workdays")


def _where(f: SL.SliceFilter) -> str:
    days = ", ".join(f"'{d}'" for d in f.days) if f.days else "NULL"
    c = [f"weekday IN ({days})"]
    if f.date_from:
        c.append(f"sale_date >= DATE '{f.date_from}'")
    if f.date_to:
        c.append(f"sale_date <= DATE '{f.date_to}'")
    if f.kind == "workdays":
        c.append("weekday NOT IN ('Sáb', 'Dom')")
    elif f.kind == "weekend":
        c.append("weekday IN ('Sáb', 'Dom')")
    return " AND ".join(c)


FB = f"fb AS (SELECT * FROM lines_b WHERE {_where(F_EVENTS)})"
FA = f"fa AS (SELECT * FROM lines_a WHERE {_where(F_LINES)})"
SNAP = """snap AS (SELECT store_id, order_id, arg_min(sale_hour, row_seq) AS sale_hour, arg_min(weekday_ix, row_seq) AS weekday_ix,
                 sum(total) AS ticket, count(DISTINCT product) AS products_in_cart FROM fb GROUP BY 1, 2)"""


@register("slice_daily", with_ctes(O.lines_b(), FB, body=f"""
d AS (SELECT store_id, sale_date, sum(total) AS revenue_dec, count(DISTINCT order_id) AS orders, sum(quantity) AS units_dec FROM fb GROUP BY 1, 2)
SELECT store_id, sale_date, CAST(revenue_dec AS DOUBLE) AS revenue, orders, CAST(units_dec AS DOUBLE) AS units,
       {R('avg(revenue_dec) OVER w', 2)} AS rolling_rev, {R('avg(orders) OVER w', 4)} AS rolling_orders
FROM d WINDOW w AS (PARTITION BY store_id ORDER BY sale_date ROWS BETWEEN {CFG_A.rolling_window - 1} PRECEDING AND CURRENT ROW)"""))
def q_slice_daily(spark, d):
    return SL.daily(B.event_lines(spark, d), F_EVENTS, CFG_A)


@register("slice_dow", with_ctes(O.lines_b(), FB, body=f"""
agg AS (SELECT store_id, weekday_ix, sum(total) AS revenue_dec, count(DISTINCT order_id) AS orders FROM fb GROUP BY 1, 2)
SELECT dom.store_id, dom.weekday_ix, dom.weekday AS day, COALESCE(CAST(revenue_dec AS DOUBLE), 0.0) AS revenue, COALESCE(orders, 0) AS orders
FROM {O.weekday_domain('SELECT DISTINCT store_id FROM agg')} dom LEFT JOIN agg USING (store_id, weekday_ix)"""))
def q_slice_dow(spark, d):
    return SL.dow(B.event_lines(spark, d), F_EVENTS, CFG_A)


@register("slice_weekly", with_ctes(O.lines_a(), FA, body="""
SELECT store_id, year_week, CAST(sum(total) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders,
       CAST(sum(quantity) AS DOUBLE) AS units FROM fa GROUP BY store_id, year_week"""))
def q_slice_weekly(spark, d):
    return SL.weekly(B.tpch_lines(spark, d), F_LINES, CFG_A)


@register("slice_monthly_category", with_ctes(O.lines_a(), FA, body="""
SELECT store_id, year_month AS month, category, CAST(sum(total) AS DOUBLE) AS revenue FROM fa GROUP BY 1, 2, 3"""))
def q_slice_monthly_category(spark, d):
    return SL.monthly_category(B.tpch_lines(spark, d), F_LINES, CFG_A)


@register("slice_heatmap", with_ctes(O.lines_b(), FB, SNAP, body=f"""
cells AS (SELECT store_id, sale_hour, weekday_ix, count(*) AS orders, avg(ticket) AS avg_ticket, avg(products_in_cart) AS avg_items FROM snap GROUP BY 1, 2, 3),
grid AS (SELECT h.store_id, h.sale_hour, dd.weekday_ix, dd.weekday FROM (SELECT DISTINCT store_id, sale_hour FROM snap) h
         JOIN {O.weekday_domain('SELECT DISTINCT store_id FROM snap')} dd USING (store_id)),
cal AS (SELECT CAST(isodow(d) - 1 AS INTEGER) AS weekday_ix, count(*) AS n_days
        FROM (SELECT CAST(unnest(generate_series(DATE '{F_EVENTS.date_from}', DATE '{F_EVENTS.date_to}', INTERVAL 1 DAY)) AS DATE) AS d) GROUP BY 1)
SELECT g.store_id, g.sale_hour, g.weekday_ix, g.weekday AS day, COALESCE(c.orders, 0) AS orders,
       {R('COALESCE(c.orders, 0) / COALESCE(cal.n_days, 1)', 4)} AS avg_orders_per_day,
       {R('COALESCE(c.avg_items, 0.0)', 4)} AS avg_items_per_cart, {R('COALESCE(c.avg_ticket, 0.0)', 4)} AS avg_ticket
FROM grid g LEFT JOIN cells c USING (store_id, sale_hour, weekday_ix) LEFT JOIN cal USING (weekday_ix)"""))
def q_slice_heatmap(spark, d):
    return SL.heatmap(B.event_lines(spark, d), F_EVENTS, CFG_A)


@register("slice_ticket", with_ctes(O.lines_b(), FB, SNAP, body=f"""
h AS (SELECT store_id, sale_hour, count(*) AS orders, avg(ticket) AS avg_ticket FROM snap GROUP BY 1, 2),
b AS (SELECT store_id, avg(ticket) AS baseline FROM snap GROUP BY 1),
c AS (SELECT store_id, quantile_cont(CAST(orders AS DOUBLE), {CFG_A.opportunity_quantile}) AS cutoff FROM h GROUP BY 1),
j AS (SELECT h.*, baseline, cutoff, (orders >= cutoff AND avg_ticket < baseline) AS is_opportunity FROM h JOIN b USING (store_id) JOIN c USING (store_id))
SELECT store_id, sale_hour, orders, {R('avg_ticket', 4)} AS avg_ticket, {R('baseline', 4)} AS baseline, {R('cutoff', 4)} AS cutoff, is_opportunity,
       CASE WHEN is_opportunity THEN {R('CASE WHEN baseline > 0 THEN (baseline - avg_ticket) / baseline * 100.0 ELSE 0.0 END', 4)} END AS gap_pct
FROM j"""))
def q_slice_ticket(spark, d):
    return SL.ticket(B.event_lines(spark, d), F_EVENTS, CFG_A)


@register("slice_day_ticket", with_ctes(O.lines_b(), FB, SNAP, body=f"""
g AS (SELECT store_id, weekday_ix, count(*) AS orders, avg(ticket) AS avg_ticket FROM snap GROUP BY 1, 2)
SELECT dom.store_id, dom.weekday_ix, dom.weekday AS day, COALESCE(g.orders, 0) AS orders, {R('COALESCE(g.avg_ticket, 0.0)', 4)} AS avg_ticket
FROM {O.weekday_domain('SELECT DISTINCT store_id FROM snap')} dom LEFT JOIN g USING (store_id, weekday_ix)"""))
def q_slice_day_ticket(spark, d):
    return SL.day_ticket(B.event_lines(spark, d), F_EVENTS, CFG_A)


@register("slice_products", with_ctes(O.lines_a(), FA, body=f"""
g AS (SELECT store_id, product, CAST(sum(total) AS DOUBLE) AS revenue, CAST(sum(quantity) AS DOUBLE) AS units,
             count(DISTINCT order_id) AS orders, CAST(avg(unit_price) AS DOUBLE) AS avg_price, arg_min(category, row_seq) AS category FROM fa GROUP BY 1, 2),
s AS (SELECT *, revenue / sum(revenue) OVER (PARTITION BY store_id) * 100.0 AS share FROM g)
SELECT store_id, CAST(row_number() OVER (PARTITION BY store_id ORDER BY revenue DESC, product) AS INTEGER) AS rank, product,
       COALESCE(category, 'Otros') AS category, revenue, units, orders, {R('avg_price', 4)} AS avg_price, {R('share', 4)} AS rev_share,
       {R('sum(share) OVER (PARTITION BY store_id ORDER BY revenue DESC, product ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 4)} AS cum_rev_pct
FROM s"""))
def q_slice_products(spark, d):
    return SL.products(B.tpch_lines(spark, d), F_LINES, CFG_A)


@register("slice_profitability", with_ctes(O.lines_a(), FA, body=f"""
g AS (SELECT store_id, product, CAST(sum(total) AS DOUBLE) AS revenue, CAST(sum(quantity) AS DOUBLE) AS units,
             count(DISTINCT order_id) AS orders, avg(margin_pct) AS avg_margin, COALESCE(arg_min(category, row_seq), 'Otros') AS category
      FROM fa WHERE margin_pct IS NOT NULL GROUP BY 1, 2),
p AS (SELECT *, revenue * avg_margin / 100.0 AS profit, median(CAST(orders AS DOUBLE)) OVER (PARTITION BY store_id) AS om,
             median(avg_margin) OVER (PARTITION BY store_id) AS mm FROM g),
q AS (SELECT *, CASE WHEN orders >= om AND avg_margin >= mm THEN 'Champion' WHEN orders >= om THEN 'Tractor'
                     WHEN avg_margin >= mm THEN 'Gem' ELSE 'Niche' END AS class,
             profit / CASE WHEN sum(profit) OVER (PARTITION BY store_id) <> 0 THEN sum(profit) OVER (PARTITION BY store_id) ELSE 1.0 END * 100.0 AS share,
             CAST(row_number() OVER (PARTITION BY store_id ORDER BY profit DESC, product) AS INTEGER) AS rank FROM p),
r AS (SELECT *, sum(share) OVER (PARTITION BY store_id ORDER BY profit DESC, product ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             CAST(row_number() OVER (PARTITION BY store_id, category ORDER BY profit DESC, product) AS INTEGER) AS rank_in_category,
             min(rank) OVER (PARTITION BY store_id, category) AS category_first_rank,
             sum(orders) OVER (PARTITION BY store_id, category) AS category_orders FROM q)
SELECT store_id, rank, product, category, revenue, units, orders, {R('avg_margin', 4)} AS avg_margin, {R('profit', 4)} AS profit, class,
       {R('share', 4)} AS profit_share, {R('cum', 4)} AS cum_profit_pct, rank_in_category, category_first_rank, category_orders,
       {R('om', 4)} AS orders_median, {R('mm', 4)} AS margin_median FROM r"""))
def q_slice_profitability(spark, d):
    return SL.profitability(B.tpch_lines(spark, d), F_LINES, CFG_A)


@register("slice_margin_by_category", with_ctes(O.lines_a(), FA, body=f"""
g AS (SELECT store_id, COALESCE(category, 'Otros') AS category, avg(margin_pct) AS am FROM fa WHERE margin_pct IS NOT NULL GROUP BY 1, 2)
SELECT store_id, category, {R('am', 4)} AS avg_margin,
       CAST(row_number() OVER (PARTITION BY store_id ORDER BY am DESC, category) AS INTEGER) AS rank FROM g"""))
def q_slice_margin_by_category(spark, d):
    return SL.margin_by_category(B.tpch_lines(spark, d), F_LINES, CFG_A)
