"""Registered queries of the sales-report modules (A1–A49) over bindings A and B."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.operators import basket as BK
from tillsight.operators import bundles as BU
from tillsight.operators import cart as C
from tillsight.operators import clean as CL
from tillsight.operators import products as P
from tillsight.operators import profitability as PF
from tillsight.operators import summary as S
from tillsight.operators import ticket as TK
from tillsight.operators import timeline as TL
from tillsight.operators import trends as TR
from tillsight.plans import oracle_sql as O
from tillsight.plans.oracle_sql import R, T
from tillsight.plans.registry import CFG_A, CFG_RULES, CFG_TICKETS, register, with_ctes
from tillsight.sources import bindings as B

LA = O.lines_a()
LA_BRAND = O.lines_a("p_brand")
LB = O.lines_b()
CFG_TRENDS = CFG_A.with_(trend_min_base_revenue=100000.0, trend_min_base_orders=3)


def A(spark, d):
    return B.tpch_lines(spark, d)


def A_brand(spark, d):
    return B.tpch_lines(spark, d, "p_brand")


def Bv(spark, d):
    return B.event_lines(spark, d)


# ── products (A14–A17) ──────────────────────────────────────────────────────

@register("products_pareto", with_ctes(LA, body=O.products_pareto()))
def q_products_pareto(spark, d):
    return P.products_pareto(A(spark, d), CFG_A)


@register("products_top_n", with_ctes(LA, body=O.products_pareto(where=f"WHERE rank <= {CFG_A.top_n_products}")))
def q_products_top_n(spark, d):
    return P.products_top_n(A(spark, d), CFG_A)


@register("category_totals", with_ctes(LA, body=f"""
agg AS (SELECT store_id, category, sum(total) AS revenue_dec FROM lines_a GROUP BY store_id, category)
SELECT store_id, CAST(row_number() OVER (PARTITION BY store_id ORDER BY revenue_dec DESC, category) AS INTEGER) AS rank,
       category, CAST(revenue_dec AS DOUBLE) AS revenue,
       {R('CAST(revenue_dec AS DOUBLE) / CAST(sum(revenue_dec) OVER (PARTITION BY store_id) AS DOUBLE) * 100.0', 2)} AS share_pct
FROM agg"""))
def q_category_totals(spark, d):
    return P.category_totals(A(spark, d), CFG_A)


# ── summary and quality (A1–A6, P3–P8) ─────────────────────────────────────

@register("summary", with_ctes(LA, O.order_totals("lines_a"), body=f"""
s1 AS (SELECT store_id, sum(ticket_dec) AS revenue_dec, count(*) AS total_orders, sum(items_dec) AS units_dec,
              count(*) FILTER (WHERE n_lines >= 2) AS multi_item_orders, avg(n_lines) AS avg_lines FROM ot GROUP BY store_id),
s2 AS (SELECT store_id, count(DISTINCT product) AS unique_products, min(sale_date) AS date_min, max(sale_date) AS date_max
       FROM lines_a GROUP BY store_id)
SELECT s1.store_id, {T('revenue_dec')} AS total_revenue, total_orders, {T('units_dec')} AS total_units,
       CASE WHEN total_orders > 0 THEN {T(f"CAST({T('revenue_dec')} AS DOUBLE) / total_orders")} ELSE 0 END AS avg_ticket,
       {R('avg_lines', 1)} AS avg_items_per_order, unique_products, multi_item_orders,
       {R('multi_item_orders / total_orders * 100.0', 1)} AS multi_item_pct,
       date_min, date_max, strftime(date_min, '%d %b') AS date_min_label, strftime(date_max, '%d %b %Y') AS date_max_label
FROM s1 JOIN s2 USING (store_id)"""))
def q_summary(spark, d):
    return S.summary(A(spark, d), CFG_A)


@register("quality_coverage", with_ctes(O.raw_a(), O.typed_a(), body=f"""
q AS (
  SELECT store_id, count(*) AS initial_rows, count(*) FILTER (WHERE motivo_descarte = '') AS valid_rows,
         count(*) FILTER (WHERE sale_date IS NULL) AS invalid_dates, count(*) FILTER (WHERE quantity IS NULL) AS invalid_quantity,
         count(*) FILTER (WHERE unit_price IS NULL) AS invalid_unit_price, count(*) FILTER (WHERE total IS NULL) AS invalid_total,
         count(*) FILTER (WHERE sale_hour IS NULL) AS invalid_hour,
         count(*) FILTER (WHERE margin_state = 'missing') AS margin_missing, count(*) FILTER (WHERE margin_state = 'invalid') AS margin_invalid
  FROM typed_a GROUP BY store_id
), days AS (SELECT DISTINCT store_id, sale_date, year_week, year_month FROM typed_a_clean
), span AS (SELECT store_id, min(sale_date) AS date_min, max(sale_date) AS date_max, count(*) AS observed_days,
                   date_diff('day', min(sale_date), max(sale_date)) + 1 AS range_days FROM days GROUP BY store_id
), wk AS (SELECT store_id, count(*) FILTER (WHERE d < 7) AS incomplete_weeks
          FROM (SELECT store_id, year_week, count(*) AS d FROM days GROUP BY 1, 2) GROUP BY store_id
), pm AS (SELECT store_id, count(*) AS partial_months FROM (
            SELECT store_id, year_month, count(DISTINCT day(sale_date)) AS od, max(day(last_day(sale_date))) AS md
            FROM days GROUP BY 1, 2) WHERE od < md GROUP BY store_id)
SELECT q.store_id, initial_rows, valid_rows, initial_rows - valid_rows AS dropped_rows,
       CASE WHEN initial_rows = 0 THEN 0.0 ELSE {R('CAST(initial_rows - valid_rows AS DOUBLE) / CAST(initial_rows AS DOUBLE) * 100.0', 2)} END AS dropped_pct,
       invalid_dates, invalid_quantity, invalid_unit_price, invalid_total, invalid_hour, margin_missing, margin_invalid,
       date_min, date_max, observed_days, range_days, COALESCE(range_days - observed_days, 0) AS missing_days,
       COALESCE(incomplete_weeks, 0) AS incomplete_weeks, COALESCE(partial_months, 0) AS partial_months,
       CASE WHEN valid_rows = 0 THEN 'high'
            WHEN {R('CAST(initial_rows - valid_rows AS DOUBLE) / CAST(initial_rows AS DOUBLE) * 100.0', 2)} >= 10 OR COALESCE(range_days - observed_days, 0) > 7 THEN 'high'
            WHEN {R('CAST(initial_rows - valid_rows AS DOUBLE) / CAST(initial_rows AS DOUBLE) * 100.0', 2)} >= 3 OR COALESCE(range_days - observed_days, 0) > 0 THEN 'medium'
            ELSE 'low' END AS risk_level,
       printf('Cobertura del %d/%d días entre %s y %s.', observed_days, range_days,
              strftime(date_min, '%Y-%m-%d'), strftime(date_max, '%Y-%m-%d')) AS coverage_note
FROM q LEFT JOIN span USING (store_id) LEFT JOIN wk USING (store_id) LEFT JOIN pm USING (store_id)"""))
def q_quality_coverage(spark, d):
    # counts and coverage read the rows' days, not their numbers
    return S.quality_of(CL.coerce(B.raw_pos_lines_plan(spark, d, numbered=False)))


@register("discard_reasons", with_ctes(O.raw_a(), O.typed_a(), body="""
SELECT store_id, motivo_descarte, count(*) AS "rows" FROM typed_a WHERE motivo_descarte <> '' GROUP BY store_id, motivo_descarte"""))
def q_discard_reasons(spark, d):
    _, discarded, _ = CL.sanitize(B.raw_pos_lines_plan(spark, d), CFG_A)  # read once: not written
    return CL.discard_reasons(discarded)


@register("margin_parse", with_ctes(O.raw_a(), O.typed_a(), body=f"""
SELECT store_id, count(*) FILTER (WHERE margin_state = 'present') AS margin_present,
       count(*) FILTER (WHERE margin_state = 'missing') AS margin_missing,
       count(*) FILTER (WHERE margin_state = 'invalid') AS margin_invalid,
       {R('sum(margin_pct)', 2)} AS margin_sum, {R('avg(margin_pct)', 4)} AS margin_avg
FROM typed_a GROUP BY store_id"""))
def q_margin_parse(spark, d):
    return CL.margin_parse_stats(CL.coerce(B.raw_pos_lines_plan(spark, d)))  # read once: not written


@register("incomplete_weeks", with_ctes(LA, body="""
SELECT store_id, year_week, count(DISTINCT sale_date) AS observed_days FROM lines_a GROUP BY store_id, year_week
HAVING count(DISTINCT sale_date) < 7"""))
def q_incomplete_weeks(spark, d):
    return S.incomplete_weeks(A(spark, d))


@register("partial_months", with_ctes(LA, body="""
SELECT store_id, year_month AS month, count(DISTINCT day(sale_date)) AS observed_days, max(day(last_day(sale_date))) AS month_days
FROM lines_a GROUP BY store_id, year_month HAVING count(DISTINCT day(sale_date)) < max(day(last_day(sale_date)))"""))
def q_partial_months(spark, d):
    return S.partial_months(A(spark, d))


# ── timeline (A7–A13) ───────────────────────────────────────────────────────

@register("daily_rolling", with_ctes(LA, body=f"""
d AS (SELECT store_id, sale_date, sum(total) AS revenue_dec, count(DISTINCT order_id) AS orders, sum(quantity) AS units_dec
      FROM lines_a GROUP BY store_id, sale_date)
SELECT store_id, sale_date, CAST(revenue_dec AS DOUBLE) AS revenue, orders, CAST(units_dec AS DOUBLE) AS units,
       {R('avg(revenue_dec) OVER w', 2)} AS rolling_rev, {R('avg(orders) OVER w', 4)} AS rolling_orders
FROM d WINDOW w AS (PARTITION BY store_id ORDER BY sale_date ROWS BETWEEN {CFG_A.rolling_window - 1} PRECEDING AND CURRENT ROW)"""))
def q_daily_rolling(spark, d):
    return TL.daily(A(spark, d), CFG_A)


@register("weekly_sales", with_ctes(LA, body="""
SELECT store_id, year_week, CAST(sum(total) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders,
       CAST(sum(quantity) AS DOUBLE) AS units FROM lines_a GROUP BY store_id, year_week"""))
def q_weekly_sales(spark, d):
    return TL.weekly(A(spark, d), CFG_A)


@register("dow_sales", with_ctes(LA, body=f"""
agg AS (SELECT store_id, weekday_ix, sum(total) AS revenue_dec, count(DISTINCT order_id) AS orders FROM lines_a GROUP BY 1, 2)
SELECT dom.store_id, dom.weekday_ix, dom.weekday AS day, CAST(revenue_dec AS DOUBLE) AS revenue, orders
FROM {O.weekday_domain('SELECT DISTINCT store_id FROM agg')} dom LEFT JOIN agg USING (store_id, weekday_ix)"""))
def q_dow_sales(spark, d):
    return TL.dow(A(spark, d), CFG_A)


@register("monthly_category", with_ctes(LA, body="""
SELECT store_id, year_month AS month, category, CAST(sum(total) AS DOUBLE) AS revenue FROM lines_a GROUP BY 1, 2, 3"""))
def q_monthly_category(spark, d):
    return TL.monthly_category(A(spark, d), CFG_A)


@register("hour_day_heatmap", with_ctes(LB, body=f"""
cells AS (SELECT store_id, sale_hour, weekday_ix, count(DISTINCT order_id) AS orders FROM lines_b GROUP BY 1, 2, 3),
present AS (SELECT DISTINCT store_id, weekday_ix FROM cells),
grid AS (SELECT h.store_id, h.sale_hour, dd.weekday_ix, dd.weekday FROM (SELECT DISTINCT store_id, sale_hour FROM cells) h
         JOIN {O.weekday_domain('SELECT DISTINCT store_id FROM cells')} dd USING (store_id))
SELECT g.store_id, g.sale_hour, g.weekday_ix, g.weekday AS day,
       CASE WHEN p.store_id IS NOT NULL THEN COALESCE(c.orders, 0) END AS orders
FROM grid g LEFT JOIN cells c USING (store_id, sale_hour, weekday_ix) LEFT JOIN present p USING (store_id, weekday_ix)"""))
def q_hour_day_heatmap(spark, d):
    return TL.heatmap(Bv(spark, d))


@register("hourly_sales", with_ctes(LB, body="""
SELECT store_id, sale_hour, CAST(sum(total) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders FROM lines_b GROUP BY 1, 2"""))
def q_hourly_sales(spark, d):
    return TL.hourly(Bv(spark, d))


@register("peak_moments", with_ctes(LB, body="""
h AS (SELECT store_id, sale_hour AS best_hour FROM (SELECT store_id, sale_hour, count(DISTINCT order_id) AS o FROM lines_b GROUP BY 1, 2)
      QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY o DESC, sale_hour) = 1),
dd AS (SELECT store_id, weekday AS best_day FROM (SELECT store_id, weekday_ix, weekday, count(DISTINCT order_id) AS o FROM lines_b GROUP BY 1, 2, 3)
      QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY o DESC, weekday_ix) = 1),
c AS (SELECT store_id, weekday, sale_hour, o FROM (SELECT store_id, weekday, sale_hour, count(DISTINCT order_id) AS o FROM lines_b GROUP BY 1, 2, 3)
      QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY o DESC, weekday, sale_hour) = 1)
SELECT store_id, best_hour, best_day, weekday || ' ' || CAST(sale_hour AS VARCHAR) || ':00' AS best_combo, o AS best_combo_orders
FROM h JOIN dd USING (store_id) JOIN c USING (store_id)"""))
def q_peak_moments(spark, d):
    return TL.peak_moments(Bv(spark, d))


# ── basket (A27–A32) ────────────────────────────────────────────────────────

KEEP = 2 * CFG_A.top_n_pairs


@register("basket_pairs", with_ctes(LA, O.basket("lines_a"), O.product_pairs(KEEP), body=f"""
SELECT * FROM pairs WHERE rank <= {CFG_A.top_n_pairs}"""))
def q_basket_pairs(spark, d):
    return BK.product_pairs(A(spark, d), CFG_A).filter(f"rank <= {CFG_A.top_n_pairs}")


@register("pair_lift_bands", with_ctes(LA, O.basket("lines_a"), O.product_pairs(KEEP), body=f"""
SELECT *, CASE WHEN lift >= 1.5 THEN 'strong' WHEN lift >= 1.0 THEN 'moderate' ELSE 'negative' END AS band
FROM pairs WHERE rank <= {CFG_A.top_n_pairs}"""))
def q_pair_lift_bands(spark, d):
    return BK.pairs_with_bands(A(spark, d), CFG_A)


@register("category_pairs", with_ctes(LA, O.basket("lines_a", "category"), body=f"""
SELECT store_id, CAST(row_number() OVER (PARTITION BY store_id ORDER BY "count" DESC, item_a, item_b) AS INTEGER) AS rank,
       item_a AS cat_a, item_b AS cat_b, "count"
FROM pc QUALIFY rank <= {CFG_A.cat_pairs_top_k}"""))
def q_category_pairs(spark, d):
    return BK.category_pairs(A(spark, d), CFG_A)


def _high_lift_sql(thr: float, k: int) -> str:
    return f"""hl AS (
  SELECT store_id, product_a, product_b, "count", support, lift, total_baskets,
         CAST(row_number() OVER (PARTITION BY store_id ORDER BY "count" DESC, product_a, product_b) AS INTEGER) AS rank
  FROM pairs WHERE lift >= {thr} QUALIFY rank <= {k})"""


@register("high_lift_pairs", with_ctes(LA, O.basket("lines_a"), O.product_pairs(KEEP),
                                       _high_lift_sql(CFG_RULES.high_lift_threshold, CFG_RULES.high_lift_top_k), body="SELECT * FROM hl"))
def q_high_lift_pairs(spark, d):
    return BK.high_lift_pairs(A(spark, d), CFG_RULES)


@register("association_rules", with_ctes(LA_BRAND, O.basket("lines_a"),
                                         O.rules(CFG_RULES.rule_min_count, CFG_RULES.rule_min_confidence, CFG_RULES.rule_top_k),
                                         body="SELECT * FROM rules"))
def q_association_rules(spark, d):
    return BK.rules(A_brand(spark, d), CFG_RULES)


# ── bundles (A33–A37b) ──────────────────────────────────────────────────────

def _bundle_sql() -> str:
    c = CFG_RULES
    return ",\n".join([
        LA_BRAND, O.basket("lines_a"), O.rules(c.rule_min_count, c.rule_min_confidence, c.rule_top_k),
        O.profitability("lines_a"),
        f"""st AS (SELECT store_id, product AS item, avg(margin_pct) AS avg_margin, arg_min(category, row_seq) AS category FROM lines_a GROUP BY 1, 2
), hm AS (SELECT store_id, count(margin_pct) > 0 AS has_margin FROM lines_a GROUP BY 1
), med AS (SELECT store_id, min(margin_median_raw) AS margin_median FROM prof GROUP BY 1
), bj AS (
  SELECT r.store_id, r.antecedent AS anchor, r.consequent AS target, a.category AS anchor_category, b.category AS target_category,
         COALESCE(pa.class, 'Unknown') AS anchor_class, COALESCE(pb.class, 'Unknown') AS target_class,
         r."count", r.support, r.confidence, r.lift, r.conviction, a.avg_margin AS am, b.avg_margin AS bm,
         hm.has_margin, med.margin_median
  FROM rules r JOIN st a ON a.store_id = r.store_id AND a.item = r.antecedent
  JOIN st b ON b.store_id = r.store_id AND b.item = r.consequent
  LEFT JOIN prof pa ON pa.store_id = r.store_id AND pa.product = r.antecedent
  LEFT JOIN prof pb ON pb.store_id = r.store_id AND pb.product = r.consequent
  LEFT JOIN hm ON hm.store_id = r.store_id LEFT JOIN med ON med.store_id = r.store_id
), bs0 AS (
  SELECT store_id, anchor, target, anchor_category, target_category, anchor_class, target_class,
         "count", support, confidence, lift, conviction,
         {R('bm', 2)} AS target_margin, {R('(COALESCE(am, bm) + COALESCE(bm, am)) / 2.0', 2)} AS combined_margin,
         {R('confidence * lift * ln("count" + 1)', 3)} AS adoption_score,
         {R('confidence * lift * ln("count" + 1) * CASE WHEN bm IS NOT NULL THEN 1 + greatest(0.0, bm) / 100.0 ELSE 1.0 END', 3)} AS margin_score,
         (confidence >= {c.launch_min_confidence} AND "count" >= {c.launch_min_count}
          AND (NOT COALESCE(has_margin, false) OR (bm IS NOT NULL AND margin_median IS NOT NULL AND bm >= margin_median))) AS launch_ready
  FROM bj
), bs AS (
  SELECT *, {R('''0.5 * CASE WHEN max(adoption_score) OVER s > min(adoption_score) OVER s
                    THEN (adoption_score - min(adoption_score) OVER s) / (max(adoption_score) OVER s - min(adoption_score) OVER s) ELSE 0.5 END
             + 0.5 * CASE WHEN max(margin_score) OVER s > min(margin_score) OVER s
                    THEN (margin_score - min(margin_score) OVER s) / (max(margin_score) OVER s - min(margin_score) OVER s) ELSE 0.5 END''', 3)} AS balanced_score
  FROM bs0 WINDOW s AS (PARTITION BY store_id))"""])


@register("bundle_scores", f"WITH {_bundle_sql()}\nSELECT * FROM bs")
def q_bundle_scores(spark, d):
    return BU.bundle_scores(A_brand(spark, d), CFG_RULES)


@register("bundle_launch_ready", f"""WITH {_bundle_sql()}
SELECT *, CAST(row_number() OVER (PARTITION BY store_id ORDER BY balanced_score DESC, confidence DESC, "count" DESC, anchor, target) AS INTEGER) AS rank
FROM bs WHERE launch_ready QUALIFY rank <= {CFG_RULES.launch_top_k}""")
def q_bundle_launch_ready(spark, d):
    return BU.launch_ready(A_brand(spark, d), CFG_RULES)


@register("bundle_test_candidates", f"""WITH {_bundle_sql()}
SELECT *, CAST(row_number() OVER (PARTITION BY store_id ORDER BY lift DESC, confidence DESC, "count" DESC, anchor, target) AS INTEGER) AS rank
FROM bs WHERE NOT launch_ready QUALIFY rank <= {CFG_RULES.test_top_k}""")
def q_bundle_test_candidates(spark, d):
    return BU.test_candidates(A_brand(spark, d), CFG_RULES)


_RANK_COLS = 'store_id, list, rank, anchor, target, "count", confidence, lift, adoption_score, margin_score, balanced_score, target_margin, launch_ready'


@register("bundle_rankings", f"""WITH {_bundle_sql()},
lists AS (
  SELECT *, 'balanced' AS list, CAST(row_number() OVER (PARTITION BY store_id ORDER BY balanced_score DESC, confidence DESC, anchor, target) AS INTEGER) AS rank FROM bs
  UNION ALL
  SELECT *, 'margin_focus', CAST(row_number() OVER (PARTITION BY store_id ORDER BY margin_score DESC, target_margin DESC NULLS LAST, confidence DESC, anchor, target) AS INTEGER) FROM bs
  UNION ALL
  SELECT *, 'conversion_focus', CAST(row_number() OVER (PARTITION BY store_id ORDER BY confidence DESC, "count" DESC, lift DESC, anchor, target) AS INTEGER) FROM bs
), feat AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY store_id ORDER BY balanced_score DESC, confidence DESC, "count" DESC, anchor, target) AS INTEGER) AS rank, 0 AS src FROM bs WHERE launch_ready
  UNION ALL
  SELECT *, CAST(row_number() OVER (PARTITION BY store_id ORDER BY balanced_score DESC, confidence DESC, anchor, target) AS INTEGER), 1 FROM bs
)
SELECT {_RANK_COLS} FROM lists WHERE rank <= {CFG_RULES.ranking_top_k}
UNION ALL
SELECT store_id, 'featured' AS list, rank, anchor, target, "count", confidence, lift, adoption_score, margin_score, balanced_score, target_margin, launch_ready
FROM feat WHERE rank <= {CFG_RULES.featured_top_k} QUALIFY src = min(src) OVER (PARTITION BY store_id)""")
def q_bundle_rankings(spark, d):
    return BU.rankings(A_brand(spark, d), CFG_RULES)


# ── cart and ticket (A38–A45) ───────────────────────────────────────────────

@register("cart_distribution", with_ctes(LA, O.order_totals("lines_a"), body="""
SELECT store_id, unique_products AS products_in_cart, count(*) AS "count" FROM ot GROUP BY 1, 2"""))
def q_cart_distribution(spark, d):
    return C.cart_distribution(A(spark, d))


@register("ticket_stats", with_ctes(LA, O.order_totals("lines_a"), body=f"""
o AS (SELECT store_id, CAST(ticket_dec AS DOUBLE) AS t FROM ot)
SELECT store_id, count(*) AS orders, {T('avg(t)')} AS mean, {T('quantile_cont(t, 0.5)')} AS median,
       {T('quantile_cont(t, 0.25)')} AS p25, {T('quantile_cont(t, 0.75)')} AS p75, {T('max(t)')} AS max
FROM o GROUP BY store_id"""))
def q_ticket_stats(spark, d):
    return C.ticket_stats(A(spark, d))


def _bucket_case(bins, col="t") -> str:
    parts = " ".join(f"WHEN {col} > {bins[i]} AND {col} <= {bins[i + 1]} THEN {i}" for i in range(len(bins) - 1))
    return f"CASE {parts} END"


@register("ticket_buckets", with_ctes(LA, O.order_totals("lines_a"), body=f"""
o AS (SELECT store_id, {_bucket_case(CFG_TICKETS.ticket_bins, 'CAST(ticket_dec AS DOUBLE)')} AS bucket_ix FROM ot),
c AS (SELECT store_id, bucket_ix, count(*) AS n FROM o WHERE bucket_ix IS NOT NULL GROUP BY 1, 2),
dom AS (SELECT s.store_id, b.bucket_ix, b.bucket FROM (SELECT DISTINCT store_id FROM ot) s CROSS JOIN
        (SELECT CAST(i AS INTEGER) AS bucket_ix, {list(CFG_TICKETS.ticket_labels)}[i + 1] AS bucket FROM range({len(CFG_TICKETS.ticket_labels)}) t(i)) b)
SELECT dom.store_id, dom.bucket_ix, dom.bucket, COALESCE(c.n, 0) AS "count" FROM dom LEFT JOIN c USING (store_id, bucket_ix)"""))
def q_ticket_buckets(spark, d):
    return C.ticket_buckets(A(spark, d), CFG_TICKETS)


@register("cart_weekly", with_ctes(LA, body=f"""
per AS (SELECT store_id, year_week, order_id, count(*) AS items FROM lines_a GROUP BY 1, 2, 3)
SELECT store_id, year_week AS week, {R('avg(items)', 4)} AS avg_items FROM per GROUP BY 1, 2"""))
def q_cart_weekly(spark, d):
    return C.cart_weekly(A(spark, d))


@register("cart_segments", with_ctes(LB, O.order_totals("lines_b"), body=f"""
s AS (SELECT store_id, count(*) AS n,
             count(*) FILTER (WHERE items_dec = 1) AS o1, avg(ticket_dec) FILTER (WHERE items_dec = 1) AS t1,
             count(*) FILTER (WHERE items_dec >= 2) AS o2, avg(ticket_dec) FILTER (WHERE items_dec >= 2) AS t2
      FROM ot GROUP BY store_id),
x AS (SELECT store_id, n, '1 unidad' AS segment, o1 AS orders, t1 AS av FROM s
      UNION ALL SELECT store_id, n, '2+ unidades', o2, t2 FROM s)
SELECT store_id, segment, orders, CASE WHEN n > 0 THEN {R('orders / n * 100.0', 1)} ELSE 0.0 END AS share_pct,
       COALESCE({R('av', 2)}, 0.0) AS avg_ticket FROM x"""))
def q_cart_segments(spark, d):
    return C.cart_segments(Bv(spark, d))


@register("multi_buckets", with_ctes(LB, O.order_totals("lines_b"), body=f"""
b AS (SELECT store_id, ticket_dec AS t,
             CASE WHEN items_dec >= 4 THEN '4+ unidades' ELSE CAST(CAST(trunc(CAST(items_dec AS DOUBLE)) AS BIGINT) AS VARCHAR) || ' unidades' END AS bucket,
             CAST(CASE WHEN items_dec >= 4 THEN 2 ELSE CAST(trunc(CAST(items_dec AS DOUBLE)) AS BIGINT) - 2 END AS INTEGER) AS bucket_ix
      FROM ot WHERE items_dec >= 2),
g AS (SELECT store_id, bucket_ix, bucket, count(*) AS orders, avg(t) AS av FROM b GROUP BY 1, 2, 3)
SELECT store_id, bucket_ix, bucket, orders, {R('av', 2)} AS avg_ticket,
       {R('orders / sum(orders) OVER (PARTITION BY store_id) * 100.0', 2)} AS share_multi_pct FROM g"""))
def q_multi_buckets(spark, d):
    return C.multi_buckets(Bv(spark, d))


@register("single_unit_products", with_ctes(LB, O.order_totals("lines_b"), body=f"""
per AS (SELECT l.store_id, l.order_id, arg_min(l.product, l.row_seq) AS product, sum(l.total) AS ticket_dec
        FROM lines_b l JOIN ot ON ot.store_id = l.store_id AND ot.order_id = l.order_id AND ot.items_dec = 1
        GROUP BY 1, 2),
g AS (SELECT store_id, product, count(*) AS orders, {R('avg(ticket_dec)', 2)} AS avg_ticket FROM per GROUP BY 1, 2
      HAVING count(*) >= {CFG_A.min_single_ticket_orders})
SELECT store_id, CAST(row_number() OVER (PARTITION BY store_id ORDER BY orders DESC, avg_ticket DESC, product) AS INTEGER) AS rank,
       product, orders, avg_ticket FROM g QUALIFY rank <= {CFG_A.top_n_single_ticket_products}"""))
def q_single_unit_products(spark, d):
    return C.single_unit_products(Bv(spark, d), CFG_A)


# ── trends and anomalies (A46–A47) ──────────────────────────────────────────

@register("product_trends", with_ctes(LA_BRAND, body=f"""
m AS (SELECT store_id, year_month, count(DISTINCT sale_date) AS days,
             row_number() OVER (PARTITION BY store_id ORDER BY year_month DESC) AS from_end FROM lines_a GROUP BY 1, 2),
mo AS (SELECT store_id, count(*) AS n_months, min(year_month) AS base_month,
              max(year_month) FILTER (WHERE from_end = 1) AS last_month, max(days) FILTER (WHERE from_end = 1) AS last_days,
              max(year_month) FILTER (WHERE from_end = 2) AS prev_month FROM m GROUP BY 1),
mm AS (SELECT store_id, base_month, CASE WHEN last_days < {CFG_TRENDS.trend_partial_month_days} AND n_months > 2 THEN prev_month ELSE last_month END AS compare_month
       FROM mo WHERE n_months >= {CFG_TRENDS.trend_min_months}),
g AS (SELECT l.store_id, l.product, mm.base_month, mm.compare_month,
             sum(total) FILTER (WHERE year_month = base_month) AS base_rev,
             count(DISTINCT order_id) FILTER (WHERE year_month = base_month) AS base_orders,
             sum(total) FILTER (WHERE year_month = compare_month) AS cmp_rev
      FROM lines_a l JOIN mm USING (store_id) WHERE year_month = base_month OR year_month = compare_month GROUP BY 1, 2, 3, 4),
el AS (SELECT *, count(*) OVER (PARTITION BY store_id) AS eligible_count FROM g
       WHERE CAST(base_rev AS DOUBLE) >= {CFG_TRENDS.trend_min_base_revenue} AND base_orders >= {CFG_TRENDS.trend_min_base_orders}),
gr AS (SELECT *, (CAST(cmp_rev AS DOUBLE) - CAST(base_rev AS DOUBLE)) / CAST(base_rev AS DOUBLE) * 100.0 AS gv FROM el
       WHERE cmp_rev IS NOT NULL AND abs((CAST(cmp_rev AS DOUBLE) - CAST(base_rev AS DOUBLE)) / CAST(base_rev AS DOUBLE) * 100.0) > {CFG_TRENDS.trend_min_abs_growth_pct}),
up AS (SELECT *, 'up' AS direction, CAST(row_number() OVER (PARTITION BY store_id ORDER BY gv DESC, product) AS INTEGER) AS rank FROM gr WHERE gv > 0 QUALIFY rank <= {CFG_TRENDS.trend_top_k}),
dn AS (SELECT *, 'down' AS direction, CAST(row_number() OVER (PARTITION BY store_id ORDER BY gv ASC, product) AS INTEGER) AS rank FROM gr WHERE gv < 0 QUALIFY rank <= {CFG_TRENDS.trend_top_k})
SELECT store_id, direction, rank, product, {R('gv', 1)} AS growth_pct, base_month, compare_month, eligible_count
FROM (SELECT * FROM up UNION ALL SELECT * FROM dn)"""))
def q_product_trends(spark, d):
    return TR.product_trends(A_brand(spark, d), CFG_TRENDS)


@register("trend_status", with_ctes(LA_BRAND, body=f"""
l AS (SELECT * FROM lines_a WHERE store_id <> 'S3' OR year_month = '1998-05'),
m AS (SELECT store_id, year_month, count(DISTINCT sale_date) AS days,
             row_number() OVER (PARTITION BY store_id ORDER BY year_month DESC) AS from_end FROM l GROUP BY 1, 2),
mo AS (SELECT store_id, count(*) AS n_months, min(year_month) AS base_month,
              max(year_month) FILTER (WHERE from_end = 1) AS last_month, max(days) FILTER (WHERE from_end = 1) AS last_days,
              max(year_month) FILTER (WHERE from_end = 2) AS prev_month FROM m GROUP BY 1),
mm AS (SELECT *, CASE WHEN last_days < {CFG_TRENDS.trend_partial_month_days} AND n_months > 2 THEN prev_month ELSE last_month END AS compare_month
       FROM mo WHERE n_months >= {CFG_TRENDS.trend_min_months}),
e AS (SELECT l.store_id, l.product FROM l JOIN mm USING (store_id) WHERE year_month = base_month GROUP BY 1, 2
      HAVING CAST(sum(total) AS DOUBLE) >= {CFG_TRENDS.trend_min_base_revenue} AND count(DISTINCT order_id) >= {CFG_TRENDS.trend_min_base_orders})
SELECT mo.store_id, mo.n_months, COALESCE(mm.base_month, '') AS base_month, COALESCE(mm.compare_month, '') AS compare_month,
       (SELECT count(*) FROM e WHERE e.store_id = mo.store_id) AS eligible_count
FROM mo LEFT JOIN mm USING (store_id)"""))
def q_trend_status(spark, d):
    """A store of one month has no trends but a row that says so."""
    lines = A_brand(spark, d).where("store_id <> 'S3' OR year_month = '1998-05'")
    return TR.trend_status(lines, CFG_TRENDS)


@register("margin_status", with_ctes(LA, body=f"""
l AS (SELECT * REPLACE (CASE WHEN store_id <> 'S2' THEN margin_pct END AS margin_pct) FROM lines_a),
{O.profitability('l')}
SELECT l.store_id, count(margin_pct) > 0 AS has_margin_data, count(margin_pct) > 0 AS margin_available,
       {R('count(margin_pct) / count(*) * 100.0', 1)} AS margin_row_coverage_pct,
       COALESCE((SELECT max(n_profit_pareto) FROM prof WHERE prof.store_id = l.store_id), 0) AS n_profit_pareto
FROM l GROUP BY 1"""))
def q_margin_status(spark, d):
    """A store without any margin has empty profit modules and a row that says so."""
    lines = A(spark, d).withColumn("margin_pct", F.when(F.col("store_id") != "S2", F.col("margin_pct")))
    return PF.margin_status(lines)


@register("anomaly_days", with_ctes(LA, body=f"""
d AS (SELECT store_id, sale_date, CAST(sum(total) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders FROM lines_a GROUP BY 1, 2),
s AS (SELECT *, avg(revenue) OVER (PARTITION BY store_id) AS mu, stddev_samp(revenue) OVER (PARTITION BY store_id) AS sd FROM d),
f AS (SELECT * FROM s WHERE sd IS NOT NULL AND sd > 0),
hi AS (SELECT *, 'high' AS kind, CAST(row_number() OVER (PARTITION BY store_id ORDER BY revenue DESC, sale_date) AS INTEGER) AS rank
       FROM f WHERE revenue > mu + {CFG_A.anomaly_std_threshold} * sd QUALIFY rank <= {CFG_A.anomaly_top_k}),
lo AS (SELECT *, 'low' AS kind, CAST(row_number() OVER (PARTITION BY store_id ORDER BY revenue ASC, sale_date) AS INTEGER) AS rank
       FROM f WHERE revenue < mu - {CFG_A.anomaly_std_threshold} * sd QUALIFY rank <= {CFG_A.anomaly_top_k})
SELECT store_id, kind, rank, sale_date, strftime(sale_date, '%d %b') AS date_label, {T('revenue')} AS revenue, orders,
       {R('(revenue - mu) / sd', 1)} AS z_score, {T('mu')} AS avg_daily_revenue, {T('sd')} AS std_daily_revenue
FROM (SELECT * FROM hi UNION ALL SELECT * FROM lo)"""))
def q_anomaly_days(spark, d):
    return TR.anomaly_days(A(spark, d), CFG_A)


# ── ticket and opportunity (A48–A49) ────────────────────────────────────────

SLOTS = "slots AS (SELECT store_id, order_id, weekday_ix, sale_hour, sum(total) AS ticket FROM lines_b GROUP BY 1, 2, 3, 4)"


@register("day_ticket", with_ctes(LB, SLOTS, body=f"""
g AS (SELECT store_id, weekday_ix, count(DISTINCT order_id) AS orders, avg(ticket) AS av FROM slots GROUP BY 1, 2)
SELECT dom.store_id, dom.weekday_ix, dom.weekday AS day, COALESCE(g.orders, 0) AS orders, {R('g.av', 2)} AS avg_ticket
FROM {O.weekday_domain('SELECT DISTINCT store_id FROM slots')} dom LEFT JOIN g USING (store_id, weekday_ix)"""))
def q_day_ticket(spark, d):
    return TK.day_ticket(Bv(spark, d))


@register("hour_ticket", with_ctes(LB, SLOTS, body=f"""
SELECT store_id, sale_hour, count(DISTINCT order_id) AS orders, {R('avg(ticket)', 2)} AS avg_ticket
FROM slots GROUP BY 1, 2"""))
def q_hour_ticket(spark, d):
    return TK.hour_ticket(Bv(spark, d))


@register("opportunity_hours", with_ctes(LB, SLOTS, body=f"""
h AS (SELECT store_id, sale_hour, count(DISTINCT order_id) AS orders, avg(ticket) AS avg_raw FROM slots GROUP BY 1, 2),
b AS (SELECT store_id, avg(ticket) AS baseline FROM slots GROUP BY 1),
c AS (SELECT store_id, quantile_cont(CAST(orders AS DOUBLE), {CFG_A.opportunity_quantile}) AS cutoff FROM h GROUP BY 1),
o AS (SELECT h.*, baseline, CASE WHEN baseline > 0 THEN {R('(baseline - avg_raw) / baseline * 100.0', 1)} ELSE 0.0 END AS gap_pct
      FROM h JOIN b USING (store_id) JOIN c USING (store_id) WHERE orders >= cutoff AND avg_raw < baseline)
SELECT store_id, CAST(row_number() OVER (PARTITION BY store_id ORDER BY orders DESC, gap_pct DESC, sale_hour) AS INTEGER) AS rank,
       sale_hour, orders, {R('avg_raw', 2)} AS avg_ticket, gap_pct, {R('baseline', 2)} AS baseline_ticket
FROM o QUALIFY rank <= {CFG_A.opportunity_top_k}"""))
def q_opportunity_hours(spark, d):
    return TK.opportunity_hours(Bv(spark, d), CFG_A)


# ── profitability (A18–A26) ─────────────────────────────────────────────────

PROF_COLS = ("store_id, rank, product, category, units, revenue, orders, avg_margin, profit, cum_profit_pct, profit_share, "
             "in_profit_pareto, n_profit_pareto, class, orders_median, margin_median")


@register("profitability", with_ctes(LA, O.profitability("lines_a"), body=f"SELECT {PROF_COLS} FROM prof"))
def q_profitability(spark, d):
    return PF.profitability(A(spark, d), CFG_A)


@register("profit_classes", with_ctes(LA, O.profitability("lines_a"), body="""
SELECT store_id, product, class, orders, avg_margin, orders_median, margin_median FROM prof"""))
def q_profit_classes(spark, d):
    return PF.profitability(A(spark, d), CFG_A).select(
        "store_id", "product", "class", "orders", "avg_margin", "orders_median", "margin_median")


@register("class_counts", with_ctes(LA, O.profitability("lines_a"), body="""
SELECT store_id, class, count(*) AS products FROM prof GROUP BY 1, 2"""))
def q_class_counts(spark, d):
    return PF.class_counts(A(spark, d), CFG_A)


@register("margin_by_category", with_ctes(LA, body=f"""
g AS (SELECT store_id, category, avg(margin_pct) AS am, count(margin_pct) AS ml, count(*) AS n FROM lines_a GROUP BY 1, 2),
c AS (SELECT *, {R('sum(ml) OVER (PARTITION BY store_id) / sum(n) OVER (PARTITION BY store_id) * 100.0', 1)} AS coverage_pct FROM g)
SELECT store_id, CAST(row_number() OVER (PARTITION BY store_id ORDER BY am DESC, category) AS INTEGER) AS rank,
       category, {R('am', 4)} AS avg_margin, coverage_pct FROM c WHERE am IS NOT NULL"""))
def q_margin_by_category(spark, d):
    return PF.margin_by_category(A(spark, d), CFG_A)


@register("margin_weighted_pairs", with_ctes(LA, O.basket("lines_a"), O.product_pairs(KEEP),
                                             _high_lift_sql(CFG_RULES.high_lift_threshold, CFG_RULES.high_lift_top_k),
                                             O.margin_products("lines_a"), body=f"""
SELECT hl.store_id, hl.rank, hl.product_a AS antecedent, hl.product_b AS consequent, hl.lift AS original_lift,
       {R('hl.lift * mb.avg_margin / 100.0', 3)} AS margin_weighted_score
FROM hl JOIN mp mb ON mb.store_id = hl.store_id AND mb.product = hl.product_b
WHERE EXISTS (SELECT 1 FROM mp ma WHERE ma.store_id = hl.store_id AND ma.product = hl.product_a)"""))
def q_margin_weighted_pairs(spark, d):
    return PF.margin_weighted_pairs(A(spark, d), CFG_RULES)


@register("category_top5_profit", with_ctes(LA, O.profitability("lines_a"), body=f"""
p AS (SELECT *, sum(orders) OVER (PARTITION BY store_id, category) AS category_orders,
             CAST(row_number() OVER (PARTITION BY store_id, category ORDER BY profit DESC, product) AS INTEGER) AS rank_in_category FROM prof),
cats AS (SELECT store_id, category, CAST(row_number() OVER (PARTITION BY store_id ORDER BY category_orders DESC, category) AS INTEGER) AS category_rank
         FROM (SELECT DISTINCT store_id, category, category_orders FROM p))
SELECT p.store_id, category_rank, p.category, category_orders, rank_in_category, product, profit, orders, avg_margin, class
FROM p JOIN cats USING (store_id, category) WHERE rank_in_category <= {CFG_A.category_top_k_profit}"""))
def q_category_top5_profit(spark, d):
    return PF.category_top_profit(A(spark, d), CFG_A)
