"""Registered queries of the event-impact report (D1–D16) over binding A.

Event 1998-03-01, 30-day windows, a five-name selection (one name absent from the
catalog) and two product groups (one member absent).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.config import DeltaConfig, ProductGroup
from tillsight.operators import delta as D
from tillsight.operators import order_index as OI
from tillsight.plans import oracle_sql as O
from tillsight.plans.oracle_sql import R
from tillsight.plans.registry import register, with_ctes
from tillsight.sources import bindings as B

CFG_DELTA = DeltaConfig(
    event_date="1998-03-01", window_days=30,
    selected_products=("small ring", "red widget", "blue bolt", "old rod", "no such product"),
    product_groups=(
        ProductGroup("rods", ("old rod", "red rod", "new rod", "hot rod")),
        ProductGroup("widgets", ("red widget", "small widget", "large widget", "blue widget", "old widget", "ghost widget")),
    ),
)
CFG_DEFAULT_EVENT = DeltaConfig(as_of="2001-07-15", window_days=30)


def _lines(spark, d):
    return B.tpch_lines(spark, d)


def _pct(prev: str, cur: str) -> str:
    return (f"CASE WHEN ({prev}) = 0 THEN CASE WHEN ({cur}) > 0 THEN NULL ELSE 0.0 END "
            f"ELSE (CAST(({cur}) AS DOUBLE) - ({prev})) / ({prev}) * 100.0 END")


def _head(cfg: DeltaConfig = CFG_DELTA, chosen_sql: str | None = None) -> str:
    sel = ", ".join(f"('{p}')" for p in dict.fromkeys(cfg.selected_products)) or "(NULL)"
    W = cfg.window_days
    ev = f"DATE '{cfg.event_date}'"
    return f"""{O.lines_a()},
dl AS (SELECT store_id, sale_date AS date, order_id, product, category, CAST(round(quantity, 2) AS DECIMAL(18,2)) AS quantity,
              CAST(round(total, 2) AS DECIMAL(18,2)) AS revenue, total AS total_raw, round(margin_pct, 2) AS margin_pct FROM lines_a),
sel AS (SELECT * FROM (VALUES {sel}) t(product)),
catalog AS (SELECT DISTINCT store_id, product FROM dl),
chosen AS ({chosen_sql or "SELECT c.* FROM catalog c SEMI JOIN sel USING (product)"}),
flags AS (SELECT c.store_id, COALESCE(s.n_sel, 0) AS n_selected, c.n_cat AS n_catalog,
                 (COALESCE(s.n_sel, 0) = 0 OR s.n_sel = c.n_cat) AS whole
          FROM (SELECT store_id, count(*) AS n_cat FROM catalog GROUP BY 1) c
          LEFT JOIN (SELECT store_id, count(*) AS n_sel FROM chosen GROUP BY 1) s USING (store_id)),
st AS (SELECT *, {ev} AS event_date, CAST({ev} - INTERVAL {W} DAY AS DATE) AS pre_start,
              CAST({ev} + INTERVAL {W - 1} DAY AS DATE) AS post_end FROM flags),
x AS (SELECT dl.*, st.event_date, st.whole, CASE WHEN dl.date < st.event_date THEN 'pre' ELSE 'post' END AS phase,
             (st.whole OR ch.product IS NOT NULL) AS in_scope
      FROM dl JOIN st USING (store_id) LEFT JOIN chosen ch ON ch.store_id = dl.store_id AND ch.product = dl.product
      WHERE dl.date >= st.pre_start AND dl.date <= st.post_end),
ord AS (SELECT store_id, date, order_id, phase, round(sum(total_raw), 2) AS revenue, round(sum(quantity), 2) AS units,
               bool_or(in_scope) AS in_scope FROM x GROUP BY 1, 2, 3, 4),
lm AS (SELECT store_id,
              CAST(sum(revenue) FILTER (WHERE phase = 'pre') AS DOUBLE) AS pre_revenue,
              CAST(sum(quantity) FILTER (WHERE phase = 'pre') AS DOUBLE) AS pre_units,
              sum(CAST(revenue AS DOUBLE) * margin_pct) FILTER (WHERE phase = 'pre' AND margin_pct IS NOT NULL) AS pre_msum,
              CAST(sum(revenue) FILTER (WHERE phase = 'pre' AND margin_pct IS NOT NULL) AS DOUBLE) AS pre_mrev,
              count(DISTINCT date) FILTER (WHERE phase = 'pre') AS pre_active_days,
              CAST(sum(revenue) FILTER (WHERE phase = 'post') AS DOUBLE) AS post_revenue,
              CAST(sum(quantity) FILTER (WHERE phase = 'post') AS DOUBLE) AS post_units,
              sum(CAST(revenue AS DOUBLE) * margin_pct) FILTER (WHERE phase = 'post' AND margin_pct IS NOT NULL) AS post_msum,
              CAST(sum(revenue) FILTER (WHERE phase = 'post' AND margin_pct IS NOT NULL) AS DOUBLE) AS post_mrev,
              count(DISTINCT date) FILTER (WHERE phase = 'post') AS post_active_days
       FROM x WHERE in_scope GROUP BY 1),
om AS (SELECT store_id,
              CAST(sum(revenue) FILTER (WHERE phase = 'pre') AS DOUBLE) AS pre_order_revenue,
              CAST(sum(units) FILTER (WHERE phase = 'pre') AS DOUBLE) AS pre_order_units,
              count(*) FILTER (WHERE phase = 'pre') AS pre_orders,
              CAST(sum(revenue) FILTER (WHERE phase = 'post') AS DOUBLE) AS post_order_revenue,
              CAST(sum(units) FILTER (WHERE phase = 'post') AS DOUBLE) AS post_order_units,
              count(*) FILTER (WHERE phase = 'post') AS post_orders
       FROM ord WHERE in_scope GROUP BY 1),
k0 AS (SELECT st.store_id, st.event_date, {W} AS window_days, st.whole, st.n_selected,
              COALESCE(pre_revenue, 0.0) AS pre_revenue, COALESCE(pre_units, 0.0) AS pre_units,
              COALESCE(pre_order_revenue, 0.0) AS pre_order_revenue, COALESCE(pre_order_units, 0.0) AS pre_order_units,
              COALESCE(post_revenue, 0.0) AS post_revenue, COALESCE(post_units, 0.0) AS post_units,
              COALESCE(post_order_revenue, 0.0) AS post_order_revenue, COALESCE(post_order_units, 0.0) AS post_order_units,
              COALESCE(pre_orders, 0) AS pre_orders, COALESCE(post_orders, 0) AS post_orders,
              CASE WHEN COALESCE(pre_mrev, 0.0) > 0 THEN pre_msum / pre_mrev END AS pre_margin,
              CASE WHEN COALESCE(post_mrev, 0.0) > 0 THEN post_msum / post_mrev END AS post_margin,
              COALESCE(pre_mrev, 0.0) AS pre_margin_revenue, COALESCE(post_mrev, 0.0) AS post_margin_revenue
       FROM st LEFT JOIN lm USING (store_id) LEFT JOIN om USING (store_id)),
k1 AS (SELECT *, CASE WHEN pre_orders > 0 THEN pre_order_revenue / pre_orders ELSE 0.0 END AS pre_avg_ticket,
              CASE WHEN pre_orders > 0 THEN pre_order_units / pre_orders ELSE 0.0 END AS pre_items_per_order,
              CASE WHEN post_orders > 0 THEN post_order_revenue / post_orders ELSE 0.0 END AS post_avg_ticket,
              CASE WHEN post_orders > 0 THEN post_order_units / post_orders ELSE 0.0 END AS post_items_per_order FROM k0),
k AS (SELECT *, {_pct('pre_revenue', 'post_revenue')} AS delta_revenue_pct, {_pct('pre_units', 'post_units')} AS delta_units_pct,
             {_pct('CAST(pre_orders AS DOUBLE)', 'CAST(post_orders AS DOUBLE)')} AS delta_orders_pct,
             {_pct('pre_avg_ticket', 'post_avg_ticket')} AS delta_ticket_pct FROM k1),
prod AS (SELECT store_id, product,
                COALESCE(CAST(sum(revenue) FILTER (WHERE phase = 'pre') AS DOUBLE), 0.0) AS pre_revenue,
                COALESCE(CAST(sum(quantity) FILTER (WHERE phase = 'pre') AS DOUBLE), 0.0) AS pre_units,
                COALESCE(sum(CAST(revenue AS DOUBLE) * margin_pct) FILTER (WHERE phase = 'pre' AND margin_pct IS NOT NULL), 0.0) AS pre_msum,
                COALESCE(CAST(sum(revenue) FILTER (WHERE phase = 'pre' AND margin_pct IS NOT NULL) AS DOUBLE), 0.0) AS pre_mrev,
                COALESCE(CAST(sum(revenue) FILTER (WHERE phase = 'post') AS DOUBLE), 0.0) AS post_revenue,
                COALESCE(CAST(sum(quantity) FILTER (WHERE phase = 'post') AS DOUBLE), 0.0) AS post_units,
                COALESCE(sum(CAST(revenue AS DOUBLE) * margin_pct) FILTER (WHERE phase = 'post' AND margin_pct IS NOT NULL), 0.0) AS post_msum,
                COALESCE(CAST(sum(revenue) FILTER (WHERE phase = 'post' AND margin_pct IS NOT NULL) AS DOUBLE), 0.0) AS post_mrev
         FROM x WHERE in_scope GROUP BY 1, 2),
pi AS (SELECT store_id, product, pre_revenue, post_revenue, post_revenue - pre_revenue AS delta_revenue,
              {_pct('pre_revenue', 'post_revenue')} AS delta_pct, pre_units, post_units,
              CASE WHEN pre_mrev > 0 THEN pre_msum / pre_mrev END AS pre_margin,
              CASE WHEN post_mrev > 0 THEN post_msum / post_mrev END AS post_margin,
              CASE WHEN post_mrev > 0 THEN post_msum / post_mrev END - CASE WHEN pre_mrev > 0 THEN pre_msum / pre_mrev END AS margin_delta,
              CASE WHEN pre_revenue > 0 AND post_revenue = 0 THEN 'dropped' WHEN pre_revenue = 0 AND post_revenue > 0 THEN 'new' ELSE 'stable' END AS status
       FROM prod WHERE pre_revenue > 0 OR post_revenue > 0)"""


def _r4(cols: str) -> str:
    return ", ".join(f"{R(c.strip(), 4)} AS {c.strip()}" for c in cols.split(","))


KPI_DBL = ("pre_revenue, pre_units, pre_order_revenue, pre_order_units, post_revenue, post_units, post_order_revenue, "
           "post_order_units, pre_margin, post_margin, pre_margin_revenue, post_margin_revenue, pre_avg_ticket, "
           "pre_items_per_order, post_avg_ticket, post_items_per_order, delta_revenue_pct, delta_units_pct, "
           "delta_orders_pct, delta_ticket_pct")


@register("delta_kpis", f"""WITH {_head()}
SELECT store_id, event_date, window_days, whole, n_selected, pre_orders, post_orders, {_r4(KPI_DBL)} FROM k""")
def q_delta_kpis(spark, d):
    return D.rounded_kpis(_lines(spark, d), CFG_DELTA)


def _timeline_sql() -> str:
    w = CFG_DELTA.rolling_width
    return f"""days AS (SELECT store_id, event_date, CAST(unnest(generate_series(pre_start, post_end, INTERVAL 1 DAY)) AS DATE) AS date FROM st),
dlx AS (SELECT store_id, date, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(quantity) AS DOUBLE) AS units FROM x WHERE in_scope GROUP BY 1, 2),
dox AS (SELECT store_id, date, count(*) AS orders FROM ord WHERE in_scope GROUP BY 1, 2),
tl AS (SELECT days.store_id, days.date, COALESCE(dlx.revenue, 0.0) AS revenue, COALESCE(dlx.units, 0.0) AS units,
              COALESCE(dox.orders, 0) AS orders, days.date >= days.event_date AS is_post,
              avg(COALESCE(dlx.revenue, 0.0)) OVER (PARTITION BY days.store_id ORDER BY days.date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS moving_avg
       FROM days LEFT JOIN dlx USING (store_id, date) LEFT JOIN dox USING (store_id, date))"""


@register("delta_timeline", f"""WITH {_head()}, {_timeline_sql()}
SELECT store_id, date, revenue, units, orders, is_post, {R('moving_avg', 4)} AS moving_avg FROM tl""")
def q_delta_timeline(spark, d):
    t = D.timeline(_lines(spark, d), CFG_DELTA)
    return t.withColumn("moving_avg", F.round("moving_avg", 4))


@register("delta_momentum", f"""WITH {_head()}, {_timeline_sql()},
m AS (SELECT store_id, arg_min(moving_avg, date) AS first_ma, arg_max(moving_avg, date) AS last_ma, count(*) AS points FROM tl GROUP BY 1)
SELECT store_id, {CFG_DELTA.rolling_width} AS trend_window_days, {R('first_ma', 4)} AS first_ma, {R('last_ma', 4)} AS last_ma,
       {R(f"CASE WHEN points < 2 THEN 0.0 ELSE {_pct('first_ma', 'last_ma')} END", 4)} AS momentum_pct FROM m""")
def q_delta_momentum(spark, d):
    return D.momentum(_lines(spark, d), CFG_DELTA)


PI_DBL = "pre_revenue, post_revenue, delta_revenue, delta_pct, pre_units, post_units, pre_margin, post_margin, margin_delta"


@register("delta_products", f"""WITH {_head()},
pr AS (SELECT store_id, product, status, {_r4(PI_DBL)} FROM pi)
SELECT *, CAST(row_number() OVER (PARTITION BY store_id ORDER BY abs(delta_revenue) DESC, product) AS INTEGER) AS rank
FROM pr QUALIFY rank <= {CFG_DELTA.product_impact_k}""")
def q_delta_products(spark, d):
    return D.product_impact(_lines(spark, d), CFG_DELTA)


@register("delta_categories", f"""WITH {_head()},
c AS (SELECT store_id, category, COALESCE(CAST(sum(revenue) FILTER (WHERE phase = 'pre') AS DOUBLE), 0.0) AS pre_revenue,
             COALESCE(CAST(sum(revenue) FILTER (WHERE phase = 'post') AS DOUBLE), 0.0) AS post_revenue FROM x WHERE in_scope GROUP BY 1, 2),
m AS (SELECT *, pre_revenue / CASE WHEN sum(pre_revenue) OVER w <> 0 THEN sum(pre_revenue) OVER w ELSE 1.0 END AS mix_pre,
             post_revenue / CASE WHEN sum(post_revenue) OVER w <> 0 THEN sum(post_revenue) OVER w ELSE 1.0 END AS mix_post
      FROM c WINDOW w AS (PARTITION BY store_id)),
r AS (SELECT store_id, category, {_r4('pre_revenue, post_revenue, mix_pre, mix_post')},
             {R('(mix_post - mix_pre) * 100.0', 4)} AS delta_mix_pts FROM m WHERE pre_revenue > 0 OR post_revenue > 0)
SELECT *, CAST(row_number() OVER (PARTITION BY store_id ORDER BY post_revenue DESC, category) AS INTEGER) AS rank FROM r""")
def q_delta_categories(spark, d):
    return D.category_mix(_lines(spark, d), CFG_DELTA)


def _groups_sql() -> str:
    rows = ", ".join(f"('{g.name}', {i}, '{p}', {len(dict.fromkeys(g.products))})"
                     for i, g in enumerate(CFG_DELTA.product_groups) for p in dict.fromkeys(g.products))
    return f"mem AS (SELECT * FROM (VALUES {rows}) t(group_name, group_ix, product, n_products))"


@register("delta_groups", f"""WITH {_head()}, {_groups_sql()},
dom AS (SELECT DISTINCT st.store_id, m.group_name, m.group_ix, m.n_products FROM st CROSS JOIN mem m),
gl AS (SELECT x.*, m.group_name FROM x JOIN mem m USING (product)),
rv AS (SELECT store_id, group_name, COALESCE(CAST(sum(revenue) FILTER (WHERE phase = 'pre') AS DOUBLE), 0.0) AS pre_revenue,
              COALESCE(CAST(sum(revenue) FILTER (WHERE phase = 'post') AS DOUBLE), 0.0) AS post_revenue FROM gl GROUP BY 1, 2),
go AS (SELECT store_id, group_name, count(*) AS post_orders FROM (SELECT DISTINCT store_id, group_name, date, order_id FROM gl WHERE phase = 'post') GROUP BY 1, 2),
g AS (SELECT dom.store_id, dom.group_ix, dom.group_name, CAST(dom.n_products AS INTEGER) AS n_products,
             COALESCE(rv.pre_revenue, 0.0) AS pre_revenue, COALESCE(rv.post_revenue, 0.0) AS post_revenue, COALESCE(go.post_orders, 0) AS post_orders
      FROM dom LEFT JOIN rv USING (store_id, group_name) LEFT JOIN go USING (store_id, group_name))
SELECT store_id, CAST(group_ix AS INTEGER) AS group_ix, group_name, n_products, {_r4('pre_revenue, post_revenue')}, post_orders,
       {R('CASE WHEN post_orders > 0 THEN post_revenue / post_orders ELSE 0.0 END', 4)} AS post_avg_ticket,
       {R(_pct('pre_revenue', 'post_revenue'), 4)} AS delta_revenue_pct FROM g""")
def q_delta_groups(spark, d):
    return D.group_impact(_lines(spark, d), CFG_DELTA)


@register("delta_warnings", f"""WITH {_head()},
obs AS (SELECT store_id, count(DISTINCT date) FILTER (WHERE phase = 'pre') AS pre_obs, count(DISTINCT date) FILTER (WHERE phase = 'post') AS post_obs FROM x GROUP BY 1),
ch AS (SELECT store_id, count(*) FILTER (WHERE status = 'new') AS new_products, count(*) FILTER (WHERE status = 'dropped') AS dropped_products FROM pi GROUP BY 1),
j AS (SELECT st.store_id, {CFG_DELTA.window_days} - COALESCE(pre_obs, 0) AS mp, {CFG_DELTA.window_days} - COALESCE(post_obs, 0) AS mq,
             COALESCE(lm.pre_active_days, 0) AS ap, COALESCE(lm.post_active_days, 0) AS aq, k.*,
             CASE WHEN k.pre_revenue > 0 THEN k.pre_margin_revenue / k.pre_revenue ELSE 0.0 END AS cp,
             CASE WHEN k.post_revenue > 0 THEN k.post_margin_revenue / k.post_revenue ELSE 0.0 END AS cq,
             COALESCE(ch.new_products, 0) AS new_products, COALESCE(ch.dropped_products, 0) AS dropped_products
      FROM st LEFT JOIN obs USING (store_id) LEFT JOIN k USING (store_id) LEFT JOIN lm USING (store_id) LEFT JOIN ch USING (store_id)),
w AS (SELECT *, list_filter([
        CASE WHEN mp > 0 OR mq > 0 THEN printf('Hay huecos de cobertura en la ventana: pre %d dia(s), pos %d dia(s).', mp, mq) END,
        CASE WHEN (pre_revenue > 0 OR post_revenue > 0) AND (cp < {CFG_DELTA.margin_coverage_min_pct / 100.0} OR cq < {CFG_DELTA.margin_coverage_min_pct / 100.0})
             THEN 'El analisis de margen es parcial o inexistente para la seleccion actual.' END,
        CASE WHEN pre_revenue = 0 AND post_revenue > 0 THEN 'No hay base de revenue en la ventana pre para esta seleccion; el crecimiento porcentual no es comparable.'
             WHEN post_revenue = 0 AND pre_revenue > 0 THEN 'La seleccion no tuvo revenue en la ventana pos; revisa si hubo descontinuacion, quiebre o falta de adopcion.' END,
        CASE WHEN ap <= {CFG_DELTA.min_active_days} AND aq <= {CFG_DELTA.min_active_days} AND (pre_revenue > 0 OR post_revenue > 0)
             THEN 'La seleccion opera con actividad muy intermitente; prioriza lectura cualitativa sobre porcentajes exactos.' END
      ], lambda s: s IS NOT NULL) AS warnings FROM j)
SELECT store_id, CAST(mp AS BIGINT) AS missing_pre_days, CAST(mq AS BIGINT) AS missing_post_days, CAST(ap AS BIGINT) AS active_pre_days,
       CAST(aq AS BIGINT) AS active_post_days, {R('cp', 4)} AS margin_coverage_pre, {R('cq', 4)} AS margin_coverage_post,
       array_to_string(warnings, ' | ') AS warnings, CAST(len(warnings) AS INTEGER) AS n_warnings,
       CASE WHEN abs(COALESCE(delta_units_pct, 0.0)) >= abs(COALESCE(delta_ticket_pct, 0.0)) THEN 'volumen' ELSE 'ticket y mix de orden' END AS driver,
       CASE WHEN delta_units_pct IS NOT NULL AND delta_ticket_pct IS NOT NULL AND abs(delta_units_pct) > abs(delta_ticket_pct) THEN 'volume' ELSE 'ticket' END AS driver_card,
       CASE WHEN delta_revenue_pct IS NULL THEN 'sin base comparable' WHEN delta_revenue_pct >= 0 THEN 'positivo' ELSE 'negativo' END AS direction,
       CAST(new_products AS BIGINT) AS new_products, CAST(dropped_products AS BIGINT) AS dropped_products FROM w""")
def q_delta_warnings(spark, d):
    w = D.coverage_and_warnings(_lines(spark, d), CFG_DELTA)
    return w.withColumn("warnings", F.array_join("warnings", " | "))


@register("delta_top_products", with_ctes(O.lines_a(), body=f"""
g AS (SELECT store_id, product, {R('CAST(sum(total) AS DOUBLE)', 2)} AS revenue FROM lines_a GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY store_id ORDER BY revenue DESC, product) AS INTEGER) AS rank FROM g
QUALIFY rank <= {CFG_DELTA.top_products_k}"""))
def q_delta_top_products(spark, d):
    return D.top_products(_lines(spark, d), CFG_DELTA)


@register("delta_meta", with_ctes(O.lines_a(), body=f"""
SELECT store_id, count(*) AS line_count, count(DISTINCT order_id) AS order_count, count(DISTINCT (sale_date, order_id)) AS order_keys,
       count(DISTINCT product) AS product_count, {R('CAST(sum(total) AS DOUBLE)', 2)} AS total_revenue,
       {R('CAST(sum(round(quantity, 2)) AS DOUBLE)', 2)} AS total_units, min(sale_date) AS date_min, max(sale_date) AS date_max
FROM lines_a GROUP BY 1"""))
def q_delta_meta(spark, d):
    return D.meta(_lines(spark, d), CFG_DELTA)


@register("delta_default_event", with_ctes(O.lines_a(), body=f"""
s AS (SELECT store_id, min(sale_date) AS date_min, max(sale_date) AS date_max FROM lines_a GROUP BY 1)
SELECT store_id, date_min, date_max,
       least(greatest(CAST(DATE '{CFG_DEFAULT_EVENT.as_of}' - INTERVAL 30 DAY AS DATE), date_min),
             CASE WHEN CAST(date_max - INTERVAL 29 DAY AS DATE) < date_min THEN date_max ELSE CAST(date_max - INTERVAL 29 DAY AS DATE) END) AS event_date
FROM s"""))
def q_delta_default_event(spark, d):
    dl = D.delta_lines(_lines(spark, d), CFG_DEFAULT_EVENT)
    return D.event_dates(dl, CFG_DEFAULT_EVENT)


@register("delta_catalog_search", with_ctes(O.lines_a(), body="""
SELECT DISTINCT store_id, product FROM lines_a WHERE contains(lower(product), 'widget')"""))
def q_delta_catalog_search(spark, d):
    return D.catalog_search(_lines(spark, d), CFG_DELTA, "Widget")


TOP5_SQL = f"""SELECT c.* FROM catalog c SEMI JOIN (
  SELECT store_id, product FROM (SELECT store_id, product, {R('CAST(sum(total_raw) AS DOUBLE)', 2)} AS revenue FROM dl GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY revenue DESC, product) <= 5) t USING (store_id, product)"""


@register("delta_kpis_top5", f"""WITH {_head(chosen_sql=TOP5_SQL)}
SELECT store_id, event_date, window_days, whole, n_selected, pre_orders, post_orders, {_r4(KPI_DBL)} FROM k""")
def q_delta_kpis_top5(spark, d):
    lines = _lines(spark, d)
    scope = D.scoped(lines, CFG_DELTA, selection=D.top_selection(lines, CFG_DELTA, 5))
    k = D.kpis(lines, CFG_DELTA, scope)
    return k.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in k.dtypes])


_SELECTIONS = {"chosen": CFG_DELTA.selected_products} | {g.name: g.products for g in CFG_DELTA.product_groups}


@register("delta_selection_index", f"""
WITH {O.lines_a()},
sel AS (SELECT * FROM (VALUES {", ".join(f"('{n}', '{p}')" for n, ps in _SELECTIONS.items() for p in ps)}) t(name, product)),
o AS (SELECT store_id, sale_date AS date, order_id, round(sum(total), 2) AS revenue, round(CAST(sum(quantity) AS DOUBLE), 2) AS units
      FROM lines_a GROUP BY 1, 2, 3),
h AS (SELECT DISTINCT l.store_id, s.name, l.sale_date AS date, l.order_id FROM lines_a l JOIN sel s USING (product)),
j AS (SELECT h.name, o.*, CASE WHEN date >= DATE '1998-03-01' THEN 'post' ELSE 'pre' END AS phase FROM h JOIN o USING (store_id, date, order_id))
SELECT store_id, name, (SELECT count(*) FROM h WHERE h.store_id = j.store_id AND h.name = j.name) AS all_orders, phase,
       count(*) AS orders, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(units) AS DOUBLE) AS units
FROM j WHERE date >= DATE '1998-03-01' - INTERVAL 30 DAY AND date < DATE '1998-03-01' + INTERVAL 30 DAY GROUP BY 1, 2, 4""")
def q_delta_selection_index(spark, d):
    """The chosen products' and each group's orders from product bitmaps, all and before and after the event."""
    orders, index = OI.build(_lines(spark, d), CFG_DELTA)
    names = spark.createDataFrame([(n, p) for n, ps in _SELECTIONS.items() for p in ps], "name string, product string")
    picked = OI.select(index, names)
    event = F.lit(CFG_DELTA.event_date).cast("date")
    inside = (F.col("date") >= F.date_sub(event, 30)) & (F.col("date") < F.date_add(event, 30))
    phases = OI.orders_of(orders.where(inside), picked).groupBy(
        "store_id", "name", F.when(F.col("date") >= event, "post").otherwise("pre").alias("phase")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("revenue").cast("double").alias("revenue"),
        F.sum("units").cast("double").alias("units"))
    return phases.join(OI.counts(picked).withColumnRenamed("orders", "all_orders"), ["store_id", "name"])
