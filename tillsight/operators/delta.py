"""Event impact (D1–D16, P23–P26, J17–J21): pre/post windows round an event date.

pre  = [event − W, event)      post = [event, event + W − 1]

Per store.  Line values are the report's line projection rounded to 2 dp; an order is
keyed by (date, order id) and carries its full revenue.  A selection (empty or the whole
catalog = whole portfolio) scopes lines by product and orders by "contains any selected
product" — an order-level ``max(is_selected)`` flag, so no array overlap is needed.

Shape: every measure is a conditional aggregation over one filtered scan (phase is a
column), the dense timeline is ``explode(sequence(pre_start, post_end))`` left-joined
to daily sums, and selection/group tables are tiny literal DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.config import DeltaConfig
from tillsight.functions.numbers import pct_change
from tillsight.operators._common import STORE, top_k

_SEL_SCHEMA = T.StructType([T.StructField("product", T.StringType())])
_GRP_SCHEMA = T.StructType([T.StructField("group_name", T.StringType()), T.StructField("group_ix", T.IntegerType()),
                            T.StructField("product", T.StringType()), T.StructField("n_products", T.IntegerType())])


def delta_lines(lines: DataFrame, cfg: DeltaConfig) -> DataFrame:
    """D-lines: validity (P8), category map (P9/X11), subcategory default (P10), 2-dp values."""
    prod = F.trim(F.col("product"))
    ok = (F.col("sale_date").isNotNull() & F.col("quantity").isNotNull() & F.col("total").isNotNull()
          & prod.isNotNull() & ~prod.isin("", "nan") & F.col("order_id").isNotNull() & ~F.trim("order_id").isin("", "nan"))
    cat = F.coalesce(F.col("category_raw"), F.col("category"), F.lit("Otros")) if "category_raw" in lines.columns else F.col("category")
    if cfg.category_map is not None:
        m = F.create_map(*[x for kv in cfg.category_map.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
        cat = F.coalesce(F.element_at(m, F.trim(cat)), F.lit("Otros"))
    sub = F.trim(F.coalesce(F.col("subcategory"), F.lit("")))
    return lines.filter(ok).select(
        STORE, F.col("sale_date").alias("date"), F.trim("order_id").alias("order_id"), prod.alias("product"),
        F.coalesce(cat, F.lit("Otros")).alias("category"),
        F.when(sub == "", F.lit("Sin subcategoria")).otherwise(sub).alias("subcategory"),
        F.round(F.col("quantity"), 2).cast("decimal(18,2)").alias("quantity"),
        F.round(F.col("total"), 2).cast("decimal(18,2)").alias("revenue"),
        F.col("total").alias("total_raw"),
        F.round(F.col("margin_pct"), 2).alias("margin_pct"),
    )


def catalog(dl: DataFrame) -> DataFrame:
    """(store, product) with its first and last date: one aggregate of the history serves catalog, counts and span."""
    return dl.groupBy(STORE, "product").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def event_dates(dl: DataFrame, cfg: DeltaConfig, products: DataFrame | None = None) -> DataFrame:
    """(store, event_date): the configured date, or the default rule (P25) per store:
    clamp(as_of − 30 d, min, max − 29 d), with max as the upper bound when max − 29 d < min."""
    products = catalog(dl) if products is None else products
    span = products.groupBy(STORE).agg(F.min("first_date").alias("date_min"), F.max("last_date").alias("date_max"))
    given, as_of = F.lit(cfg.event_date).cast("date"), F.lit(cfg.as_of).cast("date")
    if cfg.table is not None:
        span = span.join(cfg.table.select(STORE, F.col("event_date").alias("_event"), F.col("as_of").alias("_as_of")), STORE)
        given, as_of = F.coalesce(F.col("_event").cast("date"), given), F.coalesce(F.col("_as_of").cast("date"), as_of)
    elif not cfg.event_date and not cfg.as_of:
        raise ValueError("event_date or as_of is required (operators never read the clock)")
    hi = F.when(F.date_sub("date_max", 29) < F.col("date_min"), F.col("date_max")).otherwise(F.date_sub("date_max", 29))
    by_rule = F.when(as_of.isNotNull(), F.least(F.greatest(F.date_sub(as_of, 30), F.col("date_min")), hi))
    ev = F.coalesce(given, by_rule)
    return span.select(STORE, "date_min", "date_max", ev.alias("event_date"))


def _selection(spark: SparkSession, products: DataFrame, cfg: DeltaConfig, selection: DataFrame | None = None):
    """(store, product, is_sel) for selected products present in the store's catalog (P26),
    plus per-store ``whole`` flag (empty selection or the whole catalog).

    ``selection`` — an optional per-store (store_id, product) table (D16 helpers) — takes
    the place of the configured product list."""
    names = products.select(STORE, "product")
    selection = cfg.selection if selection is None else selection
    if selection is None:
        sel = spark.createDataFrame([(p,) for p in dict.fromkeys(cfg.selected_products)], _SEL_SCHEMA)
        chosen = names.join(sel, "product", "left_semi")
    else:
        chosen = names.join(selection.select(STORE, "product").distinct(), [STORE, "product"], "left_semi")
    n_cat = names.groupBy(STORE).agg(F.count(F.lit(1)).alias("n_catalog"))
    n_sel = chosen.groupBy(STORE).agg(F.count(F.lit(1)).alias("n_selected"))
    flags = n_cat.join(n_sel, STORE, "left").select(
        STORE, F.coalesce("n_selected", F.lit(0)).alias("n_selected"), "n_catalog",
        ((F.coalesce("n_selected", F.lit(0)) == 0) | (F.col("n_selected") == F.col("n_catalog"))).alias("whole"))
    return chosen.withColumn("is_sel", F.lit(True)), flags


def scoped(lines: DataFrame, cfg: DeltaConfig, selection: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Return (window lines with phase & in_scope, window orders with phase & in_scope, store frame).

    The store frame carries event date, window bounds, selection flags and span."""
    spark = lines.sparkSession
    dl = delta_lines(lines, cfg)
    products = catalog(dl)
    ev = event_dates(dl, cfg, products)
    chosen, flags = _selection(spark, products, cfg, selection)
    W = cfg.window_days
    st = ev.join(flags, STORE).select(
        "*", F.date_sub("event_date", W).alias("pre_start"), F.date_add("event_date", W - 1).alias("post_end"))
    x = dl.join(st.select(STORE, "event_date", "pre_start", "post_end", "whole"), STORE)
    x = x.filter((F.col("date") >= F.col("pre_start")) & (F.col("date") <= F.col("post_end")))
    x = x.join(chosen, [STORE, "product"], "left").withColumn(
        "phase", F.when(F.col("date") < F.col("event_date"), F.lit("pre")).otherwise(F.lit("post")))
    x = x.withColumn("in_scope", F.col("whole") | F.coalesce(F.col("is_sel"), F.lit(False)))
    orders = x.groupBy(STORE, "date", "order_id", "phase").agg(
        F.round(F.sum("total_raw"), 2).alias("revenue"), F.round(F.sum("quantity"), 2).alias("units"),
        F.max("in_scope").alias("in_scope"))
    return x, orders, st


def _pre(c: Column) -> Column:
    return F.when(F.col("phase") == "pre", c)


def _post(c: Column) -> Column:
    return F.when(F.col("phase") == "post", c)


def _line_metrics(x: DataFrame) -> DataFrame:
    rev, m = F.col("revenue"), F.col("margin_pct")
    # per day first: a day counts once, without a distinct count over the lines
    days = x.filter("in_scope").groupBy(STORE, "date", "phase").agg(
        F.sum(rev).alias("revenue"), F.sum("quantity").alias("quantity"),
        F.sum(F.when(m.isNotNull(), rev.cast("double") * m)).alias("msum"), F.sum(F.when(m.isNotNull(), rev)).alias("mrev"))
    aggs = []
    for ph, f in (("pre", _pre), ("post", _post)):
        aggs += [
            F.sum(f(F.col("revenue"))).cast("double").alias(f"{ph}_revenue"),
            F.sum(f(F.col("quantity"))).cast("double").alias(f"{ph}_units"),
            F.sum(f(F.col("msum"))).alias(f"{ph}_msum"),
            F.sum(f(F.col("mrev"))).cast("double").alias(f"{ph}_mrev"),
            F.count(f(F.col("date"))).alias(f"{ph}_active_days"),
        ]
    return days.groupBy(STORE).agg(*aggs)


def _order_metrics(orders: DataFrame) -> DataFrame:
    s = orders.filter("in_scope")
    aggs = []
    for ph, f in (("pre", _pre), ("post", _post)):
        aggs += [
            F.sum(f(F.col("revenue"))).cast("double").alias(f"{ph}_order_revenue"),
            F.sum(f(F.col("units"))).cast("double").alias(f"{ph}_order_units"),
            F.count(f(F.lit(1))).alias(f"{ph}_orders"),
        ]
    return s.groupBy(STORE).agg(*aggs)


def kpis(lines: DataFrame, cfg: DeltaConfig, scope=None) -> DataFrame:
    """Line and order metrics per phase and their percent changes."""
    x, orders, st = scope or scoped(lines, cfg)
    lm, om = _line_metrics(x), _order_metrics(orders)
    j = st.select(STORE, "event_date", "whole", "n_selected").join(lm, STORE, "left").join(om, STORE, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    zi = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    out = j.select(
        STORE, "event_date", F.lit(cfg.window_days).alias("window_days"), "whole", "n_selected",
        *[z(f"{p}_{m}").alias(f"{p}_{m}") for p in ("pre", "post") for m in ("revenue", "units", "order_revenue", "order_units")],
        *[zi(f"{p}_orders").alias(f"{p}_orders") for p in ("pre", "post")],
        *[F.when(z(f"{p}_mrev") > 0, F.col(f"{p}_msum") / F.col(f"{p}_mrev")).alias(f"{p}_margin") for p in ("pre", "post")],
        *[z(f"{p}_mrev").alias(f"{p}_margin_revenue") for p in ("pre", "post")],
    )
    for p in ("pre", "post"):
        n = F.col(f"{p}_orders")
        out = out.withColumn(f"{p}_avg_ticket", F.when(n > 0, F.col(f"{p}_order_revenue") / n).otherwise(0.0)).withColumn(
            f"{p}_items_per_order", F.when(n > 0, F.col(f"{p}_order_units") / n).otherwise(0.0))
    out = (out.withColumn("delta_revenue_pct", pct_change("pre_revenue", "post_revenue"))
           .withColumn("delta_units_pct", pct_change("pre_units", "post_units"))
           .withColumn("delta_orders_pct", pct_change("pre_orders", "post_orders"))
           .withColumn("delta_ticket_pct", pct_change("pre_avg_ticket", "post_avg_ticket")))
    return out


def rounded_kpis(lines: DataFrame, cfg: DeltaConfig) -> DataFrame:
    k = kpis(lines, cfg)
    return k.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in k.dtypes])


def timeline(lines: DataFrame, cfg: DeltaConfig) -> DataFrame:
    """Dense daily timeline of the selection (zero filled), post flag, trailing mean."""
    x, orders, st = scoped(lines, cfg)
    days = st.select(STORE, "event_date", F.explode(F.sequence("pre_start", "post_end")).alias("date"))
    d_lines = x.filter("in_scope").groupBy(STORE, "date").agg(
        F.sum("revenue").cast("double").alias("revenue"), F.sum("quantity").cast("double").alias("units"))
    d_orders = orders.filter("in_scope").groupBy(STORE, "date").agg(F.count(F.lit(1)).alias("orders"))
    t = days.join(d_lines, [STORE, "date"], "left").join(d_orders, [STORE, "date"], "left")
    w = Window.partitionBy(STORE).orderBy("date").rowsBetween(-(cfg.rolling_width - 1), 0)
    rev = F.coalesce("revenue", F.lit(0.0))
    return t.select(
        STORE, "date", rev.alias("revenue"), F.coalesce("units", F.lit(0.0)).alias("units"),
        F.coalesce("orders", F.lit(0)).cast("bigint").alias("orders"), (F.col("date") >= F.col("event_date")).alias("is_post"),
        F.avg(rev).over(w).alias("moving_avg"))


def momentum(lines: DataFrame, cfg: DeltaConfig) -> DataFrame:
    """Last vs first trailing mean of the timeline (first 0 → null if last > 0 else 0)."""
    t = timeline(lines, cfg)
    m = t.groupBy(STORE).agg(F.min_by("moving_avg", "date").alias("first_ma"), F.max_by("moving_avg", "date").alias("last_ma"),
                             F.count(F.lit(1)).alias("points"))
    mom = F.when(F.col("points") < 2, F.lit(0.0)).otherwise(pct_change("first_ma", "last_ma"))
    return m.select(STORE, F.lit(cfg.rolling_width).alias("trend_window_days"), F.round("first_ma", 4).alias("first_ma"),
                    F.round("last_ma", 4).alias("last_ma"), F.round(mom, 4).alias("momentum_pct"))


def product_impact(lines: DataFrame, cfg: DeltaConfig, k: int | None = None, scope=None) -> DataFrame:
    """Per product pre/post revenue, units, revenue-weighted margin, Δ, Δ%, status;
    ordered by |Δ revenue| (ties: product); first ``product_impact_k``."""
    x, _, _ = scope or scoped(lines, cfg)
    s = x.filter("in_scope")
    rev, m = F.col("revenue"), F.col("margin_pct")
    aggs = []
    for ph, f in (("pre", _pre), ("post", _post)):
        aggs += [F.sum(f(rev)).cast("double").alias(f"{ph}_revenue"), F.sum(f(F.col("quantity"))).cast("double").alias(f"{ph}_units"),
                 F.sum(f(F.when(m.isNotNull(), rev.cast("double") * m))).alias(f"{ph}_msum"),
                 F.sum(f(F.when(m.isNotNull(), rev))).cast("double").alias(f"{ph}_mrev")]
    g = s.groupBy(STORE, "product").agg(*aggs)
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    g = g.select(STORE, "product", *[z(f"{p}_{c}").alias(f"{p}_{c}") for p in ("pre", "post") for c in ("revenue", "units", "msum", "mrev")])
    g = g.filter((F.col("pre_revenue") > 0) | (F.col("post_revenue") > 0))
    pm = F.when(F.col("pre_mrev") > 0, F.col("pre_msum") / F.col("pre_mrev"))
    qm = F.when(F.col("post_mrev") > 0, F.col("post_msum") / F.col("post_mrev"))
    status = (F.when((F.col("pre_revenue") > 0) & (F.col("post_revenue") == 0), "dropped")
              .when((F.col("pre_revenue") == 0) & (F.col("post_revenue") > 0), "new").otherwise("stable"))
    g = g.select(STORE, "product", "pre_revenue", "post_revenue",
                 (F.col("post_revenue") - F.col("pre_revenue")).alias("delta_revenue"),
                 pct_change("pre_revenue", "post_revenue").alias("delta_pct"), "pre_units", "post_units",
                 pm.alias("pre_margin"), qm.alias("post_margin"), (qm - pm).alias("margin_delta"), status.alias("status"))
    g = g.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in g.dtypes])
    return top_k(g, k if k is not None else cfg.product_impact_k, [F.abs("delta_revenue").desc(), F.col("product")])


def category_mix(lines: DataFrame, cfg: DeltaConfig) -> DataFrame:
    """Category share of the selection's revenue pre and post, Δ in points; by post revenue."""
    x, _, _ = scoped(lines, cfg)
    s = x.filter("in_scope")
    g = s.groupBy(STORE, "category").agg(F.coalesce(F.sum(_pre(F.col("revenue"))), F.lit(0)).cast("double").alias("pre_revenue"),
                                         F.coalesce(F.sum(_post(F.col("revenue"))), F.lit(0)).cast("double").alias("post_revenue"))
    w = Window.partitionBy(STORE)
    tp = F.sum("pre_revenue").over(w)
    tq = F.sum("post_revenue").over(w)
    g = g.withColumn("mix_pre", F.col("pre_revenue") / F.when(tp != 0, tp).otherwise(1.0)).withColumn(
        "mix_post", F.col("post_revenue") / F.when(tq != 0, tq).otherwise(1.0))
    g = g.withColumn("delta_mix_pts", (F.col("mix_post") - F.col("mix_pre")) * 100.0).filter(
        (F.col("pre_revenue") > 0) | (F.col("post_revenue") > 0))
    g = g.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in g.dtypes])
    return top_k(g, None, [F.col("post_revenue").desc(), F.col("category")])


def group_impact(lines: DataFrame, cfg: DeltaConfig) -> DataFrame:
    """Per configured product group (whole portfolio, not the selection): pre/post
    revenue of member lines, post orders containing a member, post revenue per order, Δ%."""
    spark = lines.sparkSession
    rows = [(g.name, i, p, len(dict.fromkeys(g.products))) for i, g in enumerate(cfg.product_groups) for p in dict.fromkeys(g.products)]
    members = spark.createDataFrame(rows, _GRP_SCHEMA)
    x, _, st = scoped(lines, cfg)
    gl = x.join(members, "product")
    rev = gl.groupBy(STORE, "group_name", "group_ix", "n_products").agg(
        F.coalesce(F.sum(_pre(F.col("revenue"))), F.lit(0)).cast("double").alias("pre_revenue"),
        F.coalesce(F.sum(_post(F.col("revenue"))), F.lit(0)).cast("double").alias("post_revenue"))
    go = gl.filter(F.col("phase") == "post").select(STORE, "group_name", "date", "order_id").distinct().groupBy(
        STORE, "group_name").agg(F.count(F.lit(1)).alias("post_orders"))
    groups = F.array(*[F.struct(F.lit(g.name).alias("group_name"), F.lit(i).alias("group_ix"),
                                F.lit(len(dict.fromkeys(g.products))).alias("n_products"))
                       for i, g in enumerate(cfg.product_groups)])
    dom = st.select(STORE, F.inline(groups))
    out = dom.join(rev.drop("group_ix", "n_products"), [STORE, "group_name"], "left").join(go, [STORE, "group_name"], "left").select(
        STORE, "group_ix", "group_name", F.col("n_products").cast("int").alias("n_products"),
        F.coalesce("pre_revenue", F.lit(0.0)).alias("pre_revenue"), F.coalesce("post_revenue", F.lit(0.0)).alias("post_revenue"),
        F.coalesce("post_orders", F.lit(0)).cast("bigint").alias("post_orders"))
    out = out.withColumn("post_avg_ticket", F.when(F.col("post_orders") > 0, F.col("post_revenue") / F.col("post_orders")).otherwise(0.0))
    out = out.withColumn("delta_revenue_pct", pct_change("pre_revenue", "post_revenue"))
    return out.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def coverage_and_warnings(lines: DataFrame, cfg: DeltaConfig) -> DataFrame:
    """Missing days per window over the *whole* dataset, active days of the
    selection, the four warnings, revenue driver, churn counts and direction."""
    scope = scoped(lines, cfg)
    x, _, st = scope
    W = cfg.window_days
    obs = x.select(STORE, "date", "phase").distinct().groupBy(STORE).agg(
        F.count(_pre(F.col("date"))).alias("pre_obs"), F.count(_post(F.col("date"))).alias("post_obs"))
    k = kpis(lines, cfg, scope)
    lm = _line_metrics(x).select(STORE, "pre_active_days", "post_active_days")
    pr = product_impact(lines, cfg, k=None, scope=scope).groupBy(STORE).agg(
        F.count_if(F.col("status") == "new").alias("new_products"), F.count_if(F.col("status") == "dropped").alias("dropped_products"))
    j = st.select(STORE).join(obs, STORE, "left").join(k, STORE, "left").join(lm, STORE, "left").join(pr, STORE, "left")
    miss_pre = (F.lit(W) - F.coalesce("pre_obs", F.lit(0))).cast("bigint")
    miss_post = (F.lit(W) - F.coalesce("post_obs", F.lit(0))).cast("bigint")
    a_pre, a_post = F.coalesce("pre_active_days", F.lit(0)).cast("bigint"), F.coalesce("post_active_days", F.lit(0)).cast("bigint")
    pre_r, post_r = F.col("pre_revenue"), F.col("post_revenue")
    cov_pre = F.when(pre_r > 0, F.col("pre_margin_revenue") / pre_r).otherwise(0.0)
    cov_post = F.when(post_r > 0, F.col("post_margin_revenue") / post_r).otherwise(0.0)
    lim = cfg.margin_coverage_min_pct / 100.0
    any_rev = (pre_r > 0) | (post_r > 0)
    warnings = F.array_compact(F.array(
        F.when((miss_pre > 0) | (miss_post > 0), F.format_string(
            "Hay huecos de cobertura en la ventana: pre %d dia(s), pos %d dia(s).", miss_pre, miss_post)),
        F.when(any_rev & ((cov_pre < lim) | (cov_post < lim)), F.lit("El analisis de margen es parcial o inexistente para la seleccion actual.")),
        F.when((pre_r == 0) & (post_r > 0), F.lit("No hay base de revenue en la ventana pre para esta seleccion; el crecimiento porcentual no es comparable."))
        .when((post_r == 0) & (pre_r > 0), F.lit("La seleccion no tuvo revenue en la ventana pos; revisa si hubo descontinuacion, quiebre o falta de adopcion.")),
        F.when((a_pre <= cfg.min_active_days) & (a_post <= cfg.min_active_days) & any_rev,
               F.lit("La seleccion opera con actividad muy intermitente; prioriza lectura cualitativa sobre porcentajes exactos.")),
    ))
    du, dt = F.col("delta_units_pct"), F.col("delta_ticket_pct")
    driver = F.when(F.abs(F.coalesce(du, F.lit(0.0))) >= F.abs(F.coalesce(dt, F.lit(0.0))), "volumen").otherwise("ticket y mix de orden")
    card = F.when(du.isNotNull() & dt.isNotNull() & (F.abs(du) > F.abs(dt)), "volume").otherwise("ticket")
    dr = F.col("delta_revenue_pct")
    direction = F.when(dr.isNull(), "sin base comparable").when(dr >= 0, "positivo").otherwise("negativo")
    return j.select(
        STORE, miss_pre.alias("missing_pre_days"), miss_post.alias("missing_post_days"),
        a_pre.alias("active_pre_days"), a_post.alias("active_post_days"),
        F.round(cov_pre, 4).alias("margin_coverage_pre"), F.round(cov_post, 4).alias("margin_coverage_post"),
        warnings.alias("warnings"), F.size(warnings).alias("n_warnings"),
        driver.alias("driver"), card.alias("driver_card"), direction.alias("direction"),
        F.coalesce("new_products", F.lit(0)).cast("bigint").alias("new_products"),
        F.coalesce("dropped_products", F.lit(0)).cast("bigint").alias("dropped_products"),
    )


def meta(lines: DataFrame, cfg: DeltaConfig) -> DataFrame:
    """line/order/product counts, totals, date span (orderCount = distinct order id)."""
    dl = delta_lines(lines, cfg)
    orders = dl.groupBy(STORE, "date", "order_id").agg(F.count(F.lit(1)).alias("n"), F.sum("total_raw").alias("total"),
                                                       F.sum("quantity").alias("units"))
    n = catalog(dl).groupBy(STORE).agg(F.count(F.lit(1)).alias("product_count"))
    return orders.groupBy(STORE).agg(
        F.sum("n").alias("line_count"), F.count_distinct("order_id").alias("order_count"),
        F.count(F.lit(1)).alias("order_keys"), F.round(F.sum("total").cast("double"), 2).alias("total_revenue"),
        F.round(F.sum("units").cast("double"), 2).alias("total_units"),
        F.min("date").alias("date_min"), F.max("date").alias("date_max")).join(n, STORE).select(
        STORE, "line_count", "order_count", "order_keys", "product_count", "total_revenue", "total_units", "date_min", "date_max")


def order_frame(lines: DataFrame, cfg: DeltaConfig) -> DataFrame:
    """Every order (date and id) with revenue, units and its sorted distinct products and categories.

    An order's arrays hold each product of the catalog once at most, however many lines it has.
    """
    dl = delta_lines(lines, cfg)
    return dl.groupBy(STORE, "date", "order_id").agg(
        F.round(F.sum("total_raw").cast("double"), 2).alias("revenue"), F.round(F.sum("quantity").cast("double"), 2).alias("units"),
        F.sort_array(F.collect_set("product")).alias("products"), F.sort_array(F.collect_set("category")).alias("categories"))


def top_products(lines: DataFrame, cfg: DeltaConfig) -> DataFrame:
    """D3: top products by revenue over the whole data set."""
    dl = delta_lines(lines, cfg)
    g = dl.groupBy(STORE, "product").agg(F.round(F.sum("total_raw").cast("double"), 2).alias("revenue"))
    return top_k(g, cfg.top_products_k, [F.col("revenue").desc(), F.col("product")])


def catalog_search(lines: DataFrame, cfg: DeltaConfig, query: str) -> DataFrame:
    """Catalog products whose name contains ``query`` (case-insensitive)."""
    dl = delta_lines(lines, cfg)
    return dl.select(STORE, "product").distinct().filter(F.lower("product").contains(query.strip().lower()))


def top_selection(lines: DataFrame, cfg: DeltaConfig, k: int = 5) -> DataFrame:
    """D16 "top 5": each store's k best-selling products by revenue, as a selection."""
    return top_products(lines, cfg.with_(top_products_k=k)).select(STORE, "product")


def group_selection(lines: DataFrame, cfg: DeltaConfig, group: str) -> DataFrame:
    """D16 "group": the members of a configured product group, for every store."""
    members = [p for g in cfg.product_groups if g.name == group for p in g.products]
    stores = lines.select(STORE).distinct()
    return stores.select(STORE, F.explode(F.array(*[F.lit(p) for p in dict.fromkeys(members)])).alias("product"))
