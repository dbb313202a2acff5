"""Insight rules (I1–I13) and recommendations.

A rule is a function ``(ReportInputs) -> DataFrame`` returning at most one row per store
with ``title, body, category, severity, priority[, action, owner, horizon]``; a store
for which the rule does not fire has no row.  The engine unions the rules, fills the
default action/owner/horizon by category and orders by (priority, rule order), which
is the stable sort of the source.  Body HTML tags are kept as data.

Every input is a small per-store aggregate computed once (``ReportInputs``); rules are
selects, windows and ``format_string`` over those, never driver-side loops.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.config import DEFAULT_REPORT, ReportConfig
from tillsight.operators import basket, bundles, cart, products, profitability, summary, ticket, timeline, trends
from tillsight.operators._common import STORE, top_k

# Default (action, owner, horizon) per insight category — fixed values.
INSIGHT_DEFAULTS: dict[str, tuple[str, str, str]] = {
    "revenue": ("Optimizar portafolio y pricing de top SKUs", "Comercial", "1-2 semanas"),
    "basket": ("Lanzar test A/B de bundles en menú", "Growth", "2 semanas"),
    "time": ("Ajustar staffing y slots promocionales", "Operaciones", "1 semana"),
    "trend": ("Reubicar productos en catálogo según tendencia", "Catálogo", "1-2 semanas"),
    "anomaly": ("Auditar campañas/eventos y operación del día", "BI + Operaciones", "72 horas"),
}
FALLBACK_DEFAULT = ("Revisar hallazgo y priorizar experimento", "Equipo BI", "1 semana")


@dataclass
class ReportInputs:
    """Module outputs the rules read, each computed once per report run.

    With a ``run_key`` every module output (a small per-store aggregate) is written once
    to the shared checkpoint folder and read back, so the rules, entitlements and
    summary row plan against tiny scans instead of re-deriving every module; without
    one, modules stay lazy sub-plans.
    """

    lines: DataFrame
    cfg: ReportConfig = DEFAULT_REPORT
    quality: DataFrame | Callable[[], DataFrame] | None = None  # a function is called by the first who reads it
    run_key: str | None = None
    _cache: dict = field(default_factory=dict)

    @property
    def quality_table(self) -> DataFrame | None:
        return self.get("quality", self.quality) if callable(self.quality) else self.quality

    def get(self, name: str, fn: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._cache:
            if self.run_key is None:
                self._cache[name] = fn()
            else:
                from tillsight.sources.bindings import materialized

                self._cache[name] = materialized(self.lines.sparkSession, f"{self.run_key}|{name}", fn)
        return self._cache[name]

    @property
    def summary(self):
        return self.get("summary", lambda: summary.summary(self.lines, self.cfg))

    @property
    def products(self):
        return self.get("products", lambda: products.products_pareto(self.lines, self.cfg))

    @property
    def pairs(self):
        return self.get("pairs", lambda: basket.product_pairs(self.lines, self.cfg))

    @property
    def high_lift(self):
        return self.get("high_lift", lambda: self.pairs.filter(F.col("lift") >= self.cfg.high_lift_threshold).transform(
            lambda d: top_k(d.drop("rank"), self.cfg.high_lift_top_k, [F.col("count").desc(), F.col("product_a"), F.col("product_b")])))

    @property
    def ticket_stats(self):
        return self.get("ticket_stats", lambda: cart.ticket_stats(self.lines, self.cfg))

    @property
    def profit(self):
        return self.get("profit", lambda: profitability.profitability(self.lines, self.cfg))

    @property
    def margin_cat(self):
        return self.get("margin_cat", lambda: profitability.margin_by_category(self.lines, self.cfg))

    @property
    def peaks(self):
        return self.get("peaks", lambda: timeline.peak_moments(self.lines, self.cfg))

    @property
    def trends(self):
        return self.get("trends", lambda: trends.product_trends(self.lines, self.cfg))

    @property
    def trend_months(self):
        return self.get("trend_months", lambda: trends.trend_months(self.lines, self.cfg))

    @property
    def anomalies(self):
        return self.get("anomalies", lambda: trends.anomaly_days(self.lines, self.cfg))

    @property
    def cat_totals(self):
        return self.get("cat_totals", lambda: products.category_totals(self.lines, self.cfg))

    @property
    def opportunity(self):
        return self.get("opportunity", lambda: ticket.opportunity_hours(self.lines, self.cfg))

    @property
    def launch_ready(self):
        return self.get("launch_ready", lambda: bundles.launch_ready(self.lines, self.cfg))


def _num(c) -> Column:
    """Python ``f"{x:,}"`` for an integer."""
    return F.format_number(F.col(c) if isinstance(c, str) else c, 0)


def _pyround0(c: Column) -> Column:
    """Python ``round(x)``: half to even."""
    return F.bround(c, 0).cast("bigint")


def _ins(df: DataFrame, title: Column, body: Column, category: str, severity: Column | str, priority: int,
         action: str = "", owner: str = "", horizon: str = "") -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(STORE, title.alias("title"), body.alias("body"), F.lit(category).alias("category"), sev.alias("severity"),
                     F.lit(priority).alias("priority"), F.lit(action).alias("action"), F.lit(owner).alias("owner"),
                     F.lit(horizon).alias("horizon"))


# ── rules ───────────────────────────────────────────────────────────────────

def r_pareto(x: ReportInputs) -> DataFrame:
    p = x.products.filter(F.col("rank") == 1).select(STORE, "n_pareto", "total_products")
    pct = _pyround0(F.col("n_pareto") / F.col("total_products") * 100.0)
    body = F.format_string(
        "Solo <strong>%d productos</strong> de %d (%d%%) generan el %s%% del revenue. Un problema de disponibilidad "
        "en cualquiera de los top 5 tiene impacto directo en GMV. Estos items deben estar siempre visibles y bien "
        "nombrados en el catálogo.", "n_pareto", "total_products", pct, F.lit(f"{x.cfg.pareto_threshold:.0f}"))
    return _ins(p, F.lit("Concentración de revenue"), body, "revenue", "warning", 1)


def r_anchor_category(x: ReportInputs) -> DataFrame:
    shown = x.pairs.filter(F.col("rank") <= x.cfg.top_n_pairs)
    sides = shown.select(STORE, F.inline(F.array(
        F.struct(F.col("product_a").alias("product"), (F.col("rank") * 2).alias("pos")),
        F.struct(F.col("product_b").alias("product"), (F.col("rank") * 2 + 1).alias("pos")))))
    cats = sides.join(x.products.select(STORE, "product", "category"), [STORE, "product"])
    c = cats.groupBy(STORE, "category").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    tot = c.groupBy(STORE).agg(F.sum("n").alias("total"), F.min_by(F.struct("category", "n"), F.struct(-F.col("n"), F.col("first_pos"))).alias("top"))
    t = tot.select(STORE, F.col("top.category").alias("cat"), _pyround0(F.col("top.n") / F.col("total") * 100.0).alias("pct")).filter(F.col("pct") >= 40)
    title = F.format_string("%s como ancla del carrito", "cat")
    body = F.format_string(
        "La categoría <strong>%s</strong> aparece en el %d%% de los pares más frecuentes del market basket. Actúa "
        "como ancla que acompaña productos de mayor ticket. <em>Oportunidad:</em> optimizar combos con esta "
        "categoría como base.", "cat", "pct")
    return _ins(t, title, body, "basket", "opportunity", 2)


def r_multi_item(x: ReportInputs) -> DataFrame:
    s = x.summary
    low = F.col("multi_item_pct") < 50
    body = F.format_string("El promedio es %s items por orden. %s ", F.col("avg_items_per_order").cast("string"), F.when(
        low, F.lit("Hay espacio significativo para incrementar cross-sell, especialmente en carritos de 1 item.")).otherwise(
        F.lit("Base sólida para cross-sell — enfocarse en incrementar de 2 a 3 items.")))
    title = F.format_string("%s%% de órdenes son multi-item", F.col("multi_item_pct").cast("string"))
    return _ins(s, title, body, "basket", F.when(low, "opportunity").otherwise("info"), 3)


def r_ticket(x: ReportInputs) -> DataFrame:
    t = x.ticket_stats.filter(F.col("mean") != 0)
    gap = _pyround0(F.abs(F.col("mean") - F.col("median")) / F.col("mean") * 100.0)
    title = F.format_string("Ticket promedio $%s %s", _num("mean"), F.lit(x.cfg.currency))
    body = F.format_string(
        "El ticket mediano ($%s) está %s del promedio (%d%% de diferencia), indicando una distribución con cola a "
        "la %s. El 50%% de los pedidos cae entre $%s y $%s.", _num("median"),
        F.when(F.col("median") < F.col("mean"), "por debajo").otherwise("por encima"), gap,
        F.when(F.col("mean") > F.col("median"), "derecha").otherwise("izquierda"), _num("p25"), _num("p75"))
    return _ins(t, title, body, "revenue", "info", 4)


def _class_top3(x: ReportInputs, cls: str) -> DataFrame:
    p = x.profit.filter(F.col("class") == cls)
    w = Window.partitionBy(STORE).orderBy("rank")
    p = p.withColumn("k", F.row_number().over(w)).withColumn("n_class", F.count(F.lit(1)).over(Window.partitionBy(STORE)))
    return p.filter(F.col("k") <= 3)


def r_tractors(x: ReportInputs) -> DataFrame:
    t = _class_top3(x, "Tractor").groupBy(STORE).agg(F.first("n_class").alias("n"), F.avg("avg_margin").alias("m"),
                                                      F.avg("orders").cast("bigint").alias("o")).filter(F.col("n") >= 2)
    m = F.format_string("%.1f", "m")
    title = F.format_string("Productos 'Tractor': alto volumen, margen %s%%", m)
    body = F.format_string(
        "Encontrados %d productos con alto volumen pero bajo margen (Tractores). Estos conducen tráfico pero generan "
        "poco profit. Considera: (1) aumentar precio en 5-10%%, (2) vender como bundle con items de alto margen, (3) "
        "usar como lead magnet pero promover cross-sell agresivamente. Promedio: %d órdenes/período, %s%% margen.", "n", "o", m)
    return _ins(t, title, body, "profitability", "warning", 2, "Revisar precios y estrategia de empaquetamiento",
                "Pricing & Marketing", "Corto plazo (1-2 semanas)")


def r_champions(x: ReportInputs) -> DataFrame:
    c = _class_top3(x, "Champion").groupBy(STORE).agg(F.first("n_class").alias("n"), F.avg("avg_margin").alias("m"),
                                                       F.sum("profit_share").alias("ps"), F.sum("revenue").alias("rev"))
    c = c.join(x.summary.select(STORE, "total_revenue"), STORE)
    rs = F.when(F.col("total_revenue") != 0, F.col("rev") / F.col("total_revenue") * 100.0).otherwise(0.0)
    title = F.format_string("Productos 'Champion': %d ítems high-margin high-volume", "n")
    body = F.format_string(
        "Estos %d productos son los generadores de profit principales (margen promedio %s%%). Representan %s%% del "
        "profit total pero solo %s%% del revenue. Estrategia: maximizar visibilidad, stock seguro, promoción selectiva "
        "(ej: en bundles de bajo margen).", "n", F.format_string("%.1f", "m"), F.format_string("%.1f", "ps"), F.format_string("%.1f", rs))
    return _ins(c, title, body, "profitability", "info", 1, "Garantizar stock y visibilidad máxima", "Catalog & Inventory", "Continuo")


def r_margin_dispersion(x: ReportInputs) -> DataFrame:
    mc = x.margin_cat
    w = Window.partitionBy(STORE)
    mc = mc.withColumn("mean_m", F.avg("avg_margin").over(w))
    hi = mc.filter(F.col("avg_margin") >= F.col("mean_m"))
    hi2 = hi.withColumn("k", F.row_number().over(Window.partitionBy(STORE).orderBy("rank"))).filter("k <= 2").groupBy(STORE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "category"))), lambda s: s["category"]), ", ").alias("hi"))
    g = mc.groupBy(STORE).agg(F.count(F.lit(1)).alias("n"), F.max_by("avg_margin", "rank").alias("min_m"),
                              F.min_by("avg_margin", "rank").alias("max_m"), F.min_by("category", "rank").alias("max_c"),
                              F.max_by("category", "rank").alias("min_c"))
    g = g.withColumn("gap", F.col("max_m") - F.col("min_m")).filter((F.col("n") >= 2) & (F.col("gap") >= 5)).join(hi2, STORE)
    f1 = lambda c: F.format_string("%.1f", c)
    title = F.format_string("Dispersión de margen: %s%% - %s%% entre categorías", f1("max_m"), f1("min_m"))
    body = F.format_string(
        "Hay una brecha de %s%% entre la categoría de mayor margen (%s) y menor (%s). Las categorías de alto margen "
        "(%s) deberían recibir prioridad en promoción y merchandising. Considere: (1) revisar precios de bajo margen, "
        "(2) empaquetar bajo margen con alto margen, (3) probar descuentos en bajo margen solo para incentivar "
        "cross-sell.", f1("gap"), "max_c", "min_c", "hi")
    return _ins(g, title, body, "profitability", "warning", 3, "Optimizar mix de precios por categoría",
                "Pricing & Category Management", "Medio plazo (2-4 semanas)")


def r_peaks(x: ReportInputs) -> DataFrame:
    body = F.format_string(
        "La hora pico es las <strong>%d:00</strong> y el día con más órdenes es <strong>%s</strong>. La combinación "
        "más fuerte es <strong>%s</strong>. Estos picos informan decisiones de staffing y timing de promociones.",
        "best_hour", "best_day", "best_combo")
    return _ins(x.peaks, F.lit("Picos de demanda"), body, "time", "info", 3)


def _list3(df: DataFrame, item: Column) -> DataFrame:
    top = df.filter(F.col("rank") <= 3).select(STORE, "rank", item.alias("s"))
    return top.groupBy(STORE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "s"))), lambda t: t["s"]), ", ").alias("items"))


def r_high_lift(x: ReportInputs) -> DataFrame:
    items = _list3(x.high_lift, F.format_string("<strong>%s</strong> + <strong>%s</strong> (lift %s)", "product_a", "product_b",
                                                F.col("lift").cast("string")))
    body = F.format_string(
        "Los pares con lift alto representan combinaciones que ocurren más de lo esperado por azar — candidatos "
        "naturales para combos en el menú: %s. Los pares de alta frecuencia pero lift bajo ya son habituales; el upside "
        "está en promover los de alto lift.", "items")
    return _ins(items, F.lit("Oportunidad de combos (Market Basket)"), body, "basket", "opportunity", 2)


def _trend_rule(x: ReportInputs, direction: str) -> DataFrame:
    t = x.trends.filter(F.col("direction") == direction)
    fmt = "<strong>%s</strong> (+%s%%)" if direction == "up" else "<strong>%s</strong> (%s%%)"
    items = _list3(t, F.format_string(fmt, "product", F.col("growth_pct").cast("string")))
    meta = t.groupBy(STORE).agg(F.first("base_month").alias("b"), F.first("compare_month").alias("c"), F.first("eligible_count").alias("e"))
    return items.join(meta, STORE)


def r_growing(x: ReportInputs) -> DataFrame:
    t = _trend_rule(x, "up")
    body = F.format_string(
        "Comparando %s vs %s, los productos con mayor crecimiento en revenue son: %s. Estos representan demanda "
        "emergente que podría amplificarse con mejor posicionamiento en el catálogo. El ranking filtra productos con "
        "base suficiente (%d elegibles) para evitar porcentajes engañosos.", "b", "c", "items", "e")
    return _ins(t, F.lit("Productos en crecimiento"), body, "trend", "opportunity", 3)


def r_declining(x: ReportInputs) -> DataFrame:
    t = _trend_rule(x, "down")
    body = F.format_string(
        "Comparando %s vs %s, los productos con mayor caída: %s. Investigar si se debe a disponibilidad, "
        "estacionalidad, o pérdida de demanda genuina. El análisis usa solo productos con base suficiente (%d "
        "elegibles).", "b", "c", "items", "e")
    return _ins(t, F.lit("Productos en declive"), body, "trend", "risk", 3)


def r_anomalies(x: ReportInputs) -> DataFrame:
    a = x.anomalies.filter(F.col("rank") == 1)
    hi = a.filter(F.col("kind") == "high").select(STORE, F.format_string(
        "Día de mayor pico: <strong>%s</strong> ($%s, %sσ sobre la media)", "date_label", _num("revenue"),
        F.col("z_score").cast("string")).alias("hi"), "avg_daily_revenue", "std_daily_revenue")
    lo = a.filter(F.col("kind") == "low").select(STORE, F.format_string(
        "Día más bajo: <strong>%s</strong> ($%s, %sσ bajo la media)", "date_label", _num("revenue"),
        F.abs("z_score").cast("string")).alias("lo"), F.col("avg_daily_revenue").alias("a2"), F.col("std_daily_revenue").alias("s2"))
    j = hi.join(lo, STORE, "full")
    parts = F.concat_ws(". ", "hi", "lo")
    body = F.format_string(
        "El revenue diario promedio es $%s ± $%s. %s. Los picos pueden indicar eventos especiales o campañas "
        "efectivas; los valles pueden indicar problemas operativos o fechas festivas.",
        _num(F.coalesce("avg_daily_revenue", "a2")), _num(F.coalesce("std_daily_revenue", "s2")), parts)
    return _ins(j, F.lit("Días atípicos"), body, "anomaly", "info", 5)


def r_category_balance(x: ReportInputs) -> DataFrame:
    c = x.cat_totals
    w = Window.partitionBy(STORE)
    c = c.withColumn("pct", F.bround(F.col("revenue") / F.sum("revenue").over(w) * 100.0, 1))
    top3 = c.filter(F.col("rank") <= 3)
    g = top3.groupBy(STORE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.format_string("<strong>%s</strong> (%s%%)", "category", F.col("pct").cast("string")).alias("s")))), lambda t: t["s"]), ", ").alias("items"),
        F.sum("pct").alias("sum3"), F.min_by("category", "rank").alias("top_cat"), F.min_by("pct", "rank").alias("top_pct"))
    bal = F.col("top_pct") < 40
    body = F.format_string("Las 3 categorías principales concentran el %s%% del revenue: %s. %s",
                           F.format_string("%.0f", "sum3"), "items",
                           F.when(bal, F.lit("La distribución está relativamente balanceada.")).otherwise(
                               F.format_string("%s domina con %s%% — alta dependencia de una categoría.", "top_cat", F.col("top_pct").cast("string"))))
    return _ins(g, F.lit("Balance de categorías"), body, "revenue", F.when(bal, "info").otherwise("warning"), 4)


RULES: list[Callable[[ReportInputs], DataFrame]] = [
    r_pareto, r_anchor_category, r_multi_item, r_ticket, r_tractors, r_champions, r_margin_dispersion,
    r_peaks, r_high_lift, r_growing, r_declining, r_anomalies, r_category_balance,
]


def insights(x: ReportInputs) -> DataFrame:
    """All fired rules, defaults filled, ranked by (priority, rule order) per store."""
    parts = [rule(x).withColumn("rule_ix", F.lit(i)) for i, rule in enumerate(RULES)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    da = F.create_map(*[v for k, (a, _, _) in INSIGHT_DEFAULTS.items() for v in (F.lit(k), F.lit(a))])
    do = F.create_map(*[v for k, (_, o, _) in INSIGHT_DEFAULTS.items() for v in (F.lit(k), F.lit(o))])
    dh = F.create_map(*[v for k, (_, _, h) in INSIGHT_DEFAULTS.items() for v in (F.lit(k), F.lit(h))])
    incomplete = (F.col("action") == "") | (F.col("owner") == "") | (F.col("horizon") == "")

    def fill(c: str, m: Column, fb: str) -> Column:
        d = F.coalesce(F.element_at(m, F.col("category")), F.lit(fb))
        return F.when(incomplete & (F.col(c) == ""), d).otherwise(F.col(c))

    u = u.select(STORE, "rule_ix", "title", "body", "category", "severity", "priority",
                 fill("action", da, FALLBACK_DEFAULT[0]).alias("action"), fill("owner", do, FALLBACK_DEFAULT[1]).alias("owner"),
                 fill("horizon", dh, FALLBACK_DEFAULT[2]).alias("horizon"))
    w = Window.partitionBy(STORE).orderBy("priority", "rule_ix")
    return u.withColumn("rank", F.row_number().over(w))


def recommendations(x: ReportInputs, k: int = 3) -> DataFrame:
    """Five candidates in fixed order; the first ``k`` per store."""
    p = x.products.filter(F.col("rank") == 1).select(STORE, F.lit(0).alias("ix"), F.lit("ALTO").alias("impact"),
                                                     F.lit("Catálogo").alias("owner"), F.lit("1 semana").alias("horizon"),
                                                     F.format_string("Blindar disponibilidad y visibilidad de los %d SKUs que concentran el 80%% del revenue.", "n_pareto").alias("action"))
    o = x.opportunity.filter(F.col("rank") == 1).select(STORE, F.lit(1).alias("ix"), F.lit("MEDIO").alias("impact"), F.lit("Growth").alias("owner"),
                                                       F.lit("2 semanas").alias("horizon"),
                                                       F.format_string("Ejecutar test de upsell en la franja %d:00 (alto tráfico con ticket por debajo de la media).", "sale_hour").alias("action"))
    h = x.high_lift.filter(F.col("rank") == 1).select(STORE, F.lit(2).alias("ix"), F.lit("ALTO").alias("impact"), F.lit("Growth + Comercial").alias("owner"),
                                                     F.lit("2 semanas").alias("horizon"),
                                                     F.format_string("Probar bundle guiado para %s + %s (lift %s).", "product_a", "product_b", F.col("lift").cast("string")).alias("action"))
    b = x.launch_ready.filter(F.col("rank") == 1).select(STORE, F.lit(3).alias("ix"), F.lit("ALTO").alias("impact"), F.lit("Growth + Pricing").alias("owner"),
                                                        F.lit("1-2 semanas").alias("horizon"),
                                                        F.format_string("Activar bundle %s + %s (confidence %s%%, lift %s).", "anchor", "target",
                                                                        F.format_string("%.1f", F.col("confidence") * 100), F.format_string("%.2f", "lift")).alias("action"))
    parts = [p, o, h, b]
    if x.quality is not None:
        parts.append(x.quality_table.filter(F.col("risk_level") == "high").select(
            STORE, F.lit(4).alias("ix"), F.lit("ALTO").alias("impact"), F.lit("BI").alias("owner"), F.lit("72 horas").alias("horizon"),
            F.lit("Corregir cobertura temporal y calidad de datos antes de tomar decisiones de mediano plazo.").alias("action")))
    u = parts[0]
    for q in parts[1:]:
        u = u.unionByName(q)
    w = Window.partitionBy(STORE).orderBy("ix")
    return u.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
