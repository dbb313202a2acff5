"""Registered queries of insights, recommendations, entitlements and report rows (I1–I14,
P27, A50, S15), each with its SQL: texts and the numbers in them."""

from __future__ import annotations

from tillsight.operators import clean as CL
from tillsight.operators import gating as G
from tillsight.operators import insights as I
from tillsight.operators import summary as S
from tillsight.operators._common import enable_sharing
from tillsight.operators.contract import CONTRACT
from tillsight.plans import oracle_sql as O
from tillsight.plans import queries_report as QR
from tillsight.plans.registry import CFG_RULES, REGISTRY, register, with_ctes
from tillsight.sources import bindings as B

CFG_INSIGHTS = CFG_RULES.with_(trend_min_base_revenue=100000.0, trend_min_base_orders=2)


def _inputs(spark, d) -> I.ReportInputs:
    key = f"{d}|report|{CFG_INSIGHTS!r}"
    lines = B.tpch_lines(spark, d).select("*")  # a table of this run: its modules share what they derive from it
    enable_sharing(lines, key)

    def quality():
        return S.quality_coverage(lines, CL.sanitize(B.raw_pos_lines_plan(spark, d, numbered=False))[2])

    return I.ReportInputs(lines, CFG_INSIGHTS, quality, run_key=key)


def build_modules(spark, d) -> None:
    """Write the modules that the queries below read, once per session."""
    x = _inputs(spark, d)
    for name in ("quality_table", "summary", "products", "pairs", "high_lift", "ticket_stats", "profit", "margin_cat", "peaks", "trends", "anomalies",
                 "cat_totals", "opportunity", "launch_ready"):
        getattr(x, name)


# ── the rules in SQL, each from its own module's SQL ───────────────────────

def _module(name: str, cte: str) -> str:
    return f"{cte} AS ({REGISTRY[name][1]})"


def _on_lines_a(name: str, cte: str) -> str:
    """A module whose own query reads binding B, over binding A."""
    return f"{cte} AS ({REGISTRY[name][1].replace(O.lines_b(), O.lines_a()).replace('lines_b', 'lines_a')})"


def _trends_cte() -> str:
    sql = REGISTRY["product_trends"][1].replace(QR.LA_BRAND, QR.LA)
    return f"tr AS ({sql.replace(f'base_orders >= {QR.CFG_TRENDS.trend_min_base_orders}', f'base_orders >= {CFG_INSIGHTS.trend_min_base_orders}')})"


def _pct0(x: str) -> str:
    return f"CAST(round_even({x}, 0) AS BIGINT)"


def _f1(x: str) -> str:
    return f"printf('%.1f', {O.R(x, 1)})"


def _n(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


def _first3(source: str, item: str) -> str:
    return f"SELECT store_id, string_agg({item}, ', ' ORDER BY rank) AS items FROM {source} WHERE rank <= 3 GROUP BY 1"


def _rule(ix: int, title: str, body: str, category: str, severity: str, priority: int, source: str, own: tuple = ("", "", "")) -> str:
    severity = severity if severity.startswith("CASE") else f"'{severity}'"
    texts = ", ".join(f"'{t}' AS {n}" for t, n in zip(own, ("action", "owner", "horizon")))
    return f"SELECT store_id, {ix} AS rule_ix, {title} AS title, {body} AS body, '{category}' AS category, " \
           f"{severity} AS severity, {priority} AS priority, {texts} FROM {source}"


def _insights_sql() -> str:
    rules = [
        _rule(0, "'Concentración de revenue'", f"""'Solo <strong>' || n_pareto || ' productos</strong> de ' || total_products || ' (' ||
  {_pct0('n_pareto / total_products * 100.0')} || '%) generan el 80% del revenue. Un problema de disponibilidad en cualquiera de los top 5 tiene impacto directo en GMV. Estos items deben estar siempre visibles y bien nombrados en el catálogo.'""",
              "revenue", "warning", 1, "pp WHERE rank = 1"),
        _rule(1, "cat || ' como ancla del carrito'", """'La categoría <strong>' || cat || '</strong> aparece en el ' || pct || '% de los pares más frecuentes del market basket. Actúa como ancla que acompaña productos de mayor ticket. <em>Oportunidad:</em> optimizar combos con esta categoría como base.'""",
              "basket", "opportunity", 2, "anchor WHERE pct >= 40"),
        _rule(2, "CAST(multi_item_pct AS VARCHAR) || '% de órdenes son multi-item'", """'El promedio es ' || CAST(avg_items_per_order AS VARCHAR) || ' items por orden. ' ||
  CASE WHEN multi_item_pct < 50 THEN 'Hay espacio significativo para incrementar cross-sell, especialmente en carritos de 1 item.' ELSE 'Base sólida para cross-sell — enfocarse en incrementar de 2 a 3 items.' END || ' '""",
              "basket", "CASE WHEN multi_item_pct < 50 THEN 'opportunity' ELSE 'info' END", 3, "su"),
        _rule(3, f"'Ticket promedio $' || {_n('mean')} || ' COP'", f"""'El ticket mediano ($' || {_n('median')} || ') está ' || CASE WHEN median < mean THEN 'por debajo' ELSE 'por encima' END ||
  ' del promedio (' || {_pct0('abs(mean - median) / mean * 100.0')} || '% de diferencia), indicando una distribución con cola a la ' || CASE WHEN mean > median THEN 'derecha' ELSE 'izquierda' END ||
  '. El 50% de los pedidos cae entre $' || {_n('p25')} || ' y $' || {_n('p75')} || '.'""", "revenue", "info", 4, "ts WHERE mean <> 0"),
        _rule(4, f"'Productos ''Tractor'': alto volumen, margen ' || {_f1('m')} || '%'", f"""'Encontrados ' || n || ' productos con alto volumen pero bajo margen (Tractores). Estos conducen tráfico pero generan poco profit. Considera: (1) aumentar precio en 5-10%, (2) vender como bundle con items de alto margen, (3) usar como lead magnet pero promover cross-sell agresivamente. Promedio: ' || CAST(trunc(o) AS BIGINT) || ' órdenes/período, ' || {_f1('m')} || '% margen.'""",
              "profitability", "warning", 2, "cls WHERE class = 'Tractor' AND n >= 2",
              ("Revisar precios y estrategia de empaquetamiento", "Pricing & Marketing", "Corto plazo (1-2 semanas)")),
        _rule(5, "'Productos ''Champion'': ' || n || ' ítems high-margin high-volume'", f"""'Estos ' || n || ' productos son los generadores de profit principales (margen promedio ' || {_f1('m')} || '%). Representan ' || {_f1('ps')} || '% del profit total pero solo ' ||
  {_f1('CASE WHEN total_revenue <> 0 THEN rev / total_revenue * 100.0 ELSE 0.0 END')} || '% del revenue. Estrategia: maximizar visibilidad, stock seguro, promoción selectiva (ej: en bundles de bajo margen).'""",
              "profitability", "info", 1, "cls JOIN (SELECT store_id, total_revenue FROM su) USING (store_id) WHERE class = 'Champion'",
              ("Garantizar stock y visibilidad máxima", "Catalog & Inventory", "Continuo")),
        _rule(6, f"'Dispersión de margen: ' || {_f1('max_m')} || '% - ' || {_f1('min_m')} || '% entre categorías'", f"""'Hay una brecha de ' || {_f1('max_m - min_m')} || '% entre la categoría de mayor margen (' || max_c || ') y menor (' || min_c || '). Las categorías de alto margen (' || hi || ') deberían recibir prioridad en promoción y merchandising. Considere: (1) revisar precios de bajo margen, (2) empaquetar bajo margen con alto margen, (3) probar descuentos en bajo margen solo para incentivar cross-sell.'""",
              "profitability", "warning", 3, "disp WHERE n >= 2 AND max_m - min_m >= 5",
              ("Optimizar mix de precios por categoría", "Pricing & Category Management", "Medio plazo (2-4 semanas)")),
        _rule(7, "'Picos de demanda'", """'La hora pico es las <strong>' || best_hour || ':00</strong> y el día con más órdenes es <strong>' || best_day || '</strong>. La combinación más fuerte es <strong>' || best_combo || '</strong>. Estos picos informan decisiones de staffing y timing de promociones.'""",
              "time", "info", 3, "pk"),
        _rule(8, "'Oportunidad de combos (Market Basket)'", """'Los pares con lift alto representan combinaciones que ocurren más de lo esperado por azar — candidatos naturales para combos en el menú: ' || items || '. Los pares de alta frecuencia pero lift bajo ya son habituales; el upside está en promover los de alto lift.'""",
              "basket", "opportunity", 2, "(" + _first3("hl", "'<strong>' || product_a || '</strong> + <strong>' || product_b || '</strong> (lift ' || CAST(lift AS VARCHAR) || ')'") + ")"),
        _rule(9, "'Productos en crecimiento'", """'Comparando ' || b || ' vs ' || c || ', los productos con mayor crecimiento en revenue son: ' || items || '. Estos representan demanda emergente que podría amplificarse con mejor posicionamiento en el catálogo. El ranking filtra productos con base suficiente (' || e || ' elegibles) para evitar porcentajes engañosos.'""",
              "trend", "opportunity", 3, "moves WHERE direction = 'up'"),
        _rule(10, "'Productos en declive'", """'Comparando ' || b || ' vs ' || c || ', los productos con mayor caída: ' || items || '. Investigar si se debe a disponibilidad, estacionalidad, o pérdida de demanda genuina. El análisis usa solo productos con base suficiente (' || e || ' elegibles).'""",
              "trend", "risk", 3, "moves WHERE direction = 'down'"),
        _rule(11, "'Días atípicos'", f"""'El revenue diario promedio es $' || {_n('avg_r')} || ' ± $' || {_n('std_r')} || '. ' || concat_ws('. ', hi, lo) || '. Los picos pueden indicar eventos especiales o campañas efectivas; los valles pueden indicar problemas operativos o fechas festivas.'""",
              "anomaly", "info", 5, "odd"),
        _rule(12, "'Balance de categorías'", f"""'Las 3 categorías principales concentran el ' || printf('%.0f', {O.R('sum3', 0)}) || '% del revenue: ' || items || '. ' ||
  CASE WHEN top_pct < 40 THEN 'La distribución está relativamente balanceada.' ELSE top_cat || ' domina con ' || CAST(top_pct AS VARCHAR) || '% — alta dependencia de una categoría.' END""",
              "revenue", "CASE WHEN top_pct < 40 THEN 'info' ELSE 'warning' END", 4, "bal"),
    ]
    defaults = ", ".join(str((k, *v)) for k, v in I.INSIGHT_DEFAULTS.items())
    union = "\nUNION ALL ".join(rules)
    body = f"""{_module('products_pareto', 'pp')},
{_module('basket_pairs', 'bp')},
{_module('summary', 'su')},
{_module('ticket_stats', 'ts')},
{_module('profitability', 'pf')},
{_module('margin_by_category', 'mc')},
{_module('high_lift_pairs', 'hl')},
{_module('anomaly_days', 'an')},
{_module('category_totals', 'ct')},
{_on_lines_a('peak_moments', 'pk')},
{_trends_cte()},
sides AS (SELECT store_id, product_a AS product, rank * 2 AS pos FROM bp UNION ALL SELECT store_id, product_b, rank * 2 + 1 FROM bp),
counted AS (SELECT store_id, category, count(*) AS n, min(pos) AS first_pos FROM sides JOIN pp USING (store_id, product) GROUP BY 1, 2),
anchor AS (SELECT store_id, category AS cat, {_pct0('n / sum(n) OVER (PARTITION BY store_id) * 100.0')} AS pct FROM counted
           QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY n DESC, first_pos) = 1),
tops AS (SELECT *, count(*) OVER (PARTITION BY store_id, class) AS n, row_number() OVER (PARTITION BY store_id, class ORDER BY rank) AS k FROM pf),
cls AS (SELECT store_id, class, min(n) AS n, avg(avg_margin) AS m, avg(orders) AS o, sum(profit_share) AS ps, sum(revenue) AS rev
        FROM tops WHERE k <= 3 GROUP BY 1, 2),
mcm AS (SELECT *, avg(avg_margin) OVER (PARTITION BY store_id) AS mean_m FROM mc),
his AS (SELECT store_id, category, row_number() OVER (PARTITION BY store_id ORDER BY rank) AS k FROM mcm WHERE avg_margin >= mean_m),
disp AS (SELECT store_id, count(*) AS n, arg_max(avg_margin, rank) AS min_m, arg_min(avg_margin, rank) AS max_m, arg_min(category, rank) AS max_c,
                arg_max(category, rank) AS min_c,
                (SELECT string_agg(category, ', ' ORDER BY k) FROM his WHERE his.store_id = mcm.store_id AND k <= 2) AS hi FROM mcm GROUP BY 1),
moves AS (SELECT store_id, direction, min(base_month) AS b, min(compare_month) AS c, min(eligible_count) AS e,
                 string_agg('<strong>' || product || '</strong> (' || CASE WHEN direction = 'up' THEN '+' ELSE '' END || CAST(growth_pct AS VARCHAR) || '%)', ', ' ORDER BY rank)
                   FILTER (WHERE rank <= 3) AS items FROM tr GROUP BY 1, 2),
odd AS (SELECT store_id, min(avg_daily_revenue) AS avg_r, min(std_daily_revenue) AS std_r,
               max('Día de mayor pico: <strong>' || date_label || '</strong> ($' || {_n('revenue')} || ', ' || CAST(z_score AS VARCHAR) || 'σ sobre la media)') FILTER (WHERE kind = 'high') AS hi,
               max('Día más bajo: <strong>' || date_label || '</strong> ($' || {_n('revenue')} || ', ' || CAST(abs(z_score) AS VARCHAR) || 'σ bajo la media)') FILTER (WHERE kind = 'low') AS lo
        FROM an WHERE rank = 1 GROUP BY 1),
shares AS (SELECT *, round_even(revenue / sum(revenue) OVER (PARTITION BY store_id) * 100.0, 1) AS pct FROM ct),
bal AS (SELECT store_id, sum(pct) AS sum3, arg_min(category, rank) AS top_cat, arg_min(pct, rank) AS top_pct,
               string_agg('<strong>' || category || '</strong> (' || CAST(pct AS VARCHAR) || '%)', ', ' ORDER BY rank) AS items FROM shares WHERE rank <= 3 GROUP BY 1),
fired AS ({union}),
d AS (SELECT * FROM (VALUES {defaults}) v(category, a, o, h))
SELECT store_id, CAST(rule_ix AS INTEGER) AS rule_ix, title, body, category, severity, CAST(priority AS INTEGER) AS priority,
       CASE WHEN action = '' THEN a ELSE action END AS action, CASE WHEN owner = '' THEN o ELSE owner END AS owner,
       CASE WHEN horizon = '' THEN h ELSE horizon END AS horizon,
       CAST(row_number() OVER (PARTITION BY store_id ORDER BY priority, rule_ix) AS INTEGER) AS rank
FROM fired LEFT JOIN d USING (category)"""
    return with_ctes(QR.LA, body=body)


def _quality_cte() -> str:
    """The quality counts of the raw rows over the days of binding A."""
    sql = REGISTRY["quality_coverage"][1].replace("FROM typed_a_clean", "FROM lines_a")
    return f"qu AS (WITH {O.lines_a()}, {sql.strip().removeprefix('WITH')})"


def _bundles_cte() -> str:
    c = CFG_INSIGHTS
    sql = QR._bundle_sql().replace(QR.LA_BRAND, QR.LA)
    return f"""lr AS (WITH {sql}
  SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY balanced_score DESC, confidence DESC, "count" DESC, anchor, target) AS rank
  FROM bs WHERE launch_ready QUALIFY rank <= {c.launch_top_k})"""


def _recommendations_sql() -> str:
    return with_ctes(QR.LA, body=f"""{_module('products_pareto', 'pp')},
{_module('high_lift_pairs', 'hl')},
{_on_lines_a('opportunity_hours', 'op')},
{_bundles_cte()},
{_quality_cte()},
u AS (
  SELECT store_id, 0 AS ix, 'ALTO' AS impact, 'Catálogo' AS owner, '1 semana' AS horizon,
         'Blindar disponibilidad y visibilidad de los ' || n_pareto || ' SKUs que concentran el 80% del revenue.' AS action FROM pp WHERE rank = 1
  UNION ALL SELECT store_id, 1, 'MEDIO', 'Growth', '2 semanas',
         'Ejecutar test de upsell en la franja ' || sale_hour || ':00 (alto tráfico con ticket por debajo de la media).' FROM op WHERE rank = 1
  UNION ALL SELECT store_id, 2, 'ALTO', 'Growth + Comercial', '2 semanas',
         'Probar bundle guiado para ' || product_a || ' + ' || product_b || ' (lift ' || CAST(lift AS VARCHAR) || ').' FROM hl WHERE rank = 1
  UNION ALL SELECT store_id, 3, 'ALTO', 'Growth + Pricing', '1-2 semanas',
         'Activar bundle ' || anchor || ' + ' || target || ' (confidence ' || {_f1('confidence * 100')} || '%, lift ' || printf('%.2f', lift) || ').'
         FROM lr WHERE rank = 1
  UNION ALL SELECT store_id, 4, 'ALTO', 'BI', '72 horas',
         'Corregir cobertura temporal y calidad de datos antes de tomar decisiones de mediano plazo.' FROM qu WHERE risk_level = 'high')
SELECT store_id, CAST(ix AS INTEGER) AS ix, impact, owner, horizon, action,
       CAST(row_number() OVER (PARTITION BY store_id ORDER BY ix) AS INTEGER) AS rank
FROM u QUALIFY rank <= 3""")


def _counts_cte() -> str:
    """Per store the numbers of insights and recommendations."""
    return f"""ni AS (SELECT store_id, count(*) AS n_insights FROM ({_insights_sql()}) GROUP BY 1),
nr AS (SELECT store_id, count(*) AS n_recommendations FROM ({_recommendations_sql()}) GROUP BY 1)"""


def _tier_counts_sql() -> str:
    return f"""WITH {_counts_cte()},
t AS (SELECT * FROM ni LEFT JOIN nr USING (store_id) CROSS JOIN (SELECT unnest(['free', 'pro', 'premium']) AS tier)),
s AS (SELECT *, CASE WHEN tier = 'free' THEN least(n_insights, {G.FREE_INSIGHTS}) ELSE n_insights END AS shown FROM t)
SELECT store_id, tier, shown AS insights_shown, n_insights - shown AS locked_insights,
       CASE WHEN tier = 'premium' THEN COALESCE(n_recommendations, 0) ELSE 0 END AS recommendations_shown FROM s"""


def _summary_row_sql() -> str:
    modules = ", ".join(f"'{m}'" for m in G.MODULES)
    return f"""WITH {_counts_cte()}, {_module('summary', 'su')}, {_quality_cte()}
SELECT su.*, COALESCE(n_insights, 0) AS n_insights, COALESCE(n_recommendations, 0) AS n_recommendations, qu.risk_level, qu.dropped_pct,
       [{modules}] AS modules
FROM su LEFT JOIN ni USING (store_id) LEFT JOIN nr USING (store_id) LEFT JOIN qu USING (store_id)"""


def _tier_modules_sql() -> str:
    c = CFG_INSIGHTS
    grid = ", ".join(f"('{t}', '{m}', {i}, {m in ms})" for t, ms in G.TIER_MODULES.items() for i, m in enumerate(G.MODULES))
    rules = f"ru AS (WITH {QR.LA}, {O.basket('lines_a')}, {O.rules(c.rule_min_count, c.rule_min_confidence, c.rule_top_k)} SELECT * FROM rules)"

    def n(cte: str, where: str = "true") -> str:
        return f"(SELECT count(*) FROM {cte} WHERE {cte}.store_id = su.store_id AND {where})"

    return with_ctes(QR.LA, body=f"""{_module('summary', 'su')},
{_module('basket_pairs', 'bp')},
{_module('anomaly_days', 'an')},
{_on_lines_a('opportunity_hours', 'op')},
{_trends_cte()},
{_bundles_cte()},
{rules},
f AS (SELECT store_id, multi_item_orders, {n('bp')} AS n_pairs, {n('tr', "direction = 'up'")} AS n_up, {n('tr', "direction = 'down'")} AS n_down,
             {n('op')} AS n_opp, {n('an', "kind = 'high'")} AS n_high, {n('an', "kind = 'low'")} AS n_low, {n('ru')} AS n_rules, {n('lr')} AS n_launch
      FROM su),
g AS (SELECT * FROM (VALUES {grid}) v(tier, module, module_ix, allowed) WHERE allowed OR module <> 'interactive_base')
SELECT store_id, tier, CAST(module_ix AS INTEGER) AS module_ix, module, CASE WHEN allowed THEN 'allowed' ELSE 'locked' END AS status,
  CASE WHEN allowed THEN NULL
       WHEN module = 'basket' THEN printf('Detectamos %d combinaciones de productos que tus clientes compran juntas.', n_pairs)
       WHEN module = 'cart' THEN 'Analizamos ' || replace(format('{{:,}}', multi_item_orders), ',', '.') ||
            ' carritos multi-producto: hay oportunidades claras para subir el ticket promedio.'
       WHEN module = 'trends' THEN printf('%d productos tuyos están creciendo y %d están cayendo. ¿Sabes cuáles?', n_up, n_down)
       WHEN module = 'ticket' THEN printf('Encontramos %d franjas horarias con ticket por debajo de tu potencial.', n_opp)
       WHEN module = 'anomalies' THEN printf('Hubo %d días excepcionales y %d días inusualmente bajos en tu periodo.', n_high, n_low)
       WHEN module = 'basket_rules' THEN printf('%d reglas de asociación con potencial de combos y promociones.', n_rules)
       WHEN module = 'profitability' THEN 'Qué productos te dejan utilidad real (requiere ingresar márgenes — te guiamos).'
       WHEN module = 'bundles' THEN CASE WHEN n_launch > 0 THEN printf('%d combos listos para lanzar según tus propios datos.', n_launch)
            ELSE 'Combos sugeridos con base en tus ventas reales.' END
       ELSE 'Análisis avanzado disponible en planes superiores.' END AS teaser
FROM f CROSS JOIN g""")


@register("insights", _insights_sql())
def q_insights(spark, d):
    return I.insights(_inputs(spark, d))


@register("recommendations", _recommendations_sql())
def q_recommendations(spark, d):
    return I.recommendations(_inputs(spark, d))


@register("tier_modules", _tier_modules_sql())
def q_tier_modules(spark, d):
    return G.tier_modules(_inputs(spark, d))


@register("tier_insight_counts", _tier_counts_sql())
def q_tier_insight_counts(spark, d):
    return G.gated_counts(_inputs(spark, d))


@register("report_summary_row", _summary_row_sql())
def q_report_summary_row(spark, d):
    return G.summary_row(_inputs(spark, d))


def _contract_sql() -> str:
    """No violation of any field of the checked modules, in any store."""
    checked = ("summary", "quality", "products", "basket_pairs", "trends", "anomalies", "day_ticket", "basket_rules",
               "profitability", "insights", "recommendations")
    rows = [(m, f.name, c) for m in checked for f in CONTRACT[m] for c, on in (
        ("null", not f.null), ("finite", f.kind == "number"), ("values", f.values)) if on]
    values = ", ".join(str(r) for r in rows)
    return f"""SELECT s.store_id, v.module, v.field, v."check", CAST(0 AS BIGINT) AS violations
FROM {O.STORES_SQL} s CROSS JOIN (VALUES {values}) v(module, field, "check")"""


@register("contract_violations", _contract_sql())
def q_contract_violations(spark, d):
    return G.contract_violations(_inputs(spark, d))
