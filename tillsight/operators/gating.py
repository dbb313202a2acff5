"""Plan entitlements (P27), stored summary row (A50) and report contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.operators import basket, contract, ticket
from tillsight.operators._common import STORE
from tillsight.operators.insights import ReportInputs, insights, recommendations

# Modules visible per plan tier — fixed values.
TIER_MODULES: dict[str, tuple[str, ...]] = {
    "free": ("timeline", "products"),
    "pro": ("timeline", "products", "basket", "cart", "trends", "ticket", "anomalies", "basket_rules"),
    "premium": ("timeline", "products", "basket", "cart", "trends", "ticket", "anomalies", "basket_rules",
                "profitability", "bundles", "interactive_base"),
}
FREE_INSIGHTS = 3
MODULES = ("interactive_base", "timeline", "products", "basket", "cart", "trends", "anomalies", "ticket",
           "basket_rules", "profitability", "bundles")


def _es_int(c: Column) -> Column:
    """Integer with '.' thousands separators (es-CO)."""
    return F.replace(F.format_number(c, 0), F.lit(","), F.lit("."))


def module_facts(x: ReportInputs) -> DataFrame:
    """One row per store with the counts the teasers quote."""
    s = x.summary.select(STORE, "multi_item_orders")
    cnt = lambda df, name: df.groupBy(STORE).agg(F.count(F.lit(1)).alias(name))
    pairs = cnt(x.pairs.filter(F.col("rank") <= x.cfg.top_n_pairs), "n_pairs")
    up = cnt(x.trends.filter(F.col("direction") == "up"), "n_up")
    down = cnt(x.trends.filter(F.col("direction") == "down"), "n_down")
    opp = cnt(x.opportunity, "n_opp")
    hi = cnt(x.anomalies.filter(F.col("kind") == "high"), "n_high")
    lo = cnt(x.anomalies.filter(F.col("kind") == "low"), "n_low")
    rules = cnt(x.get("rules", lambda: basket.rules(x.lines, x.cfg)), "n_rules")
    lr = cnt(x.launch_ready, "n_launch")
    out = s
    for d in (pairs, up, down, opp, hi, lo, rules, lr):
        out = out.join(d, STORE, "left")
    return out.na.fill(0)


def _teaser(module: Column) -> Column:
    return (
        F.when(module == "basket", F.format_string("Detectamos %d combinaciones de productos que tus clientes compran juntas.", "n_pairs"))
        .when(module == "cart", F.format_string(
            "Analizamos %s carritos multi-producto: hay oportunidades claras para subir el ticket promedio.", _es_int(F.col("multi_item_orders"))))
        .when(module == "trends", F.format_string("%d productos tuyos están creciendo y %d están cayendo. ¿Sabes cuáles?", "n_up", "n_down"))
        .when(module == "ticket", F.format_string("Encontramos %d franjas horarias con ticket por debajo de tu potencial.", "n_opp"))
        .when(module == "anomalies", F.format_string(
            "Hubo %d días excepcionales y %d días inusualmente bajos en tu periodo.", "n_high", "n_low"))
        .when(module == "basket_rules", F.format_string("%d reglas de asociación con potencial de combos y promociones.", "n_rules"))
        .when(module == "profitability", F.lit("Qué productos te dejan utilidad real (requiere ingresar márgenes — te guiamos)."))
        .when(module == "bundles", F.when(F.col("n_launch") > 0, F.format_string("%d combos listos para lanzar según tus propios datos.", "n_launch"))
              .otherwise(F.lit("Combos sugeridos con base en tus ventas reales.")))
        .otherwise(F.lit("Análisis avanzado disponible en planes superiores."))
    )


def tier_modules(x: ReportInputs) -> DataFrame:
    """(store, tier, module, status, teaser): allowed modules pass, ``interactive_base`` is
    dropped silently when not allowed, the rest are locked with a teaser quoting a real count."""
    facts = module_facts(x)
    grid = F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(m).alias("module"), F.lit(i).alias("module_ix"),
                              F.lit(m in TIER_MODULES[t]).alias("allowed"))
                     for t in TIER_MODULES for i, m in enumerate(MODULES)])
    g = facts.select("*", F.inline(grid)).filter(F.col("allowed") | (F.col("module") != "interactive_base"))
    return g.select(STORE, "tier", "module_ix", "module", F.when(F.col("allowed"), "allowed").otherwise("locked").alias("status"),
                    F.when(F.col("allowed"), F.lit(None).cast("string")).otherwise(_teaser(F.col("module"))).alias("teaser"))


def tier_table(spark) -> DataFrame:
    """(tier, module): what each plan tier may see."""
    return spark.createDataFrame([(t, m) for t, ms in TIER_MODULES.items() for m in ms], "tier string, module string")


def entitled(rows: DataFrame, tiers: DataFrame, module: str | Column) -> DataFrame:
    """The rows of a module table (or of several, told apart by the column ``module``) that stores may see.

    ``tiers`` has (store_id, tier).  A semi-join against the tiers' modules: rows of stores without a tier and of
    modules that a tier doesn't name are gone.
    """
    may = tiers.join(tier_table(rows.sparkSession), "tier").select(
        F.col(STORE).alias("_store"), F.col("module").alias("_module"))
    name = F.lit(module) if isinstance(module, str) else module
    return rows.join(may, (F.col(STORE) == F.col("_store")) & (name == F.col("_module")), "left_semi")


def leaked(shown: DataFrame, tiers: DataFrame, module: str | Column) -> DataFrame:
    """The rows of an output that the stores' tiers don't allow: none, if the output is gated."""
    may = tiers.join(tier_table(shown.sparkSession), "tier").select(
        F.col(STORE).alias("_store"), F.col("module").alias("_module"))
    name = F.lit(module) if isinstance(module, str) else module
    return shown.join(may, (F.col(STORE) == F.col("_store")) & (name == F.col("_module")), "left_anti")


def gated_counts(x: ReportInputs) -> DataFrame:
    """Per store and tier: insights shown (free: first 3), locked insights, recommendations (premium only)."""
    n_ins = insights(x).groupBy(STORE).agg(F.count(F.lit(1)).alias("n_insights"))
    n_rec = recommendations(x).groupBy(STORE).agg(F.count(F.lit(1)).alias("n_recommendations"))
    base = x.summary.select(STORE).join(n_ins, STORE, "left").join(n_rec, STORE, "left").na.fill(0)
    tiers = F.array(*[F.lit(t) for t in TIER_MODULES])
    t = base.select("*", F.explode(tiers).alias("tier"))
    shown = F.when(F.col("tier") == "free", F.least(F.col("n_insights"), F.lit(FREE_INSIGHTS))).otherwise(F.col("n_insights"))
    return t.select(STORE, "tier", shown.alias("insights_shown"), (F.col("n_insights") - shown).alias("locked_insights"),
                    F.when(F.col("tier") == "premium", F.col("n_recommendations")).otherwise(0).alias("recommendations_shown"))


def summary_row(x: ReportInputs) -> DataFrame:
    """The stored per-report row — summary, risk, module keys and counts."""
    n_ins = insights(x).groupBy(STORE).agg(F.count(F.lit(1)).alias("n_insights"))
    n_rec = recommendations(x).groupBy(STORE).agg(F.count(F.lit(1)).alias("n_recommendations"))
    s = x.summary.join(n_ins, STORE, "left").join(n_rec, STORE, "left").na.fill(0, ["n_insights", "n_recommendations"])
    if x.quality is not None:
        s = s.join(x.quality_table.select(STORE, "risk_level", "dropped_pct"), STORE, "left")
    return s.withColumn("modules", F.array(*[F.lit(m) for m in MODULES]))


def contract_violations(x: ReportInputs) -> DataFrame:
    """Per store, module, field and check, the number of values that break the report contract."""
    return contract.check_all({
        "summary": x.summary, "quality": x.quality_table, "products": x.products, "basket_pairs": x.pairs, "trends": x.trends,
        "anomalies": x.anomalies, "day_ticket": x.get("day_ticket", lambda: ticket.day_ticket(x.lines)),
        "basket_rules": x.get("rules", lambda: basket.rules(x.lines, x.cfg)), "profitability": x.profit,
        "insights": insights(x), "recommendations": recommendations(x)})
