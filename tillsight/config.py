"""Configuration of the report and event-impact operators.

Configs are small frozen dataclasses that live on the driver; operators turn the
lookups they need (category map, weekday domain, ticket bins) into tiny literal
DataFrames or ``CASE`` expressions, never into driver-side loops over data.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

# ---------------------------------------------------------------------------
# Fixed values that must equal the source product's, stated as plain data.
# ---------------------------------------------------------------------------

# Spanish weekday abbreviations, Monday first.
DAY_ORDER: tuple[str, ...] = ("Lun", "Mar", "Mié", "Jue", "Vie", "Sáb", "Dom")

# Report category normalization (raw category -> clean category); unknown -> "Otros".
REPORT_CATEGORY_MAP: dict[str, str] = {
    "Panadería": "Panadería",
    "Panaderia": "Panadería",
    "PAN": "Panadería",
    "PAN TL": "Panadería",
    "Reposteria": "Repostería",
    "Bebidas": "Bebidas",
    "Brunch": "Brunch",
    "Piñateria": "Piñatería",
    "TRUFAS X 5 UNIDADES": "Repostería",
    "-": "Otros",
}

# Event-impact category normalization (accent-free variant); unknown -> "Otros".
DELTA_CATEGORY_MAP: dict[str, str] = {
    "Panaderia": "Panaderia",
    "Panaderia ": "Panaderia",
    "Panadería": "Panaderia",
    "PAN": "Panaderia",
    "PAN TL": "Panaderia",
    "Reposteria": "Reposteria",
    "Repostería": "Reposteria",
    "Bebidas": "Bebidas",
    "Brunch": "Brunch",
    "Pinateria": "Pinateria",
    "Piñateria": "Pinateria",
    "-": "Otros",
}

# Ticket bins (right-closed) and their labels.
TICKET_BINS: tuple[float, ...] = (0, 5000, 10000, 15000, 20000, 30000, 50000, 200000)
TICKET_LABELS: tuple[str, ...] = ("<5K", "5-10K", "10-15K", "15-20K", "20-30K", "30-50K", "50K+")

# Discard reasons, in the order they are joined with "; ".
DISCARD_LABELS: tuple[tuple[str, str], ...] = (
    ("sale_date", "Fecha inválida"),
    ("order_id", "Código de venta faltante"),
    ("product", "Producto faltante"),
    ("quantity", "Cantidad inválida"),
    ("total", "Total inválido"),
    ("sale_hour", "Hora inválida"),
)

# Raw POS export columns, in file order.
POS_COLUMNS: tuple[str, ...] = (
    "Fecha", "Hora", "Código venta", "Producto", "Cantidad", "Individual", "Total",
)

# Canonical short keys accepted in a column mapping, and the POS column each one fills.
MAPPING_TARGETS: dict[str, str] = {
    "date": "Fecha",
    "time": "Hora",
    "order_id": "Código venta",
    "product": "Producto",
    "quantity": "Cantidad",
    "unit_price": "Individual",
    "total": "Total",
    "category": "Categoria Real",
    "subcategory": "Sub Categoria Real",
    "margin_pct": "margin_pct",
    "categoria": "Categoria Real",
    "subcategoria": "Sub Categoria Real",
    "margen_pct": "margin_pct",
}

# Report column aliases accepted under a tenant config's "columns" key.
COLUMN_ALIASES: tuple[str, ...] = (
    "date", "time", "order_id", "product_raw", "quantity", "unit_price", "total",
    "product", "category", "subcategory", "margin_pct", "month", "weekday", "hour",
)

# Event-impact trailing-mean width per window length.
DELTA_ROLLING_WIDTH: dict[int, int] = {7: 3, 14: 5, 30: 7}


@dataclass(frozen=True)
class ReportConfig:
    """Parameters of the sales report.  Defaults are the source product's values."""

    pareto_threshold: float = 80.0
    margin_pareto_threshold: float = 80.0
    min_basket_size: int = 2
    top_n_products: int = 20
    top_n_pairs: int = 15
    top_n_single_ticket_products: int = 15
    min_single_ticket_orders: int = 10
    rolling_window: int = 7
    trend_min_months: int = 2
    trend_min_base_revenue: float = 200000.0
    trend_min_base_orders: int = 10
    trend_min_abs_growth_pct: float = 10.0
    trend_partial_month_days: int = 20
    trend_top_k: int = 5
    anomaly_std_threshold: float = 2.0
    anomaly_top_k: int = 5
    # Basket and rule thresholds that the source hard-codes; parameters here.
    cat_pairs_top_k: int = 10
    high_lift_threshold: float = 1.5
    high_lift_top_k: int = 5
    rule_min_count: int = 15
    rule_min_confidence: float = 0.15
    rule_top_k: int = 20
    launch_min_confidence: float = 0.25
    launch_min_count: int = 20
    launch_top_k: int = 8
    test_top_k: int = 8
    ranking_top_k: int = 10
    featured_top_k: int = 6
    opportunity_quantile: float = 0.6
    opportunity_top_k: int = 5
    category_top_k_profit: int = 5
    ticket_bins: tuple[float, ...] = TICKET_BINS
    ticket_labels: tuple[str, ...] = TICKET_LABELS
    # None = identity mapping (the hosted job's behaviour); a dict = normalization lookup.
    category_map: dict[str, str] | None = None
    currency: str = "COP"

    def with_(self, **kw: Any) -> "ReportConfig":
        return replace(self, **kw)



@dataclass(frozen=True, eq=False)
class StoreConfigs(ReportConfig):
    """A report config whose limits and category map may differ by store.

    ``table`` has ``store_id`` and a column for every field of :data:`STORE_FIELDS` (null: the value of this object),
    and ``category_map`` (map; null: identity).  Operators read such a limit through ``limits``.
    """

    table: Any = None


#: Fields that a store can set for itself, with their type in a table of configurations.  Others (rolling windows,
#: quantiles) shape the plan and hold for the whole job.
STORE_FIELDS: dict[str, str] = {
    "pareto_threshold": "double", "margin_pareto_threshold": "double", "top_n_products": "int", "top_n_pairs": "int",
    "top_n_single_ticket_products": "int", "min_single_ticket_orders": "int", "trend_min_months": "int",
    "trend_min_base_revenue": "double", "trend_min_base_orders": "int", "trend_min_abs_growth_pct": "double",
    "trend_partial_month_days": "int", "trend_top_k": "int", "anomaly_std_threshold": "double", "anomaly_top_k": "int",
    "high_lift_threshold": "double", "rule_min_count": "int", "rule_min_confidence": "double", "rule_top_k": "int",
    "ticket_bins": "array<double>", "ticket_labels": "array<string>",
}
#: Category maps that a store can name instead of writing its own.
CATEGORY_PRESETS: dict[str, dict[str, str]] = {"report": REPORT_CATEGORY_MAP, "delta": DELTA_CATEGORY_MAP}


@dataclass(frozen=True)
class ProductGroup:
    name: str
    products: tuple[str, ...]


@dataclass(frozen=True)
class DeltaConfig:
    """Parameters of the event-impact report (pre/post windows round an event date)."""

    event_date: str | None = None          # ISO date; None -> default rule (needs as_of)
    as_of: str | None = None               # the "today" of the default rule; never read the clock
    window_days: int = 14
    selected_products: tuple[str, ...] = ()
    product_groups: tuple[ProductGroup, ...] = field(default_factory=tuple)
    top_products_k: int = 12
    product_impact_k: int = 18
    margin_coverage_min_pct: float = 50.0
    min_active_days: int = 2
    # None = identity mapping of categories (X11); a dict = the fixed delta lookup.
    category_map: dict[str, str] | None = None
    # Stores with an event of their own: (store_id, event_date, as_of), and (store_id, product) of their selections.
    table: Any = field(default=None, compare=False)
    selection: Any = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if self.window_days not in DELTA_ROLLING_WIDTH:
            raise ValueError("window_days must be 7, 14 or 30")

    @property
    def rolling_width(self) -> int:
        return DELTA_ROLLING_WIDTH[self.window_days]

    def with_(self, **kw: Any) -> "DeltaConfig":
        return replace(self, **kw)


DEFAULT_REPORT = ReportConfig()
