"""Cleaning: required columns, coercion with counted failures, discard reasons, categories.

The input is a raw, all-text line table in POS/normalized column names.  Every bad
value becomes null (``try_*`` functions: Spark runs in ANSI mode), is counted in one
aggregation, and a line is discarded iff one of date, order, product, quantity, total,
hour is null; its reasons are joined in a fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.config import DEFAULT_REPORT, DISCARD_LABELS, ReportConfig
from tillsight.functions.dates import parse_date, parse_hour
from tillsight.functions.numbers import margin_is_missing, parse_margin
from tillsight.functions.text import blank_to_null
from tillsight.operators._common import STORE
from tillsight.schema import conform

# Normalized-export column names (the report's input), by canonical role.
REPORT_COLUMNS: dict[str, str] = {
    "date": "Fecha",
    "time": "Hora",
    "order_id": "Código venta",
    "product_raw": "Producto",
    "quantity": "Cantidad",
    "unit_price": "Individual",
    "total": "Total",
    "product": "Nombre Corregido",
    "category": "Categoria Real",
    "subcategory": "Sub Categoria Real",
    "margin_pct": "margin_pct",
    "hour": "Hour",
}

REQUIRED_ROLES = ("date", "order_id", "product", "quantity", "unit_price", "total", "category")


class SchemaError(ValueError):
    pass


def resolve_columns(columns: list[str], aliases: dict[str, str] | None = None) -> dict[str, str]:
    """Role → column name, after tenant aliases; raises listing the missing ones (sorted).

    Either an ``Hour`` or a ``Hora`` column satisfies the hour requirement.
    """
    names = dict(REPORT_COLUMNS)
    for k, v in (aliases or {}).items():
        if k in names:
            names[k] = v
    have = set(columns)
    missing = [names[r] for r in REQUIRED_ROLES if names[r] not in have]
    if names["hour"] not in have and names["time"] not in have:
        missing.append(names["hour"])
    if missing:
        raise SchemaError("CSV inválido: faltan columnas requeridas: " + ", ".join(sorted(missing)))
    return {r: c for r, c in names.items() if c in have}


def coerce(raw: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Typed columns + ``margin_state`` (present/missing/invalid) + ``motivo_descarte``.

    ``original`` keeps the row as it came, for the report of discarded rows.
    """
    cols = resolve_columns(raw.columns, aliases)

    def c(role: str) -> Column:
        return F.col(f"`{cols[role]}`")

    def typed_as(role: str, kind: str) -> bool:
        return raw.schema[cols[role]].dataType.simpleString() == kind

    def number(role: str, kind: str) -> Column:
        """A column that already has the type isn't turned to text and back."""
        return c(role) if typed_as(role, kind) else F.trim(c(role)).try_cast(kind)

    # a column of hours with a gap is written as "13.0"
    hour = (parse_hour(c("time")) if "hour" not in cols else c("hour") if typed_as("hour", "int")
            else F.trim(c("hour").cast("string")).try_cast("double").try_cast("int"))
    has_margin = "margin_pct" in cols
    margin = parse_margin(c("margin_pct")) if has_margin else F.lit(None).cast("double")
    if has_margin:
        missing = margin_is_missing(c("margin_pct"))
        state = F.when(missing, "missing").when(margin.isNull(), "invalid").otherwise("present")
    else:
        state = F.lit("absent")
    # the reasons filter on the date that the lines show: as a list of one it is parsed once for both, after its text is made
    typed = raw.select("*", F.explode(F.array(parse_date(c("date")))).alias("_date")).select(
        F.col(STORE) if STORE in raw.columns else F.lit("S0").alias(STORE),
        (F.col("row_seq") if "row_seq" in raw.columns else F.lit(None).cast("bigint")).alias("row_seq"),
        F.col("_date").alias("sale_date"),
        hour.alias("sale_hour"),
        blank_to_null(c("order_id")).alias("order_id"),
        blank_to_null(c("product")).alias("product"),
        (blank_to_null(c("product_raw")) if "product_raw" in cols else blank_to_null(c("product"))).alias("product_raw"),
        c("category").alias("category_raw"),
        (c("subcategory") if "subcategory" in cols else F.lit(None).cast("string")).alias("subcategory"),
        number("quantity", "decimal(18,6)").alias("quantity"),
        number("unit_price", "decimal(18,4)").alias("unit_price"),
        number("total", "decimal(18,4)").alias("total"),
        margin.alias("margin_pct"),
        state.alias("margin_state"),
        F.struct(*[F.col(f"`{x}`") for x in raw.columns if x not in (STORE, "row_seq")]).alias("original"),
    )
    reason = F.concat_ws("; ", *[F.when(F.col(col).isNull(), F.lit(label)) for col, label in DISCARD_LABELS])
    return typed.withColumn("motivo_descarte", reason)


def normalize_category(c: Column, mapping: dict[str, str] | None) -> Column:
    """Lookup in a small literal map (unknown → ``Otros``); ``None`` = identity."""
    if mapping is None:
        return F.coalesce(c, F.lit("Otros"))
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.element_at(m, c), F.lit("Otros"))


def store_categories(lines: DataFrame, configs: DataFrame, raw: str = "category_raw") -> DataFrame:
    """``category`` by each store's own ``category_map`` (unknown -> ``Otros``); a store without one keeps its own."""
    own = configs.select(STORE, F.col("category_map").alias("_cfg_map"))
    named = F.when(F.col("_cfg_map").isNull(), F.col(raw)).otherwise(F.element_at("_cfg_map", F.col(raw)))
    return lines.join(own, STORE, "left").withColumn("category", F.coalesce(named, F.lit("Otros"))).drop("_cfg_map")


def with_store_aliases(raw: DataFrame, configs: DataFrame) -> DataFrame:
    """Text rows of stores whose exports name the report's columns in their own way, under the report's names.

    ``configs`` has ``columns`` (map: role -> the store's column).  A role that a store doesn't rename is read from the
    report's own column; a column that isn't there is null.
    """
    kept = [c for c in raw.columns if c in (STORE, "row_seq")]
    cells = F.create_map(*[x for c in raw.columns if c not in kept for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])
    held = raw.join(configs.select(STORE, F.col("columns").alias("_alias")), STORE, "left").withColumn("_cells", cells)
    own = {name: F.element_at("_cells", F.coalesce(F.element_at("_alias", F.lit(role)), F.lit(name)))
           for role, name in REPORT_COLUMNS.items()}
    # a store without a column of hours has them from its times
    has_hour = F.coalesce(F.map_contains_key("_alias", F.lit("hour")), F.lit(False)) | F.lit(REPORT_COLUMNS["hour"] in raw.columns)
    own["Hour"] = F.when(has_hour, own["Hour"]).otherwise(parse_hour(own["Hora"]).cast("string"))
    extras = [c for c in raw.columns if c not in kept and c not in own]
    return held.select(*kept, *[v.alias(name) for name, v in own.items()], *[F.col(f"`{c}`") for c in extras])


def sanitize(raw: DataFrame, cfg: ReportConfig = DEFAULT_REPORT, aliases: dict[str, str] | None = None):
    """Return ``(lines, discarded, quality)``, all lazy DataFrames.

    ``lines`` conforms to ``sales_lines``; ``discarded`` keeps the row's original
    text with ``fila_original`` and ``motivo_descarte``; ``quality`` has one row per store.
    """
    typed = coerce(raw, aliases)
    keep = typed.filter(F.col("motivo_descarte") == "")
    table = getattr(cfg, "table", None)
    named = (store_categories(keep, table) if table is not None
             else keep.withColumn("category", normalize_category(F.col("category_raw"), cfg.category_map)))
    lines = conform(named)
    discarded = typed.filter(F.col("motivo_descarte") != "").select(
        STORE, F.col("row_seq").alias("fila_original"), "original.*", "motivo_descarte")
    return lines, discarded, quality_counts(typed)


def _counted() -> dict[str, Column]:
    """Name of a count of :func:`quality_counts` -> the rows that it counts."""
    return {
        "valid_rows": F.col("motivo_descarte") == "",
        "invalid_dates": F.col("sale_date").isNull(),
        "invalid_quantity": F.col("quantity").isNull(),
        "invalid_unit_price": F.col("unit_price").isNull(),
        "invalid_total": F.col("total").isNull(),
        "invalid_hour": F.col("sale_hour").isNull(),
        "margin_missing": F.col("margin_state") == "missing",
        "margin_invalid": F.col("margin_state") == "invalid",
    }


def quality_days(typed: DataFrame) -> DataFrame:
    """The counts of :func:`quality_counts` per (store, date): all that quality and coverage need of the rows."""
    return typed.groupBy(STORE, "sale_date").agg(
        F.count(F.lit(1)).alias("initial_rows"), *[F.count_if(c).alias(n) for n, c in _counted().items()])


def quality_counts(typed: DataFrame) -> DataFrame:
    """One aggregation: initial/valid rows, dropped %, invalid counts per column."""
    q = typed.groupBy(STORE).agg(
        F.count(F.lit(1)).alias("initial_rows"), *[F.count_if(c).alias(n) for n, c in _counted().items()])
    return _with_dropped(q)


def quality_of_days(days: DataFrame) -> DataFrame:
    """:func:`quality_counts` from :func:`quality_days`."""
    return _with_dropped(days.groupBy(STORE).agg(*[F.sum(c).alias(c) for c in ("initial_rows", *_counted())]))


def _with_dropped(q: DataFrame) -> DataFrame:
    return q.withColumn("dropped_rows", F.col("initial_rows") - F.col("valid_rows")).withColumn(
        "dropped_pct",
        F.when(F.col("initial_rows") == 0, F.lit(0.0)).otherwise(
            F.round(F.col("dropped_rows").cast("double") / F.col("initial_rows").cast("double") * 100.0, 2)),
    )


def discard_reasons(discarded: DataFrame) -> DataFrame:
    """Discarded-line counts per (store, reason string)."""
    return discarded.groupBy(STORE, "motivo_descarte").agg(F.count(F.lit(1)).alias("rows"))


def margin_parse_stats(typed: DataFrame) -> DataFrame:
    """Margin outcome per store: present/missing/invalid counts and the parsed sum."""
    return typed.groupBy(STORE).agg(
        F.count_if(F.col("margin_state") == "present").alias("margin_present"),
        F.count_if(F.col("margin_state") == "missing").alias("margin_missing"),
        F.count_if(F.col("margin_state") == "invalid").alias("margin_invalid"),
        F.round(F.sum("margin_pct"), 2).alias("margin_sum"),
        F.round(F.avg("margin_pct"), 4).alias("margin_avg"),
    )


# ── P2: header canonicalisation (event-impact loader) ─────────────────────

# Canonical header token -> column name — fixed values.
DELTA_HEADER_ALIASES: dict[str, str] = {
    "fecha": "Fecha",
    "codigo venta": "Codigo venta",
    "cantidad": "Cantidad",
    "total": "Total",
    "nombre corregido": "Nombre Corregido",
    "categoria real": "Categoria Real",
    "sub categoria real": "Sub Categoria Real",
    "margin pct": "margin_pct",
    "margin_pct": "margin_pct",
}
DELTA_REQUIRED = ("Fecha", "Codigo venta", "Cantidad", "Total", "Nombre Corregido", "Categoria Real")


def canonicalize_columns(df: DataFrame, aliases: dict[str, str] = DELTA_HEADER_ALIASES,
                         required: tuple[str, ...] = DELTA_REQUIRED) -> DataFrame:
    """Rename headers by their canonical token (BOM stripped, accents folded, spaces
    collapsed, lower case); unknown headers only get ``ó`` → ``o``.  Missing required
    columns raise, listed sorted.  Driver-side: it only touches the schema."""
    from tillsight.functions.text import canonical_header

    names = {c: aliases.get(canonical_header(c), c.replace("ó", "o").replace("Ó", "O").strip()) for c in df.columns}
    out = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    missing = sorted(set(required) - set(out.columns))
    if missing:
        raise SchemaError("El CSV no contiene columnas requeridas: " + ", ".join(missing))
    return out
