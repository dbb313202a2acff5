"""The report contract (S15) as data, compiled to one aggregation per module.

A contract lists the fields of a module: their kind, whether they may be null, the values they may have, and the fields of
nested records.  ``check`` turns it into counts over schema and values: a field that isn't there or has another type
counts every row, numbers must be finite, and the elements of a nested list are checked in place.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.operators._common import STORE

KINDS = {
    "number": (T.DoubleType, T.FloatType, T.DecimalType, T.LongType, T.IntegerType, T.ShortType, T.ByteType),
    "string": (T.StringType, T.DateType, T.TimestampType), "boolean": (T.BooleanType,), "list": (T.ArrayType,),
    "map": (T.MapType,), "record": (T.StructType,),
}


@dataclass(frozen=True)
class Field:
    """``name`` of a ``kind``; ``null``: may be null; ``values``: the only ones allowed; ``fields``: of its records."""

    name: str
    kind: str = "number"
    null: bool = False
    values: tuple = ()
    fields: tuple["Field", ...] = ()


def _many(names: str, kind: str = "number", null: bool = False) -> tuple[Field, ...]:
    return tuple(Field(n, kind, null) for n in names.split())


#: The report contract over our module tables (null where a module's numbers may be null).
CONTRACT: dict[str, tuple[Field, ...]] = {
    "summary": _many("total_revenue total_orders total_units avg_ticket avg_items_per_order unique_products multi_item_pct "
                     "multi_item_orders") + _many("date_min date_max", "string"),
    "quality": _many("initial_rows valid_rows dropped_pct invalid_dates missing_days incomplete_weeks")
    + (Field("risk_level", "string", values=("low", "medium", "high")),),
    "products": _many("product category", "string") + _many("rank n_pareto total_products")
    + _many("avg_price cum_rev_pct orders rev_share revenue units", null=True) + _many("in_pareto", "boolean"),
    "basket_pairs": _many("product_a product_b", "string") + _many("count total_baskets") + _many("lift support", null=True),
    "trends": _many("product base_month compare_month", "string") + _many("eligible_count") + _many("growth_pct", null=True)
    + (Field("direction", "string", values=("up", "down")),),
    "anomalies": _many("sale_date", "string") + _many("orders") + _many("revenue z_score", null=True)
    + (Field("kind", "string", values=("high", "low")),),
    "day_ticket": _many("day", "string") + _many("orders") + _many("avg_ticket", null=True),
    "basket_rules": _many("antecedent consequent", "string") + _many("count")
    + _many("support confidence lift conviction score", null=True),
    "profitability": _many("product category", "string") + _many("n_profit_pareto")
    + _many("avg_margin cum_profit_pct orders profit profit_share revenue units", null=True)
    + (Field("class", "string", values=("Champion", "Tractor", "Gem", "Niche")),),
    "insights": _many("title body category severity action owner horizon", "string") + _many("priority"),
    "recommendations": _many("impact owner horizon action", "string"),
    "delta_orders": _many("date order_id", "string") + _many("revenue units") + _many("products categories", "list"),
}


def _finite(c: Column, kind: T.DataType) -> Column:
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.lit(True)
    return ~F.isnan(c) & ~c.isin(float("inf"), float("-inf"))


def _broken(c: Column, kind: T.DataType, field: Field) -> list[tuple[str, Column]]:
    """(check, whether a value breaks it) of a field that has the right type."""
    out = []
    if not field.null:
        out.append(("null", c.isNull()))
    if field.kind == "number":
        out.append(("finite", ~F.coalesce(_finite(c, kind), F.lit(True))))
    if field.values:
        out.append(("values", ~F.coalesce(c.isin(*field.values), F.lit(True))))
    return out


def _element(field: Field, kind: T.DataType, check: str):
    """Whether a list's record breaks a check of one of its fields."""
    return lambda x: dict(_broken(x[field.name], kind, field))[check]


def _counts(c: Column, kind: T.DataType | None, field: Field, path: str, rows: Column) -> list[tuple[str, str, Column]]:
    """(path, check, count over the rows) of a field and the fields of its records."""
    if kind is None:
        return [(path, "missing", rows)]
    if not isinstance(kind, KINDS[field.kind]):
        return [(path, "type", rows)]
    out = [(path, check, F.count_if(bad)) for check, bad in _broken(c, kind, field)]
    if field.kind == "list" and field.fields:
        inner = kind.elementType
        for f in field.fields:
            at = f"{path}[].{f.name}"
            if not isinstance(inner, T.StructType) or f.name not in inner.fieldNames():
                out.append((at, "missing", F.coalesce(F.sum(F.size(c)), F.lit(0))))
                continue
            of = inner[f.name].dataType
            if not isinstance(of, KINDS[f.kind]):
                out.append((at, "type", F.coalesce(F.sum(F.size(c)), F.lit(0))))
                continue
            for check, _ in _broken(F.lit(None), of, f):
                out.append((at, check, F.coalesce(F.sum(F.size(F.filter(c, _element(f, of, check)))), F.lit(0))))
    return out


def check(df: DataFrame, module: str, fields: tuple[Field, ...] | None = None) -> DataFrame:
    """``store_id, module, field, check, violations`` of one module table, each store with a row per field and check."""
    fields = CONTRACT[module] if fields is None else fields
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = F.count(F.lit(1))
    counts = [x for f in fields for x in _counts(F.col(f"`{f.name}`"), types.get(f.name), f, f.name, rows)]
    held = df.groupBy(STORE).agg(*[c.cast("bigint").alias(f"n{i}") for i, (_, _, c) in enumerate(counts)])
    each = F.array(*[F.struct(F.lit(path).alias("field"), F.lit(name).alias("check"), F.col(f"n{i}").alias("violations"))
                     for i, (path, name, _) in enumerate(counts)])
    return held.select(STORE, F.lit(module).alias("module"), F.inline(each))


def check_all(modules: dict[str, DataFrame]) -> DataFrame:
    """:func:`check` of all modules that the contract knows."""
    return reduce(DataFrame.unionByName, [check(df, name) for name, df in modules.items() if name in CONTRACT])
