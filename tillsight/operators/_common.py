"""Shared building blocks for operators: per-store windows, top-k, domains, "first"."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.config import DAY_ORDER

STORE = "store_id"


def store_window(*order: Column) -> Window:
    """A window per store (never a global window: that would collapse to one partition)."""
    w = Window.partitionBy(STORE)
    return w.orderBy(*order) if order else w


def first_value(c: str) -> Column:
    """pandas ``first`` (first non-null in row order): ``min_by`` on ``(row_seq, value)``.

    With ``row_seq`` null (inputs without a source order) this is ``min(value)``.
    """
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.col("row_seq"), F.col(c))))


def top_k(df: DataFrame, k: int | Column | None, order: Sequence[Column], partition: Sequence[str] = (STORE,),
          rank_col: str = "rank") -> DataFrame:
    """Rank rows inside each partition by ``order`` (a total order) and keep the first ``k``.

    ``row_number() <= k`` over an aggregated input; Spark plans it with a per-partition
    group limit before the shuffle (WindowGroupLimit), so only k rows per key move.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    out = df.withColumn(rank_col, F.row_number().over(w))
    return out.filter(F.col(rank_col) <= k) if k is not None else out


def limits(df: DataFrame, cfg, *names: str) -> tuple[DataFrame, list[Column]]:
    """``df`` and the values of config fields as columns: literals, or each store's own where ``cfg`` has a table
    (:class:`tillsight.config.StoreConfigs`), which has one row per store and is joined to ``df``, an aggregate."""
    table = getattr(cfg, "table", None)
    if table is None:
        return df, [F.lit(getattr(cfg, n)) for n in names]
    own = table.select(STORE, *[F.col(n).alias(f"_cfg_{n}") for n in names])

    def default(value) -> Column:
        return F.array(*[F.lit(v) for v in value]) if isinstance(value, tuple) else F.lit(value)

    return df.join(own, STORE, "left"), [F.coalesce(F.col(f"_cfg_{n}"), default(getattr(cfg, n))) for n in names]


def weekday_domain(stores: DataFrame, extra_keys: Iterable[str] = ()) -> DataFrame:
    """Every (store, *extra_keys, weekday) with weekday in canonical order — by ``explode``.

    ``stores`` holds one row per distinct key tuple; the 7-day domain is generated per
    row, so no join against a separate domain table is needed.
    """
    days = F.array(*[F.struct(F.lit(i).alias("weekday_ix"), F.lit(d).alias("weekday")) for i, d in enumerate(DAY_ORDER)])
    keys = [STORE, *extra_keys]
    return stores.select(*keys, F.inline(days))


def dbl(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def rnd(c: str | Column, k: int) -> Column:
    return F.round(dbl(c), k)


def trunc_int(c: str | Column) -> Column:
    return dbl(c).cast("bigint")


# ── shared intermediates of one report run ─────────────────────────────────

def enable_sharing(lines: DataFrame, run_key: str) -> None:
    """Mark ``lines`` as the line table of a report run: intermediates derived from it
    through :func:`shared` (per-order totals, baskets) are then written once for the run
    and scanned by every module, instead of each module re-shuffling the full table.
    The mark is on this DataFrame object alone."""
    lines._tillsight_run = run_key


def shared(lines: DataFrame, name: str, build, always: bool = False) -> DataFrame:
    """``build()``, written once per report run; outside a run as it is, or written too if ``always``
    (for an intermediate that one plan would otherwise compute several times)."""
    key = getattr(lines, "_tillsight_run", None)
    if key is None and not always:
        return build()
    from tillsight.sources.bindings import materialized, written

    if key is None:
        return written(build(), name)
    return materialized(lines.sparkSession, f"{key}|{name}", build)


# ── grains: what several modules aggregate from, read from the lines once in a run ─────

def is_shared(lines: DataFrame) -> bool:
    return getattr(lines, "_tillsight_run", None) is not None


SLOT = ("sale_date", "weekday_ix", "weekday", "sale_hour", "year_week", "year_month", "order_id")


def slots(lines: DataFrame) -> DataFrame:
    """Lines, or in a report run their sums per (store, date, hour, order): ``total``, ``quantity``, ``n_lines``.

    Every module that groups by time, hour or order adds these up, and gets the same sums from fewer rows.
    """
    if not is_shared(lines):
        return lines.withColumn("n_lines", F.lit(1))
    return shared(lines, "slots", lambda: lines.groupBy(STORE, *SLOT).agg(
        F.sum("total").alias("total"), F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("n_lines")))


def product_grain(lines: DataFrame, item: str = "product") -> DataFrame:
    """One row per (store, product): units, revenue (exact decimals), distinct orders, mean price and observed margin,
    lines with a margin, first category.  In a report run it is written once for products, profitability and bundles."""
    return shared(lines, f"product_grain_{item}", lambda: _product_grain(lines, item))


def _product_grain(lines: DataFrame, item: str) -> DataFrame:
    """Sums are combined per (store, product, category) before they move, and only the (product, order) pairs of the
    distinct count are moved as they are; both are hash aggregates, and the lines are never sorted for them."""
    key = [F.col(STORE), F.col(item).alias("product")]
    sums = lines.groupBy(*key, "category").agg(
        F.sum("quantity").alias("units_dec"), F.sum("total").alias("revenue_dec"),
        F.sum("unit_price").alias("_price"), F.count("unit_price").alias("_n_price"),
        F.sum("margin_pct").alias("_margin"), F.count("margin_pct").alias("n_margin"), F.min("row_seq").alias("row_seq"))
    pairs = lines.select(*key, "order_id").distinct().groupBy(STORE, "product").agg(F.count("order_id").alias("orders"))
    parts = sums.unionByName(pairs, allowMissingColumns=True)
    types = {"units_dec": "decimal(28,6)", "revenue_dec": "decimal(28,4)"}
    return parts.groupBy(STORE, "product").agg(
        *[F.sum(c).cast(t).alias(c) for c, t in types.items()], F.sum("orders").alias("orders"),
        F.try_divide(F.sum("_price").cast("decimal(28,4)"), F.sum("_n_price")).cast("decimal(22,8)").alias("avg_price_dec"),
        F.try_divide(F.sum("_margin"), F.sum("n_margin")).alias("avg_margin"), F.sum("n_margin").alias("n_margin"),
        first_value("category").alias("category"))


def category_months(lines: DataFrame) -> DataFrame:
    """Revenue per (store, month, category)."""
    return shared(lines, "category_months", lambda: lines.groupBy(STORE, "year_month", "category").agg(
        F.sum("total").alias("total")))
