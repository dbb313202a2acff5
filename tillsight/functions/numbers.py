"""Numeric expressions: margin text parsing, rounding, truncation, percent change."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str, scale: int = 4) -> Column:
    """Text or number → DECIMAL(18, scale); bad value → null (ANSI-safe)."""
    return _c(c).try_cast(f"decimal(18,{scale})")


def parse_margin(c: Column | str) -> Column:
    """``"57.89%"``, ``"57,89%"``, ``"57.89"`` → 57.89; ``""``/``nan``/``None`` → null."""
    txt = F.trim(F.replace(F.replace(_c(c).cast("string"), F.lit("%"), F.lit("")), F.lit(","), F.lit(".")))
    blank = txt.isNull() | (txt == "") | F.lower(txt).isin("nan", "none")
    return F.when(blank, F.lit(None).cast("double")).otherwise(txt.try_cast("double"))


def margin_is_missing(c: Column | str) -> Column:
    txt = F.trim(F.replace(F.replace(_c(c).cast("string"), F.lit("%"), F.lit("")), F.lit(","), F.lit(".")))
    return txt.isNull() | (txt == "") | F.lower(txt).isin("nan", "none")


def dbl(c: Column | str) -> Column:
    return _c(c).cast("double")


def rnd(c: Column | str, k: int) -> Column:
    """Half-up rounding of the value as a double (decimal inputs are cast first)."""
    return F.round(_c(c).cast("double"), k)


def trunc_int(c: Column | str) -> Column:
    """Python ``int(x)``: truncation toward zero."""
    return _c(c).cast("double").cast("bigint")


def pct_change(prev: Column | str, cur: Column | str) -> Column:
    """Percent change with the event-impact zero-base rule: prev 0 → null if cur > 0 else 0."""
    prev, cur = dbl(prev), dbl(cur)
    return (
        F.when(prev == 0, F.when(cur > 0, F.lit(None).cast("double")).otherwise(F.lit(0.0)))
        .otherwise((cur - prev) / prev * 100.0)
    )
