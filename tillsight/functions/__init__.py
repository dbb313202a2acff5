"""Column-expression helpers (all built-in Spark functions, no Python UDFs)."""

from tillsight.functions.dates import (  # noqa: F401
    iso_year_week, year_month, weekday_es, weekday_ix, month_abbr, days_in_month, parse_hour,
)
from tillsight.functions.numbers import (  # noqa: F401
    parse_margin, dbl, rnd, trunc_int, pct_change, money,
)
from tillsight.functions.text import canonical_header, strip_accents, blank_to_null  # noqa: F401
