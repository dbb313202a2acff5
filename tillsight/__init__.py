"""tillsight — point-of-sale line analytics as lazy Spark DataFrame operators.

Every operator is a function ``fn(lines: DataFrame, cfg: ReportConfig) -> DataFrame``
over the canonical ``sales_lines`` table (see :mod:`tillsight.schema`).  ``store_id``
is the leading key of every grouping and window, so one job serves many stores.
"""

from tillsight.config import ReportConfig, DeltaConfig  # noqa: F401

__version__ = "0.1.0"
