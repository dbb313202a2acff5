from __future__ import annotations

import os
import sys
from datetime import date
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillsight.schema import conform  # noqa: E402
from tillsight.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, app="tillsight-tests")
    yield s


@pytest.fixture()
def make_lines(spark):
    """Build canonical sales_lines from tuples:
    (store, order, date 'YYYY-MM-DD', hour, product, category, qty, total[, margin[, unit_price[, row_seq]]])."""

    def _make(rows):
        out = []
        for i, r in enumerate(rows):
            r = list(r) + [None] * (11 - len(r))
            st, oid, d, h, p, c, q, t, m, up, seq = r
            out.append((st, seq if seq is not None else i, date.fromisoformat(d), h, str(oid), p, c,
                        Decimal(str(q)), Decimal(str(t)), None if m is None else float(m),
                        Decimal(str(up if up is not None else t))))
        df = spark.createDataFrame(out, "store_id string, row_seq bigint, sale_date date, sale_hour int, order_id string, "
                                        "product string, category string, quantity decimal(18,6), total decimal(18,4), "
                                        "margin_pct double, unit_price decimal(18,4)")
        return conform(df)

    return _make
