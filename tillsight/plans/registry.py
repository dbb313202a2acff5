"""Registry of named queries: ``name -> (fn(spark, sf_dir) -> DataFrame, oracle SQL | None)``.

Each query reads the driver's tables through a binding (``tillsight.sources.bindings``)
and applies one operator family.  Parameters that differ from the report defaults are
set here, once, because the synthetic tables have different scales than a bakery
(see SURVEY §7.3): they are part of the query definition, shared by both engines.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from tillsight.config import ReportConfig
from tillsight.plans import oracle_sql as O
from tillsight.sources import bindings as B

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def with_ctes(*ctes: str, body: str) -> str:
    """Join CTE fragments; ``body`` may start with more ``name AS (...)`` items."""
    head = ",\n".join(ctes)
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return f"WITH {head}\n{body}"
    return f"WITH {head},\n{body}"


# Binding-A parameters.
CFG_A = ReportConfig()
# Rules and bundles run on brands: random data has lift ≈ 1 and confidence ≈ 1/25.
CFG_RULES = ReportConfig(rule_min_count=15, rule_min_confidence=0.10, high_lift_threshold=1.0,
                         launch_min_confidence=0.12)
# Order totals of binding A are in the 10k–1M range.
TEST_BINS = (0, 70000, 120000, 190000, 275000, 360000, 1000000)
TEST_LABELS = ("0-70K", "70-120K", "120-190K", "190-275K", "275-360K", "360K-1M")
CFG_TICKETS = ReportConfig(ticket_bins=TEST_BINS, ticket_labels=TEST_LABELS)


def _load_all() -> None:
    # importing the query modules fills REGISTRY
    from tillsight.plans import (  # noqa: F401
        queries_delta, queries_ingest, queries_insights, queries_jobs, queries_normalize, queries_report, queries_slice,
    )


def queries() -> dict[str, QueryFn]:
    _load_all()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracles() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
