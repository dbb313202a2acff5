"""The report job end to end, for many stores in one Spark application.

    exports → consolidate → own enrichment, product map or fallback → category margins →
    normalized text → sanitize → sales_lines (written once) → report modules →
    insights / recommendations → sinks

``run_exports`` starts from raw export text, ``run`` from normalized text.

Every step is a lazy DataFrame; the only materializations are the written
``sales_lines`` table (lineage cut, shared by all modules) and the small per-store
module outputs.  Nothing is collected on the driver.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tillsight.config import DEFAULT_REPORT, ReportConfig
from tillsight.operators import (
    basket, bundles, cart, clean, insights, products, profitability, summary, ticket, timeline, trends,
)
from tillsight.operators import normalize as N
from tillsight.operators._common import enable_sharing
from tillsight.session import scratch_table_path
from tillsight.sources import sinks
from tillsight.sources.bindings import materialized, written


@dataclass
class ReportJob:
    spark: SparkSession
    cfg: ReportConfig = DEFAULT_REPORT
    run_id: str = field(default_factory=lambda: f"report-{uuid.uuid4().hex}")
    concurrent_jobs: int = 4

    def normalize(self, raw_exports: DataFrame, product_map: DataFrame | None = None,
                  category_margins: DataFrame | None = None) -> DataFrame:
        """Raw exports → normalized export text, the input of :meth:`run`.

        A store's own categories win over its product map, the map over the fallback ``Otros``; a line without a
        margin takes its category's estimate where one is given.  Rows that say where they stood (``row_pos``)
        are numbered in the order of the consolidated export.
        """
        order = ("row_pos",) if "source_rank" not in raw_exports.columns else ("source_rank", "row_pos")
        located = [c for c in N.INTERNAL if c in raw_exports.columns and c not in (*order, "row_seq")]
        # three steps of the enrichment read the lines: they are consolidated once
        typed = written(N.typed_pos(N.consolidate(raw_exports.drop(*located), order)), "typed")
        if "source_rank" in typed.columns:
            typed = N.numbered_sources(typed)
        rich = N.enrich_by_store(typed, product_map)
        if category_margins is not None:
            filled = N.category_margin_fallback(rich.withColumnRenamed("category_raw", "category"), category_margins)
            rich = filled.withColumnRenamed("category", "category_raw").drop("margin_source")
        rich = rich.drop("match_kind")  # no part of the export, and lines are moved to be numbered
        return N.normalized_export(N.in_row_order(rich) if "row_pos" in rich.columns else rich)

    def run_exports(self, raw_exports: DataFrame, product_map: DataFrame | None = None,
                    category_margins: DataFrame | None = None, out_dir: str | None = None) -> dict[str, DataFrame]:
        """The whole way from raw export text (columns of the readers in ``sources.files`` and ``sources.landing``).

        The normalized export is written first (``normalized``, S12), so that files and joins are read once.
        """
        out = out_dir or scratch_table_path(self.spark, f"{self.run_id}/out")
        text = self.normalize(raw_exports, product_map, category_margins)
        sinks.write_normalized(text, f"{out}/normalized")
        return self.run(self.spark.read.schema(text.schema).parquet(f"{out}/normalized"), out)

    def lines(self, normalized_text: DataFrame):
        """Sanitize and write ``sales_lines`` once; returns (lines, discarded, quality)."""
        lines, discarded, quality = clean.sanitize(normalized_text, self.cfg)
        lines = materialized(self.spark, f"{self.run_id}|sales_lines", lambda: lines)
        return lines, discarded, quality

    def modules(self, lines: DataFrame, quality: DataFrame) -> dict[str, DataFrame]:
        c = self.cfg
        return {
            "summary": summary.summary(lines, c),
            "quality": summary.quality_coverage(lines, quality),
            "timeline_daily": timeline.daily(lines, c),
            "timeline_weekly": timeline.weekly(lines, c),
            "timeline_dow": timeline.dow(lines, c),
            "timeline_heatmap": timeline.heatmap(lines, c),
            "timeline_hourly": timeline.hourly(lines, c),
            "timeline_monthly_cat": timeline.monthly_category(lines, c),
            "timeline_peaks": timeline.peak_moments(lines, c),
            "products": products.products_pareto(lines, c),
            "category_totals": products.category_totals(lines, c),
            "basket_pairs": basket.pairs_with_bands(lines, c),
            "basket_cat_pairs": basket.category_pairs(lines, c),
            "basket_high_lift": basket.high_lift_pairs(lines, c),
            "basket_rules": basket.rules(lines, c),
            "cart_dist": cart.cart_distribution(lines, c),
            "ticket_stats": cart.ticket_stats(lines, c),
            "ticket_dist": cart.ticket_buckets(lines, c),
            "cart_weekly": cart.cart_weekly(lines, c),
            "segment_stats": cart.cart_segments(lines, c),
            "multi_bucket_stats": cart.multi_buckets(lines, c),
            "single_top_ticket": cart.single_unit_products(lines, c),
            "trends": trends.product_trends(lines, c),
            "trend_status": trends.trend_status(lines, c),
            "margin_status": profitability.margin_status(lines, c),
            "anomalies": trends.anomaly_days(lines, c),
            "day_ticket": ticket.day_ticket(lines, c),
            "hour_ticket": ticket.hour_ticket(lines, c),
            "opportunity_hours": ticket.opportunity_hours(lines, c),
            "profitability": profitability.profitability(lines, c),
            "margin_by_category": profitability.margin_by_category(lines, c),
            "margin_weighted_pairs": profitability.margin_weighted_pairs(lines, c),
            "category_top_profit": profitability.category_top_profit(lines, c),
            "bundles": bundles.rankings(lines, c),
            "bundle_launch_ready": bundles.launch_ready(lines, c),
            "bundle_tests": bundles.test_candidates(lines, c),
        }

    # written module → the ReportInputs entry it can stand in for
    _INPUT_SEEDS = {"summary": "summary", "products": "products", "ticket_stats": "ticket_stats",
                    "profit": "profitability", "margin_cat": "margin_by_category", "peaks": "timeline_peaks",
                    "trends": "trends", "anomalies": "anomalies", "cat_totals": "category_totals",
                    "opportunity": "opportunity_hours", "high_lift": "basket_high_lift", "pairs": "basket_pairs",
                    "rules": "basket_rules", "launch_ready": "bundle_launch_ready", "day_ticket": "day_ticket"}

    def _write_all(self, outputs: dict[str, DataFrame], out: str) -> None:
        # Module outputs are small independent jobs: submit a few at a time so the
        # scheduler overlaps them instead of leaving cores idle between stages.
        with ThreadPoolExecutor(max_workers=max(1, self.concurrent_jobs)) as pool:
            for f in [pool.submit(sinks.write_module, df, f"{out}/{name}") for name, df in outputs.items()]:
                f.result()

    def run_some(self, lines: DataFrame, quality: DataFrame, names: list[str], out: str) -> dict[str, DataFrame]:
        """Compute and write the named modules of sanitized lines; returns the written outputs."""
        enable_sharing(lines, self.run_id)
        mods = {n: df for n, df in self.modules(lines, quality).items() if n in names}
        self._write_all(mods, out)
        return {n: self.spark.read.schema(df.schema).parquet(f"{out}/{n}") for n, df in mods.items()}

    def run(self, normalized_text: DataFrame, out_dir: str | None = None) -> dict[str, DataFrame]:
        """Compute and write every module (Parquet per store), then insights and
        recommendations from the written modules; returns the written outputs."""
        out = out_dir or scratch_table_path(self.spark, f"{self.run_id}/out")
        lines, discarded, quality = self.lines(normalized_text)
        enable_sharing(lines, self.run_id)
        mods = self.modules(lines, quality)
        self._write_all(mods, out)
        sinks.write_discarded(discarded, f"{out}/discarded")
        # explicit schemas: an empty module writes no data files
        written = {name: self.spark.read.schema(df.schema).parquet(f"{out}/{name}") for name, df in mods.items()}
        x = insights.ReportInputs(lines, self.cfg, written["quality"], run_key=self.run_id)
        for entry, name in self._INPUT_SEEDS.items():
            x._cache[entry] = written[name]
        final = {"insights": insights.insights(x), "recommendations": insights.recommendations(x)}
        self._write_all(final, out)
        written.update({n: self.spark.read.schema(df.schema).parquet(f"{out}/{n}") for n, df in final.items()})
        return written
