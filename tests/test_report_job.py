"""End-to-end report job on the smallest test tables: every module is written and the
insights are derived from the written modules."""

from __future__ import annotations

import tempfile

from tillsight.plans.report import ReportJob
from tillsight.sources import bindings as B


def test_report_job_writes_every_module(spark):
    out = tempfile.mkdtemp(prefix="tillsight-report-", dir="/tmp")
    raw = B.raw_pos_lines(spark, "/root/testdata/sf0.001")
    written = ReportJob(spark, run_id="test-report", concurrent_jobs=2).run(raw, out_dir=out)
    assert {"summary", "products", "basket_rules", "bundles", "insights", "recommendations"} <= set(written)
    stores = {r["store_id"] for r in written["summary"].collect()}
    assert stores == {"S0", "S1", "S2", "S3"}
    ins = written["insights"].collect()
    assert ins and all(r["title"] and r["action"] for r in ins)
    assert written["recommendations"].groupBy("store_id").count().agg({"count": "max"}).collect()[0][0] <= 3


def test_a_second_report_sees_its_own_lines(spark):
    cols = "store_id string, row_seq bigint, Fecha string, `Código venta` string, `Nombre Corregido` string, `Categoria Real` string, " \
           "Cantidad string, Individual string, Total string, Hour string"
    for quantity in ("1", "99"):
        raw = spark.createDataFrame([("S", 1, "2026-01-05", "1", "a", "c", quantity, "10", "10", "9")], cols)
        lines, _, _ = ReportJob(spark).lines(raw)
        assert [str(int(r["quantity"])) for r in lines.collect()] == [quantity]


def test_sharing_follows_the_marked_frame_only(spark):
    from tillsight.operators._common import enable_sharing, shared

    one, two = spark.range(1), spark.range(2)
    enable_sharing(one, "test-sharing")
    assert shared(one, "n", lambda: one).count() == 1
    assert shared(two, "n", lambda: two).count() == 2


def test_modules_from_shared_grains_equal_those_from_lines(spark):
    from tillsight.operators._common import enable_sharing
    from tillsight.operators.clean import sanitize
    from tillsight.operators.summary import quality_coverage

    lines, _, quality = sanitize(B.raw_pos_lines(spark, "/root/testdata/sf0.001"))
    lines = B.written(lines, "plain-lines")
    job = ReportJob(spark, run_id="test-grains")
    plain = job.modules(lines, quality)
    shared_lines = spark.read.schema(lines.schema).parquet(*lines.inputFiles())
    enable_sharing(shared_lines, job.run_id)
    fast = job.modules(shared_lines, quality)
    names = ("summary", "timeline_daily", "timeline_weekly", "timeline_dow", "timeline_heatmap", "timeline_hourly",
             "timeline_monthly_cat", "timeline_peaks", "products", "category_totals", "cart_weekly", "anomalies", "day_ticket",
             "hour_ticket", "opportunity_hours", "profitability", "bundles", "margin_status", "trend_status")
    for n in names:
        assert sorted(map(tuple, fast[n].collect()), key=str) == sorted(map(tuple, plain[n].collect()), key=str), n
    assert quality_coverage(shared_lines, quality).count() == 4
