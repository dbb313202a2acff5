"""Steps that must not move or read the lines more often than once."""

from __future__ import annotations

import io
import json
from datetime import date, datetime

import pytest

from pyspark.sql import functions as F

from tillsight.functions.dates import parse_date, parse_hour
from tillsight.functions.numbering import dense_numbers
from tillsight.operators import basket, clean, products, summary, trends
from tillsight.operators import normalize as N
from tillsight.operators._common import enable_sharing, product_grain
from tillsight.plans import queries_insights
from tillsight.plans.report import ReportJob
from tillsight.sources import bindings as B
from tillsight.sources import landing


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def tables(spark, path, lines, orders):
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                                 "l_extendedprice double, l_discount double").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(1, "bolt", "B1", "STEEL", 10, 2.0), (2, "gear", "B2", "BRASS", 5, 3.0)],
                          "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
                          ).write.parquet(f"{path}/part.parquet")


def test_lines_are_joined_and_numbered_once(spark, tmp_path):
    d = str(tmp_path)
    orders = [(1, 4, datetime(1998, 1, 2, 9)), (2, 4, datetime(1998, 1, 1, 9)), (3, 5, datetime(1998, 1, 3, 9)), (4, None, datetime(1998, 1, 1))]
    lines = [(1, 1, 7, 1, 2.0, 10.0, 0.5), (1, 2, 7, 2, 1.0, 5.0, 0.0), (2, 2, 7, 1, 1.0, 4.0, 0.0), (3, 1, 7, 1, 1.0, 1.0, 0.0),
             (3, 1, None, 2, 1.0, 1.0, 0.0), (3, 1, 7, 3, 1.0, 1.0, 0.0), (4, 1, 7, 1, 1.0, 1.0, 0.0)]
    tables(spark, d, lines, orders)
    got = B.tpch_lines_plan(spark, d)
    assert "l_orderkey" in plan(got) and "lineitem.parquet" not in " ".join(got.inputFiles())
    rows = {(r["store_id"], r["row_seq"]): (r["order_id"], r["product"]) for r in got.collect()}
    # by date, then key; a line without a whole key is counted, and not returned
    assert rows == {("S0", 0): ("2", "gear"), ("S0", 1): ("1", "bolt"), ("S0", 2): ("1", "gear"), ("S1", 0): ("3", "bolt"),
                    ("S1", 2): ("3", "bolt"), (None, 0): ("4", "bolt")}


def test_equal_lines_have_all_their_numbers(spark, tmp_path):
    d = str(tmp_path)
    tables(spark, d, [(1, 1, 7, 1, 2.0, 10.0, 0.5)] * 2 + [(1, 1, 7, 2, 2.0, 10.0, 0.0)], [(1, 4, datetime(1998, 1, 2))])
    got = sorted((r["row_seq"], r["l_linenumber"]) for r in B.numbered_lines(spark, d).collect())
    assert got == [(0, 1), (0, 1), (1, 1), (1, 1), (2, 2)]


def test_offsets_come_from_a_written_table(spark):
    rows = spark.range(100).select((F.col("id") % 3).cast("string").alias("k"), "id")
    numbered = dense_numbers(rows, ["k"], [F.col("id")], "n")
    assert "Window" not in plan(numbered) and "Aggregate" not in plan(numbered)
    assert {(r["k"], r["id"], r["n"]) for r in numbered.collect()} == {(str(i % 3), i, i // 3) for i in range(100)}


RAW = ("store_id string, row_pos int, Fecha string, Hora string, `Código venta` string, Producto string, Cantidad string, "
       "Individual string, Total string, own_enrichment boolean, source_file string")


def test_consolidated_lines_are_read_by_all_steps(spark):
    raw = spark.createDataFrame([
        ("S0", 2, "2024-01-01", "9:00", "1", "pan", "1", "2", "2", False, "b"), ("S0", 1, "2024-01-01", "9:00", "1", "pan", "3", "2", "6", False, "a"),
        ("S0", 3, "2024-01-02", "9:00", "2", "sopa", "1", "4", "4", False, "b")], RAW)
    pm = spark.createDataFrame([("S0", "pan", "Pan", "Masa", "x", 10.0)], "store_id string, sistema string, nombre string, categoria string, "
                                                                        "subcategoria string, margen_pct double")
    text = ReportJob(spark).normalize(raw, pm)
    assert "source_file" not in plan(text)
    got = [(r["row_seq"], r["Producto"], str(r["Cantidad"]), r["Nombre Corregido"], r["Categoria Real"]) for r in text.orderBy("row_seq").collect()]
    assert got == [(2, "pan", "3.000000", "Pan", "Masa"), (3, "sopa", "1.000000", "sopa", "Otros")]
    lines = N.typed_pos(N.consolidate(raw, ("row_pos",)))
    enriched = plan(N.enrich(lines, N.prepare_product_map(pm)))
    assert "collect_list" not in enriched


def test_short_sheets_share_a_task():
    reader = landing._SheetsReader({"files": json.dumps([("a", 10), ("b", 10), ("c", landing.SHEET_BYTES_PER_TASK), ("d", 1)])})
    assert [p.files for p in reader.partitions()] == [["a", "b"], ["c"], ["d"]]
    assert [p.files for p in landing._SheetsReader({"files": "[]"}).partitions()] == [[]]


def files_of(df) -> str:
    return " ".join(df.inputFiles())


def test_lines_without_numbers_are_the_numbered_ones(spark, tmp_path):
    d = str(tmp_path)
    # a line that comes twice, an order that comes twice, a line without a whole key
    lines = [(1, 1, 7, 1, 2.0, 10.0, 0.5)] * 2 + [(1, 1, 7, 2, 2.0, 10.0, 0.0), (2, 2, 7, 1, 1.0, 4.0, 0.0), (2, 2, None, 2, 1.0, 4.0, 0.0)]
    tables(spark, d, lines, [(1, 4, datetime(1998, 1, 2)), (2, 5, datetime(1998, 1, 1)), (2, 5, datetime(1998, 1, 1))])
    plain = B.plain_lines(spark, d)
    columns = ["store_id", "l_linenumber", "l_orderkey", "l_discount"]
    assert sorted(plain.select(*columns).collect()) == sorted(B.numbered_lines(spark, d).select(*columns).collect())
    assert plain.count() == 4 + 1 + 4
    # what reads no number waits for none
    for df in (B.pos_sales_plan(spark, d), B.raw_pos_lines_plan(spark, d, numbered=False)):
        assert "lineitem.parquet" in files_of(df) and "row_seq" not in df.columns


def test_lines_and_orders_are_sorted_once_for_their_join(spark, tmp_path):
    d = str(tmp_path)
    tables(spark, d, [(1, 1, 7, 1, 2.0, 10.0, 0.5)], [(1, 4, datetime(1998, 1, 2))])
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        physical = B._joined_lines(spark, d, 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert physical.count("Exchange hashpartitioning") == 2 and physical.count("Sort [") == 2


RAW_POS = "store_id string, Fecha string, Hora string, `Código venta` string, Producto string, `Nombre Corregido` string, " \
          "`Categoria Real` string, Cantidad string, Individual string, Total string, margin_pct string"


def test_quality_parses_the_rows_once(spark):
    rows = [("S0", day, "9:00:00 AM", str(i), "a", "a", "c", q, "1", "1", m) for i, (day, q, m) in enumerate(
        [("2024-01-01", "1", "10%"), ("2024-01-03", "1", ""), ("31/31/1999", "1", "abc"), ("2024-01-02", "n/a", "5"), (None, "1", "5")])]
    raw = spark.createDataFrame(rows + [("S1", "bad", "xx", None, None, None, "c", "x", "x", "x", None)], RAW_POS)
    lines, _, quality = clean.sanitize(raw)
    got = summary.quality_of(clean.coerce(raw))
    assert "regexp" not in plan(got).lower() and "quality-days" in files_of(got)
    assert sorted(got.collect()) == sorted(summary.quality_coverage(lines, quality).select(*got.columns).collect())
    assert {r["store_id"]: (r["initial_rows"], r["valid_rows"], r["observed_days"], r["invalid_dates"]) for r in got.collect()} == {
        "S0": (5, 2, 2, 2), "S1": (1, 0, None, 1)}


def test_the_months_of_trends_are_written(make_lines):
    lines = make_lines([("S0", i, f"2024-0{1 + i % 2}-01", 9, "a", "c", 1, 10 + i) for i in range(8)])
    got = trends.product_trends(lines)
    assert "trend_months" in files_of(got)


def test_products_are_summed_without_sorting_the_lines(make_lines):
    # (store, order, date, hour, product, category, qty, total, margin, unit price, row)
    lines = make_lines([("S0", 1, "2024-01-01", 9, "a", "y", 1, 10, 20, 10, 5), ("S0", 1, "2024-01-01", 9, "a", "x", 2, 21, None, 10.5, 3),
                        ("S0", 2, "2024-01-01", 9, "a", "y", 1, 10, 40, 10, 9), ("S0", 2, "2024-01-01", 9, None, "z", 1, 1, None, 1, 1)])
    grain = product_grain(lines)
    assert "count(distinct" not in plan(grain)
    rows = {r["product"]: r for r in grain.collect()}
    a = rows["a"]
    assert (str(a["units_dec"]), str(a["revenue_dec"]), a["orders"], str(a["avg_price_dec"]), a["avg_margin"], a["n_margin"], a["category"]) == (
        "4.000000", "41.0000", 2, "10.16666667", 30.0, 2, "x")
    assert (rows[None]["orders"], rows[None]["avg_margin"], rows[None]["category"]) == (1, None, "z")
    none = product_grain(lines.withColumn("row_seq", F.lit(None).cast("bigint"))).where("product = 'a'").first()
    assert none["category"] == "x"  # without a source order the least
    assert [r["avg_price"] for r in products.products_pareto(lines).where("product = 'a'").collect()] == [10.17]


def test_orders_and_baskets_come_from_one_table_in_a_run(make_lines):
    lines = make_lines([("S0", 1, "2024-01-01", 9, "b", "x", 1, 10), ("S0", 1, "2024-01-01", 9, "a", "x", 2, 21), ("S0", 1, "2024-01-01", 9, "a", "y", 1, 1),
                        ("S0", 2, "2024-01-01", 9, "a", "x", 1, 1)]).select("*")
    totals = summary.order_totals(lines)
    assert "Expand" not in plan(totals)
    assert sorted((r["order_id"], r["n_lines"], r["unique_products"], r["categories"]) for r in totals.collect()) == [("1", 3, 2, 2), ("2", 1, 1, 1)]
    enable_sharing(lines, f"run-{id(lines)}")
    assert [r["basket"] for r in basket.baskets(lines).collect()] == [["a", "b"]]
    assert files_of(basket.baskets(lines)) == files_of(summary.order_totals(lines))


def test_report_queries_share_their_lines_and_read_quality_when_needed(spark, tmp_path):
    d = str(tmp_path)
    tables(spark, d, [(1, 1, 7, 1, 2.0, 10.0, 0.5), (1, 2, 7, 2, 2.0, 10.0, 0.0)], [(1, 4, datetime(1998, 1, 2))])
    x = queries_insights._inputs(spark, d)
    assert callable(x.quality) and not hasattr(B.tpch_lines(spark, d), "_tillsight_run")
    assert files_of(summary.order_totals(x.lines)) == files_of(basket.baskets(x.lines))
    assert x.quality_table.first()["initial_rows"] == 2


def test_plain_dates_are_cast(spark):
    texts = {"2024-02-29": date(2024, 2, 29), "2023-02-29": None, "2024-1-5": date(2024, 1, 5), " 2024-01-05 ": date(2024, 1, 5),
             "2024/01/05": date(2024, 1, 5), "2024-13-01": None, "0001-01-01": date(1, 1, 1), "2024-01-05T10:00:00": date(2024, 1, 5), "": None}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_date("t").alias("d"))
    assert {r["t"]: r["d"] for r in got.collect()} == texts
    assert "try_cast(" in plan(got)


def test_lines_are_sorted_by_the_number_of_their_source(spark):
    rows = [("S0", i, "2024-01-01", "9:00:00 AM", str(i), "pan", "1", "2", "2") for i in range(3)] + [
        ("S0", 0, "2024-01-01", "9:00:00 AM", "7", "sopa", "1", "2", "2")]
    raw = spark.createDataFrame(rows, "store_id string, row_pos bigint, Fecha string, Hora string, `Código venta` string, Producto string, "
                                      "Cantidad string, Individual string, Total string")
    path = F.when(F.col("Producto") == "pan", "file:/b.csv").otherwise("file:/a.csv")
    raw = raw.withColumn("source_rank", F.struct(F.lit(1).alias("rank"), path.alias("path"))).union(
        raw.where("row_pos = 1").withColumn("source_rank", F.struct(F.lit(2).alias("rank"), F.lit("file:/0.csv").alias("path"))))
    text = ReportJob(spark).normalize(raw)
    got = [(r["row_seq"], r["Código venta"]) for r in text.orderBy("row_seq").collect()]
    assert got == [(2, "7"), (3, "0"), (4, "1"), (5, "2")]
    ordered = [x for x in text.inputFiles() if "numbered" in x and spark.read.parquet(x).columns != ["_all"]]
    places = [spark.read.parquet(x).schema["row_pos"].dataType.simpleString() for x in ordered]
    assert places and set(places) == {"struct<_source:bigint,row_pos:bigint>"}


def test_typed_columns_stay_and_dates_are_parsed_once(spark):
    rows = spark.createDataFrame([("S0", "2024-01-01", 9, "1", "pan", "2.5"), ("S0", "2024-01-01", None, "1", "pan", "2.5"), ("S0", "31/31/1999", 9, "1", "pan", "1")],
                                 "store_id string, Fecha string, Hour int, `Código venta` string, `Nombre Corregido` string, q string")
    rows = rows.select("*", F.lit("c").alias("Categoria Real"), F.col("q").cast("decimal(18,6)").alias("Cantidad"),
                       *[F.col("q").cast("decimal(18,4)").alias(c) for c in ("Individual", "Total")]).drop("q")
    lines, discarded, _ = clean.sanitize(rows)
    shown = plan(lines)
    assert shown.count("^\\d{4}-\\d{2}-\\d{2}$") == 1 and "as decimal" not in shown.split("LogicalRDD")[0].split("Project [store_id")[1]
    assert [(str(r["quantity"]), str(r["total"]), r["sale_hour"], r["sale_date"]) for r in lines.collect()] == [("2.500000", "2.5000", 9, date(2024, 1, 1))]
    assert sorted(r["motivo_descarte"] for r in discarded.collect()) == sorted(
        r["motivo_descarte"] for r in clean.coerce(rows.withColumns({c: F.col(c).cast("string") for c in ("Cantidad", "Total", "Hour")})).collect()
        if r["motivo_descarte"])


def test_export_times_are_read_by_their_digits(spark):
    texts = {"9:05:07 AM": 9, "09:05:07 PM": 21, "12:00:00 AM": 0, "12:59:59 PM": 12, " 1:00:00 PM ": 13, "13:00:00 PM": None, "0:00:00 AM": None,
             "9:60:00 AM": None, "9:05 PM": 21, "17:30:00": 17, "17:30": 17, "xx": None, "": 0, None: 0, "9:05:07 am": 9, "9:05:07AM": None}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_hour("t").alias("h"))
    assert {r["t"]: r["h"] for r in got.collect()} == texts
    assert "substring_index" in plan(got)


def sheet(rows: str) -> bytes:
    ns = "urn:schemas-microsoft-com:office:spreadsheet"
    return (f'<?xml version="1.0"?><Workbook xmlns="{ns}" xmlns:ss="{ns}"><Worksheet><Table>{rows}</Table></Worksheet>'
            "<Worksheet><Table><Row><Cell><Data>other</Data></Cell></Row></Table></Worksheet></Workbook>").encode()


def test_sheet_rows_are_handed_on_in_batches(tmp_path):
    rows = '<Row><Cell ss:Index="2"><Data>a &amp; b</Data></Cell><Cell><Data/></Cell><Cell><Data>1<B>2</B>3</Data></Cell></Row><Row/>'
    assert list(landing.sheet_rows(io.BytesIO(sheet(rows)))) == [[None, "a & b", None, "1"], []]
    whole, broken = tmp_path / "a.xls", tmp_path / "b.xls"
    whole.write_bytes(sheet("<Row><Cell><Data>x</Data></Cell></Row>" * (landing.SHEET_BATCH + 1)))
    broken.write_bytes(sheet("<Row><Cell><Data>x</Data></Cell></Row>" * 2)[:-220])
    reader = landing._SheetsReader({"files": "[]"})
    batches = list(reader.read(landing.Files([str(whole)])))
    assert [b.num_rows for b in batches] == [landing.SHEET_BATCH, 1]
    assert batches[1].to_pylist() == [{"path": str(whole), "row_no": landing.SHEET_BATCH + 1, "cells": ["x"], "error": None}]
    # the rows before the break, and the error after them
    got = [r for b in reader.read(landing.Files([str(broken)])) for r in b.to_pylist()]
    assert got[-1]["cells"] is None and got[-1]["error"].startswith("ParseError") and [r["row_no"] for r in got] == list(range(1, len(got) + 1))
    with pytest.raises(landing.SourceError):
        list(landing.sheet_rows(io.BytesIO(b"<?xml version='1.0'?><Workbook></Workbook>")))
