"""Cleaning, normalization and event-impact fixtures (FIXTURES.md §4)."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest

from tillsight.config import DeltaConfig, ReportConfig
from tillsight.operators import clean, delta, normalize as N

RAW_COLS = ("store_id string, row_seq bigint, Fecha string, Hora string, `Código venta` string, Producto string, "
            "`Nombre Corregido` string, `Categoria Real` string, Cantidad string, Individual string, Total string, margin_pct string")


def test_coercion_reasons_in_fixed_order(spark):
    raw = spark.createDataFrame([
        ("S", 1, "2026-01-05", "9:00:00 AM", "1", "a", "a", "c", "1", "10", "10", "57,89%"),
        ("S", 2, "not a date", "9:00:00 AM", "2", "a", "", "c", "abc", "10", "10", "abc"),
        ("S", 3, "2026-01-05", None, "3", "a", "a", "c", "1", "10", "", ""),
        ("S", 4, "2026-01-05", "00:00", "4", "a", "a", "c", "1", "x", "10", "57.89"),
    ], RAW_COLS)
    typed = clean.coerce(raw)
    got = {r["row_seq"]: (r["motivo_descarte"], r["margin_pct"], r["margin_state"]) for r in typed.collect()}
    assert got[1] == ("", 57.89, "present")
    assert got[2] == ("Fecha inválida; Producto faltante; Cantidad inválida", None, "invalid")
    assert got[3] == ("Total inválido", None, "missing")  # missing time -> hour 0, not a discard
    assert got[4] == ("", 57.89, "present")  # 24-hour time accepted; a bad unit price is not a discard
    lines, discarded, quality = clean.sanitize(raw, ReportConfig())
    q = quality.collect()[0]
    assert (q["initial_rows"], q["valid_rows"], q["dropped_pct"], q["invalid_unit_price"]) == (4, 2, 50.0, 1)
    assert lines.count() == 2 and discarded.count() == 2


def test_missing_required_column_raises(spark):
    raw = spark.createDataFrame([("1", "2")], "X string, Y string")
    with pytest.raises(clean.SchemaError, match="faltan columnas"):
        clean.coerce(raw)


def test_column_mapping_synthesises_time_and_price(spark):
    df = spark.createDataFrame([("2026-01-05", "F1", "pan", "2", "3000"), ("2026-01-05", "F2", "cafe", "0", "500")],
                               "FECHA string, `No. Factura` string, `Descripción` string, `Cant.` string, `Valor Total` string")
    m = {"date": "FECHA", "order_id": "No. Factura", "product": "Descripción", "quantity": "Cant.", "total": "Valor Total"}
    out = {r["Producto"]: (r["Hora"], r["Individual"]) for r in N.apply_column_mapping(df, m).collect()}
    assert out == {"pan": ("00:00", "1500.0"), "cafe": ("00:00", "500.0")}
    with pytest.raises(N.MapError, match="faltan columnas"):
        N.apply_column_mapping(spark.createDataFrame([("1", "2")], "X string, Y string"), {"date": "X"})


def _sales(spark, rows):
    return spark.createDataFrame(
        [("S", date.fromisoformat(d), str(i), p, Decimal(str(q)), Decimal(str(price)), Decimal(str(q * price)))
         for i, (d, p, q, price) in enumerate(rows)],
        "store_id string, sale_date date, order_id string, product_raw string, quantity decimal(18,6), "
        "unit_price decimal(18,4), total decimal(18,4)")


def _map(spark, rows):
    return N.prepare_product_map(spark.createDataFrame(
        [("S",) + r + (i,) for i, r in enumerate(rows)],
        "store_id string, sistema string, precio_post string, fecha_desde string, nombre string, categoria string, "
        "subcategoria string, margen_pct string, map_seq bigint"))


def test_map_asof_priority(spark):
    pm = _map(spark, [("x", None, None, "X base", "c", "s", "10"),
                      ("x", None, "2026-02-01", "X new", "c", "s", "20"),
                      ("x", "7", None, "X seven", "c", "s", "30")])
    sales = _sales(spark, [("2026-01-15", "x", 1, 5), ("2026-02-15", "x", 1, 5), ("2026-02-15", "x", 1, 7),
                           ("2026-01-15", "y", 1, 5)])
    out = sorted((r["sale_date"].isoformat(), float(r["unit_price"]), r["product"], r["match_kind"])
                 for r in N.enrich(sales, pm).collect())
    assert out == [("2026-01-15", 5.0, "X base", "agnostic"), ("2026-01-15", 5.0, "y", "unmatched"),
                   ("2026-02-15", 5.0, "X new", "agnostic"), ("2026-02-15", 7.0, "X seven", "price")]


def test_map_split_mass_preserved(spark):
    pm = _map(spark, [("p", "10", "2026-02-01", "P small", "c", "s", "40"),
                      ("p", "20", "2026-02-01", "P big", "c", "s", "45"),
                      ("p", "20", "2026-03-01", "P big", "c", "s", "45")])  # same price twice (X5)
    sales = _sales(spark, [("2026-02-10", "p", 3, 10), ("2026-02-10", "p", 1, 20), ("2026-02-11", "p", 1, 15),
                           ("2026-01-10", "p", 4, 12)])
    e = N.enrich(sales, pm)
    kinds = sorted(r["match_kind"] for r in e.collect())
    assert kinds == ["split_fanout", "split_fanout", "split_price", "split_price", "split_unmatched"]
    ratios = {float(r["precio_post"]): r["ratio"] for r in N.split_ratios(sales, pm).collect()}
    assert ratios == {10.0: 0.75, 20.0: 0.25}
    fan = [r for r in e.collect() if r["match_kind"] == "split_fanout"]
    assert abs(sum(float(r["quantity"]) for r in fan) - 4.0) < 1e-6
    un = [r for r in e.collect() if r["match_kind"] == "split_unmatched"][0]
    assert un["product"] == "p (precio 15.0)"


def test_dedup_overlap_keeps_first(spark):
    raw = spark.createDataFrame([
        ("S", 1, 1, "2026-01-05", "9:00:00 AM", "A1", "pan", "1", "10", "10"),
        ("S", 1, 2, "2026-01-05", "9:00:00 AM", "A1", "pan", "1", "10", "10"),  # identical line in one order
        ("S", 2, 1, "2026-01-05", "9:00:00 AM", "A1", "pan", "3", "10", "30"),  # overlap from the second export
        ("S", 2, 2, "2026-01-06", "9:00:00 AM", "A2", "pan", "1", "10", "10"),
    ], "store_id string, source_rank int, row_pos int, Fecha string, Hora string, `Código venta` string, "
       "Producto string, Cantidad string, Individual string, Total string")
    out = sorted((r["Fecha"], r["Cantidad"], r["source_rank"]) for r in N.consolidate(raw).collect())
    assert out == [("2026-01-05", "1", 1), ("2026-01-06", "1", 2)]


def _dlines(make_lines, rows):
    return make_lines(rows)


def test_delta_zero_base(make_lines):
    cfg = DeltaConfig(event_date="2026-01-10", window_days=7)
    df = make_lines([("S", 1, "2026-01-12", 9, "a", "c", 1, 100, 50)])
    k = delta.kpis(df, cfg).collect()[0]
    assert k["pre_revenue"] == 0.0 and k["delta_revenue_pct"] is None
    w = delta.coverage_and_warnings(df, cfg).collect()[0]
    assert any("No hay base" in m for m in w["warnings"]) and w["direction"] == "sin base comparable"
    p = delta.product_impact(df, cfg).collect()[0]
    assert p["status"] == "new"


def test_delta_margin_gap(make_lines):
    cfg = DeltaConfig(event_date="2026-01-10", window_days=7)
    df = make_lines([("S", 1, "2026-01-05", 9, "a", "c", 1, 100, 50), ("S", 2, "2026-01-05", 9, "b", "c", 1, 300, None),
                     ("S", 3, "2026-01-12", 9, "a", "c", 1, 100, 50)])
    w = delta.coverage_and_warnings(df, cfg).collect()[0]
    assert w["margin_coverage_pre"] == 0.25
    assert any("margen es parcial" in m for m in w["warnings"])


def test_default_event_date_clamps(make_lines):
    df = make_lines([("S", 1, "2026-01-01", 9, "a", "c", 1, 1), ("S", 2, "2026-03-31", 9, "a", "c", 1, 1)])
    dl = delta.delta_lines(df, DeltaConfig(as_of="2030-01-01"))
    ev = delta.event_dates(dl, DeltaConfig(as_of="2030-01-01")).collect()[0]["event_date"]
    assert ev.isoformat() == "2026-03-02"  # max - 29 days
    with pytest.raises(ValueError):
        delta.event_dates(dl, DeltaConfig())


def test_normalized_export_layout(spark):
    pm = _map(spark, [("x", None, None, "X", "c", "s", "10")])
    sales = _sales(spark, [("2026-01-05", "x", 1, 5)]).withColumn("sale_hour", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(14))
    out = N.normalized_export(N.enrich(sales, pm))
    assert out.columns[:14] == list(N.OUTPUT_ORDER)
    r = out.collect()[0]
    assert (r["Fecha"], r["Month"], r["Week Day"], r["Hour"], r["Nombre Corregido"]) == ("2026-01-05", "Jan", "Lun", 14, "X")


def test_canonicalize_columns(spark):
    df = spark.createDataFrame([("1",) * 6], "`﻿Fecha` string, `Código  Venta` string, `CANTIDAD` string, "
                                             "`Total` string, `Nombre Corregido` string, `Categoría Real` string")
    out = clean.canonicalize_columns(df)
    assert out.columns == ["Fecha", "Codigo venta", "Cantidad", "Total", "Nombre Corregido", "Categoria Real"]
    with pytest.raises(clean.SchemaError, match="Cantidad"):
        clean.canonicalize_columns(spark.createDataFrame([("1",)], "Fecha string"))


def test_delta_selection_helpers(make_lines):
    from tillsight.config import ProductGroup
    cfg = DeltaConfig(event_date="2026-01-10", window_days=7,
                      product_groups=(ProductGroup("g", ("a", "zz")),))
    df = make_lines([("S", 1, "2026-01-05", 9, "a", "c", 1, 100), ("S", 2, "2026-01-12", 9, "b", "c", 1, 300),
                     ("S", 3, "2026-01-12", 9, "c", "c", 1, 50)])
    top = sorted(r["product"] for r in delta.top_selection(df, cfg, 2).collect())
    assert top == ["a", "b"]
    k = delta.kpis(df, cfg, delta.scoped(df, cfg, selection=delta.group_selection(df, cfg, "g"))).collect()[0]
    # only "a" is in the catalog: pre revenue 100, nothing after the event
    assert (k["n_selected"], k["pre_revenue"], k["post_revenue"], k["whole"]) == (1, 100.0, 0.0, False)


def test_date_texts(spark):
    from tillsight.functions.dates import parse_date

    texts = ["2026-03-05T10:30:00", "2026-03-05 10:30", "2026-3-5", "12/31/2026", "31/12/2026", "5/3/2026 10:00", "03/04/2026",
             "2026/03/05", "2026-02-30", "31/31/1999", "xx", "", None, "2026-03-05 nonsense"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", parse_date("t").cast("string").alias("d"), parse_date("t", day_first=True).cast("string").alias("e"))
    got = {texts[r["i"]]: (r["d"], r["e"]) for r in rows.collect()}
    same = lambda d: (d, d)
    assert got == {
        "2026-03-05T10:30:00": same("2026-03-05"), "2026-03-05 10:30": same("2026-03-05"), "2026-3-5": same("2026-03-05"),
        "12/31/2026": same("2026-12-31"), "31/12/2026": same("2026-12-31"), "5/3/2026 10:00": ("2026-05-03", "2026-03-05"),
        "03/04/2026": ("2026-03-04", "2026-04-03"), "2026/03/05": same("2026-03-05"), "2026-02-30": same(None),
        "31/31/1999": same(None), "xx": same(None), "": same(None), None: same(None), "2026-03-05 nonsense": same(None)}


def test_hours_written_as_floats_and_discarded_text(spark):
    cols = "store_id string, row_seq bigint, Fecha string, `Código venta` string, `Nombre Corregido` string, `Categoria Real` string, " \
           "Cantidad string, Individual string, Total string, Hour string"
    raw = spark.createDataFrame([("S", 2, "2026-01-05", "1", "a", "c", "1", "10", "10", "13.0"),
                                 ("S", 3, "2026-01-05", "2", "a", "c", "dos", "10", "10", "x")], cols)
    lines, discarded, _ = clean.sanitize(raw, ReportConfig())
    assert [r["sale_hour"] for r in lines.collect()] == [13]
    d = discarded.collect()[0]
    assert (d["fila_original"], d["Cantidad"], d["Hour"], d["motivo_descarte"]) == (3, "dos", "x", "Cantidad inválida; Hora inválida")


def test_mapped_category_columns_are_kept(spark):
    df = spark.createDataFrame([("2026-01-05", "F1", "pan", "2", "3000", "Panes", "40%")],
                               "f string, o string, p string, q string, t string, cat string, m string")
    mapping = {"date": "f", "order_id": "o", "product": "p", "quantity": "q", "total": "t", "categoria": "cat", "margen_pct": "m"}
    out = N.apply_column_mapping(df, mapping).collect()[0]
    assert (out["Categoria Real"], out["margin_pct"]) == ("Panes", "40%")


def test_lines_without_price_or_date_find_their_map_row(spark):
    pm = _map(spark, [("x", None, None, "X", "c", "s", "10")])
    sales = _sales(spark, [("2026-01-05", "x", 1, 5)])
    both = sales.selectExpr("store_id", "sale_date", "order_id", "product_raw", "quantity",
                            "cast(null as decimal(18,4)) as unit_price", "total").unionByName(
        sales.selectExpr("store_id", "cast(null as date) as sale_date", "order_id", "product_raw", "quantity", "unit_price", "total"))
    assert [(r["match_kind"], r["product"]) for r in N.enrich(both, pm).collect()] == [("agnostic", "X")] * 2


def test_exports_to_normalized_text_keep_time_and_own_enrichment(spark):
    from tillsight.plans.report import ReportJob

    cols = "store_id string, source_rank int, row_pos int, Fecha string, Hora string, `Código venta` string, Producto string, " \
           "Cantidad string, Individual string, Total string"
    rows = [("S", 1, 1, "2026-01-05", "9:47:13 AM", "1", "pan", "1", "10", "10")]
    job = ReportJob(spark)
    plain = job.normalize(spark.createDataFrame(rows, cols)).collect()[0]
    assert (plain["Hora"], plain["Hour"], plain["Categoria Real"], plain["Nombre Corregido"]) == ("9:47:13 AM", 9, "Otros", "pan")
    own = spark.createDataFrame([(*rows[0], "Panes", "Dulce", "40%", "caja 1")],
                                cols + ", `Categoria Real` string, `Sub Categoria Real` string, margin_pct string, Caja string")
    r = job.normalize(own).collect()[0]
    assert (r["Categoria Real"], r["Sub Categoria Real"], r["margin_pct"], r["Caja"]) == ("Panes", "Dulce", 40.0, "caja 1")
    assert not {"source_rank", "row_pos", "match_kind", "time_txt"} & set(job.normalize(own).columns)
    lines, _, _ = clean.sanitize(job.normalize(own), ReportConfig())
    assert [(x["product"], x["category"], x["margin_pct"], x["sale_hour"]) for x in lines.collect()] == [("pan", "Panes", 40.0, 9)]
    assert ReportJob(spark).run_id != job.run_id
