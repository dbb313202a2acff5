"""Ingest side: SpreadsheetML parsing, upload profiling, header auto-map, category
suggestion."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from tillsight.operators import ingest as IG
from tillsight.sources import files as FS

SS = "urn:schemas-microsoft-com:office:spreadsheet"


def test_spreadsheetml_sparse_index(spark):
    d = tempfile.mkdtemp(prefix="tillsight-xml-", dir="/tmp")
    head = "".join(f"<Cell><Data>{h}</Data></Cell>" for h in ("Fecha", "Hora", "Código venta", "Producto", "Cantidad", "Individual", "Total"))
    row = ('<Row><Cell><Data>2026-01-05</Data></Cell><Cell ss:Index="3"><Data>A1</Data></Cell><Cell><Data>pan</Data></Cell>'
           '<Cell ss:Index="7"><Data>10</Data></Cell></Row>')
    xml = (f'<?xml version="1.0"?><Workbook xmlns="{SS}" xmlns:ss="{SS}"><Worksheet><Table><Row>{head}</Row>{row}'
           f'<Row><Cell><Data>2026-01-06</Data></Cell></Row></Table></Worksheet></Workbook>')
    with open(os.path.join(d, "a.xls"), "w", encoding="utf-8") as fh:
        fh.write(xml)
    with open(os.path.join(d, "b.xls"), "wb") as fh:
        fh.write(b"\xd0\xcf\x11\xe0 binary")
    rows = sorted(FS.read_spreadsheetml(spark, d).select("row_pos", "Fecha", "Hora", "`Código venta`", "Cantidad", "Total").collect())
    assert [tuple(r) for r in rows] == [(1, "2026-01-05", None, "A1", None, "10"), (2, "2026-01-06", None, None, None, None)]
    errs = FS.read_errors(spark, d).collect()
    assert len(errs) == 1 and errs[0]["path"].endswith("b.xls")


def test_profile_bytes():
    p = FS.profile_bytes("f.csv", "FECHA;Descripción;Total\n2026-01-05;pan;10\n\n2026-01-06;\"a;b\";5\n".encode("latin-1"))
    assert p[1] == "latin-1" and p[2] == ";" and p[3] == ["FECHA", "Descripción", "Total"]
    assert p[5] == 2 and p[4][1] == ["2026-01-06", "a;b", "5"]


def test_csv_files_with_other_headers(spark):
    d = tempfile.mkdtemp(prefix="tillsight-csv-", dir="/tmp")
    files = {"a.csv": "Fecha,Hora,Código venta,Producto,Cantidad,Individual,Total\n2026-01-05,9:47:13 AM,A1,pan,1,10,10\n",
             "b.csv": "Producto,Total,Código venta,Hora,Fecha,Individual,Cantidad,Caja\ncafe,20,B1,10:00:00 AM,2026-01-06,20,1,7\n",
             "c.csv": "foo,bar\n1,2\n"}
    for name, text in files.items():
        with open(os.path.join(d, name), "w", encoding="utf-8") as fh:
            fh.write(text)
    got = FS.read_csv_exports(spark, d).select("Fecha", "Hora", "`Código venta`", "Producto", "Total", "Caja").collect()
    assert sorted(tuple(r) for r in got) == [("2026-01-05", "9:47:13 AM", "A1", "pan", "10", None),
                                             ("2026-01-06", "10:00:00 AM", "B1", "cafe", "20", "7")]
    bad = FS.unusable_exports(spark, d).collect()
    assert len(bad) == 1 and bad[0]["source_file"].endswith("c.csv") and bad[0]["header"] == "foo,bar"


def test_header_automap_two_passes(spark):
    h = spark.createDataFrame([("f", i, c) for i, c in enumerate(
        ["FECHA", "No. Factura", "Descripción", "Cant.", "Precio Unitario", "Valor Total"])], "file_id string, pos int, header string")
    m = {r["field"]: (r["header"], r["pass"]) for r in IG.automap_headers(h).collect()}
    assert m["date"] == ("FECHA", "exact")
    assert m["order_id"] == ("No. Factura", "contains")
    assert m["product"] == ("Descripción", "exact")
    assert m["unit_price"] == ("Precio Unitario", "exact")
    assert m["total"] == ("Valor Total", "exact")
    assert m["quantity"] == ("Cant.", "exact")
    chk = IG.mapping_checks(IG.automap_headers(h)).collect()[0]
    assert chk["valid"] and chk["missing_required"] == []


def test_category_suggestion_word_boundary(spark):
    # "tres" must not fire "res " (keyword must start a word); "leches" does fire "leche" (prefix)
    df = spark.createDataFrame([("Tres",), ("Tres leches",), ("Café Latte",), ("Pan de bono",), ("Chocolate",), ("Mesa",)], "n string")
    got = {r["n"]: r["s"] for r in df.select("n", IG.suggest_category(F.col("n")).alias("s")).collect()}
    assert got == {"Tres": None, "Tres leches": "Lácteos", "Café Latte": "Cafetería", "Pan de bono": "Panadería",
                   "Chocolate": None, "Mesa": None}


def test_clamp_margin_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (120.0,), (42.5,)], "m double")
    got = [r["c"] for r in df.select(IG.clamp_margin(F.col("m")).alias("c")).collect()]
    assert got == [None, 0.0, 99.0, 42.5]
