"""Landing folders, row numbers, per-store enrichment and settings, jobs from specifications."""

from __future__ import annotations

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tillsight.config import REPORT_CATEGORY_MAP, StoreConfigs
from tillsight.functions.numbering import dense_numbers
from tillsight.operators import clean
from tillsight.operators import normalize as N
from tillsight.operators import products as P
from tillsight.plans import jobs
from tillsight.plans.report import ReportJob
from tillsight.sources import jobspec as JS
from tillsight.sources import landing as L

SS = "urn:schemas-microsoft-com:office:spreadsheet"


def folder(files: dict[str, bytes | str]) -> str:
    d = tempfile.mkdtemp(prefix="tillsight-landing-", dir="/tmp")
    for name, content in files.items():
        os.makedirs(os.path.dirname(os.path.join(d, name)), exist_ok=True)
        with open(os.path.join(d, name), "wb") as fh:
            fh.write(content if isinstance(content, bytes) else content.encode())
    return d


def sheet(rows) -> str:
    body = "".join("<Row>" + "".join(f"<Cell><Data>{c}</Data></Cell>" for c in r) + "</Row>" for r in rows)
    return f'<?xml version="1.0"?><Workbook xmlns="{SS}" xmlns:ss="{SS}"><Worksheet><Table>{body}</Table></Worksheet></Workbook>'


def test_dense_numbers_follow_the_order_within_each_key(spark):
    rows = [(None if i % 7 == 0 else f"k{i % 3 if i % 2 else 0}", (i * 37) % 1000, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(7)
    got = dense_numbers(df, ["k"], [F.col("v"), F.col("i")], "n", start=5).collect()
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in got if r["k"] == key), key=lambda r: r["n"])
        assert [r["n"] for r in mine] == list(range(5, 5 + len(mine)))
        assert [(r["v"], r["i"]) for r in mine] == sorted((v, i) for k, v, i in rows if k == key)
    assert dense_numbers(df.limit(0), ["k"], [F.col("v")]).count() == 0


def test_rows_are_numbered_over_the_splits_of_a_file(spark):
    lines = [f"2026-01-{k % 28 + 1:02d},1:00:00 PM,{k},pan,1,10,10" for k in range(3000)]
    text = "Fecha,Hora,Código venta,Producto,Cantidad,Individual,Total\r\n" + "\r\n".join(
        x + ("\r\n   " if k % 50 == 0 else "") for k, x in enumerate(lines)) + "\r\n"
    d = folder({"a.csv": text, "b.csv": text[:2000]})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = L.scan(spark, d).rows.where("path like '%a.csv'").orderBy("row_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 20))
    assert [r["row_no"] for r in got] == list(range(1, 3002))  # blank lines don't count
    assert [r["cells"][2] for r in got[1:]] == [str(k) for k in range(3000)]


def test_a_folder_of_any_header_and_format(spark):
    head = ["Fecha", "Hora", "Código venta", "Producto", "Cantidad", "Individual", "Total"]
    latin = ("fecha venta;factura;artículo;cant;valor total;familia;Nombre Corregido\r\n"
             + "2024-01-01;9;Té ñandú áéíóú;2;11;Bebidas;Té\r\n" * 3).encode("latin-1")
    d = folder({
        "raw_a.csv": "﻿Fecha,Hora,Código venta,Producto,Cantidad,Individual,Total\n2024-01-01,1:00:00 PM,7,\"Pan, grande\",2,5,10\n",
        "raw_b.txt": latin, "sub/raw_c.xls": sheet([head, ["2024-01-03", "2:00:00 PM", "8", "pan", "1", "3", "3"], ["2024-01-04"]]),
        "raw_d.csv": "a,b\n1,2\n", "raw_e.xls": b"\xd0\xcf\x11\xe0 binary", "raw_f.csv": "", "other.csv": "Fecha\n",
        "raw_g.xls": sheet([head, ["2024-01-05", "2:00:00 PM", "9", "pan", "1", "3", "3"]])[:-60], "_raw_hidden.csv": "x\n"})
    landing = L.scan(spark, d, "raw_")
    files = {os.path.basename(r["path"]): r for r in landing.files.collect()}
    assert sorted(files) == [f"raw_{x}" for x in ("a.csv", "b.txt", "c.xls", "d.csv", "e.xls", "f.csv", "g.xls")]
    assert (files["raw_b.txt"]["encoding"], files["raw_b.txt"]["delimiter"]) == ("latin-1", ";")
    assert files["raw_a.csv"]["header"] == head == files["raw_c.xls"]["header"]
    bad = {os.path.basename(r["path"]): r["error"] for r in L.rejected(landing).collect()}
    assert sorted(bad) == ["raw_e.xls", "raw_f.csv", "raw_g.xls"] and "binary" in bad["raw_e.xls"]
    maps = L.mappings(landing.files)
    missing = {os.path.basename(r["path"]): r["missing"] for r in maps.collect()}
    assert missing["raw_d.csv"] == ["date", "order_id", "product", "quantity", "total"] and missing["raw_b.txt"] == []
    got = sorted(((os.path.basename(r["source_file"]), r["row_pos"]["row_no"], r["Fecha"], r["Hora"], r["Producto"], r["Individual"],
                   r["Categoria Real"], r["Nombre Corregido"], r["own_enrichment"])
                  for r in L.canonical_rows(landing, maps, F.lit("S")).collect()), key=str)
    te = ("2024-01-01", "00:00", "Té ñandú áéíóú", "5.5", "Bebidas", "Té", True)
    assert got == [
        ("raw_a.csv", 2, "2024-01-01", "1:00:00 PM", "Pan, grande", "5", None, None, False),
        ("raw_b.txt", 2, *te), ("raw_b.txt", 3, *te), ("raw_b.txt", 4, *te),
        ("raw_c.xls", 2, "2024-01-03", "2:00:00 PM", "pan", "3", None, None, False),
        ("raw_c.xls", 3, "2024-01-04", None, None, None, None, None, False)]
    assert L.scan(spark, d + "/nothing").rows.count() == 0


def test_a_glob_and_an_explicit_mapping(spark):
    d = folder({"x/a.csv": "D,N,A,Q,T\n2024-01-01,1,pan,2,10\n", "y/b.csv": "D,N,A,Q,T\n2024-01-01,2,pan,2,10\n"})
    files = L.file_index(spark, d + "/x/*.csv")
    assert files.count() == 1
    given = F.create_map(*[F.lit(x) for kv in {"date": "D", "order_id": "N", "product": "A", "quantity": "Q", "total": "T"}.items()
                           for x in kv])
    m = L.mappings(files.withColumn("mapping", given)).collect()[0]
    assert m["missing"] == [] and m["at"]["total"] == 4


POS = "store_id string, row_pos int, Fecha string, Hora string, `Código venta` string, Producto string, Cantidad string, " \
      "Individual string, Total string"
OWN = ", `Categoria Real` string, `Sub Categoria Real` string, margin_pct string, own_enrichment boolean"


def test_each_store_is_enriched_from_its_best_source(spark):
    pos = ("2026-01-05", "1:00:00 PM", "1", "pan", "1", "10", "10")
    rows = [("own", 1, *pos, "Panes", None, "40%", True), ("own", 2, "2026-01-04", *pos[1:], None, None, None, False),
            ("map", 1, *pos, None, None, None, False), ("map", 2, *pos[:3], "nuevo", *pos[4:], None, None, None, False),
            ("none", 1, *pos, None, None, None, False)]
    pm = spark.createDataFrame([("own", "pan", "P", "Del mapa", "s", "1"), ("map", "pan", "P", "Del mapa", "s", "20")],
                               "store_id string, sistema string, nombre string, categoria string, subcategoria string, margen_pct string")
    margins = spark.createDataFrame([("own", "Otros", 7.0), ("map", "Otros", 33.0), ("none", "Otros", 9.0), ("own", "Panes", 1.0)],
                                    "store_id string, category string, margin_pct double")
    out = ReportJob(spark).normalize(spark.createDataFrame(rows, POS + OWN), pm, margins).collect()
    got = sorted((r["store_id"], r["row_seq"], r["Nombre Corregido"], r["Categoria Real"], r["margin_pct"]) for r in out)
    assert got == [("map", 2, "P", "Del mapa", 20.0), ("map", 3, "nuevo", "Otros", 33.0), ("none", 2, "pan", "Otros", 9.0),
                   ("own", 2, "pan", "Otros", 7.0), ("own", 3, "pan", "Panes", 40.0)]


def test_only_legacy_files_lose_their_enrichment(spark):
    from tillsight.sources import files as FS

    text = ("Fecha,Hora,Código venta,Producto,Cantidad,Individual,Total,Categoria Real\n"
            "2026-01-05,9:47:13 AM,A1,pan,1,10,10,Panes\n")
    d = folder({"new.csv": text, "legacy.csv": text})
    got = FS.read_csv_exports(spark, d, legacy_suffix="legacy.csv").collect()
    assert sorted((os.path.basename(r["source_file"]), r["Categoria Real"]) for r in got) == [("legacy.csv", None), ("new.csv", "Panes")]


def test_settings_of_stores(spark, make_lines):
    given = [("A", {"category_normalization": json.dumps({"x": "X"}), "top_n_products": "1", "pareto_threshold": "abc", "what": "1",
                    "columns": json.dumps({"date": "Date", "order_id": "Ticket", "nonsense": "y"})}),
             ("B", {"category_normalization": "report"}), ("C", None)]
    configs = JS.store_configs(spark.createDataFrame(given, "store_id string, tenant_config map<string,string>"))
    a, b, c = configs.orderBy("store_id").collect()
    assert (a["category_map"], a["top_n_products"], a["pareto_threshold"], a["ignored"]) == ({"x": "X"}, 1, None, ["what"])
    assert a["columns"] == {"date": "Date", "order_id": "Ticket"}
    assert b["category_map"] == REPORT_CATEGORY_MAP and c["category_map"] is None and c["ignored"] == []
    lines = make_lines([(s, o, "2026-01-05", 9, p, cat, 1, t) for s in "ABC" for o, p, cat, t in
                        ((1, "p", "x", 10), (2, "q", "PAN", 5), (3, "r", None, 1))])
    raw = lines.withColumn("category_raw", F.when(F.col("category") != "Otros", F.col("category")))
    got = {(r["store_id"], r["product"]): r["category"] for r in clean.store_categories(raw, configs).collect()}
    assert [got[s, p] for s in "ABC" for p in "pqr"] == ["X", "Otros", "Otros", "Otros", "Panadería", "Otros", "x", "PAN", "Otros"]
    top = P.products_top_n(lines, StoreConfigs(table=configs)).collect()
    assert sorted((r["store_id"], r["product"]) for r in top) == [("A", "p")] + [(s, p) for s in "BC" for p in "pqr"]


def test_aliases_of_stores(spark):
    configs = JS.store_configs(spark.createDataFrame(
        [("A", {"columns": json.dumps({"date": "Date", "order_id": "Ticket"})}), ("B", {})],
        "store_id string, tenant_config map<string,string>"))
    cols = "store_id string, row_seq bigint, Fecha string, Date string, Ticket string, `Código venta` string, Producto string, " \
           "`Nombre Corregido` string, `Categoria Real` string, Cantidad string, Individual string, Total string, Hora string"
    rows = [("A", 2, None, "2026-01-05", "7", None, "p", "p", "c", "1", "1", "1", "9:00:00 AM"),
            ("B", 2, "2026-01-06", None, None, "8", "p", "p", "c", "1", "1", "1", "9:00:00 AM")]
    raw = clean.with_store_aliases(spark.createDataFrame(rows, cols), configs)
    lines, discarded, _ = clean.sanitize(raw)
    assert sorted((r["store_id"], str(r["sale_date"]), r["order_id"]) for r in lines.collect()) == [
        ("A", "2026-01-05", "7"), ("B", "2026-01-06", "8")]
    assert discarded.count() == 0


@pytest.fixture(scope="module")
def results(spark):
    head = "Fecha,Hora,Código venta,Producto,Cantidad,Individual,Total\n"
    line = "2026-01-{:02d},1:00:00 PM,{},pan,1,10,10\n"
    d = folder({"a/1.csv": head + "".join(line.format(k % 28 + 1, k) for k in range(60)), "a/2.csv": head + line.format(1, 0),
                "b.csv": "D;N;A;Q;T\n" + "".join(f"2026-01-{k + 1:02d};{k};café;{'x' if k == 3 else 2};9\n" for k in range(20)),
                "c.csv": head + "nunca,1:00:00 PM,1,pan,1,10,10\n", "e.xls": b"\xd0\xcf\x11\xe0"})
    mapping = {"date": "D", "order_id": "N", "product": "A", "quantity": "Q", "total": "T"}
    specs = [dict(job_id="r1", type="report", store_id="S1", input_files=[f"{d}/a/"], category_margins={"Otros": 50}),
             dict(job_id="r2", type="report", store_id="S2", input_files=[f"{d}/b.csv"], column_mapping=mapping),
             dict(job_id="d1", type="delta", store_id="S1", input_files=[f"{d}/a/1.csv"],
                  delta_config={"event_date": "2026-01-15", "window_days": "7", "selected_products": '["pan"]'}),
             dict(job_id="d2", type="delta", store_id="S2", input_files=[f"{d}/b.csv"], column_mapping=mapping,
                  delta_config={"event_date": "2026-01-10"}),
             dict(job_id="x1", type="other", store_id="S1", input_files=[]),
             dict(job_id="x2", type="report", store_id="S1", input_files=[f"{d}/zz.csv", f"{d}/b.csv", f"{d}/e.xls"]),
             dict(job_id="x3", type="report", store_id="S1", input_files=[f"{d}/c.csv"])]
    path = folder({"specs.json": "\n".join(map(json.dumps, specs))})
    result, modules = jobs.run_specs(spark, JS.read_job_specs(spark, path), report_modules=["summary", "products"],
                                     delta_modules=["delta_kpis", "delta_orders"])
    return {r["job_id"]: r for r in result.collect()}, modules


def test_jobs_that_cannot_run_say_why(results):
    got, _ = results
    assert {j: r["status"] for j, r in got.items()} == dict(r1="succeeded", r2="succeeded", d1="succeeded", d2="succeeded",
                                                            x1="failed", x2="failed", x3="failed")
    assert got["x1"]["error"] == "empty input_files; unknown type other" and got["x3"]["error"] == "sin filas válidas"
    assert all(part in got["x2"]["error"] for part in ("faltan columnas tras aplicar el mapeo: ", "input ilegible: ", "input no encontrado: "))


def test_jobs_that_can_run_are_counted_and_written(results):
    got, modules = results
    counts = {j: (r["input_rows"], r["normalized_rows"], r["discarded_rows"]) for j, r in got.items() if r["status"] == "succeeded"}
    assert counts == {"r1": (61, 60, 0), "r2": (20, 20, 1), "d1": (60, 60, 0), "d2": (20, 20, 1)}
    assert sorted((r["store_id"], r["product"], r["revenue"]) for r in modules["products"].collect()) == [
        ("r1", "pan", 600.0), ("r2", "café", 171.0)]
    kpis = {r["store_id"]: r for r in modules["delta_kpis"].collect()}
    assert (kpis["d1"]["window_days"], kpis["d2"]["window_days"]) == (7, 14)
    assert (str(kpis["d1"]["event_date"]), kpis["d1"]["pre_orders"], kpis["d1"]["n_selected"]) == ("2026-01-15", 14, 1)
    assert modules["delta_orders"].where("store_id = 'd2'").count() == 19


def test_enriched_lines_without_any_source(spark):
    rows = [("S", 1, "2026-01-05", "1:00:00 PM", "1", "pan", "1", "10", "10")]
    typed = N.typed_pos(N.consolidate(spark.createDataFrame(rows, POS), ("row_pos",)))
    r = N.enrich_by_store(typed).collect()[0]
    assert (r["product"], r["category_raw"], r["subcategory"], r["margin_pct"]) == ("pan", "Otros", None, None)


def test_values_of_any_depth_become_json(spark):
    from datetime import date, datetime

    from tillsight.sources import sinks

    df = spark.createDataFrame(
        [("S", [1.0, float("nan"), None], (date(2026, 1, 5), [float("inf")]), {date(2026, 1, 6): [float("-inf"), 2.0]}, {1: "x"}, "t",
          datetime(2026, 1, 5, 9, 30)), ("S", None, None, None, None, None, None)],
        "store_id string, a array<double>, s struct<d: date, x: array<double>>, m map<date, array<double>>, k map<int,string>, "
        "t string, ts timestamp")
    got = [json.loads(r[0]) for r in sinks.json_safe(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    assert got[0] == {"store_id": "S", "a": [1.0, None, None], "s": {"d": "2026-01-05", "x": [None]}, "m": {"2026-01-06": [None, 2.0]},
                      "k": {"1": "x"}, "t": "t", "ts": "2026-01-05T09:30:00"}
    assert got[1] == {"store_id": "S"} | dict.fromkeys(["a", "s", "m", "k", "t", "ts"])


def test_contract_counts_schema_and_values(spark):
    from tillsight.operators import contract as K

    fields = (K.Field("n"), K.Field("t", "string", null=True, values=("a", "b")), K.Field("gone"),
              K.Field("r", "list", fields=(K.Field("x"), K.Field("y", "string"), K.Field("z"))))
    rows = [("S", 1.0, "a", [(1.0, "u"), (None, None)]), ("S", float("nan"), None, None), ("S", None, "c", []), ("T", 2.0, "b", [(3.0, None)])]
    df = spark.createDataFrame(rows, "store_id string, n double, t string, r array<struct<x: double, y: string>>")
    got = {(r["store_id"], r["field"], r["check"]): r["violations"] for r in K.check(df, "m", fields).collect()}
    s = {k[1:]: v for k, v in got.items() if k[0] == "S"}
    assert s == {("n", "null"): 1, ("n", "finite"): 1, ("t", "values"): 1, ("gone", "missing"): 3, ("r", "null"): 1,
                 ("r[].x", "null"): 1, ("r[].x", "finite"): 0, ("r[].y", "null"): 1, ("r[].z", "missing"): 2}
    assert K.check(df.withColumn("n", F.col("t")), "m", fields[:1]).where("check = 'type'").count() == 2


def test_selections_by_bitmaps_equal_those_by_lines(spark, make_lines):
    from tillsight.config import DeltaConfig
    from tillsight.operators import order_index as OI

    lines = make_lines([("S" if k % 3 else "T", k // 2, f"2026-01-{k % 20 + 1:02d}", 9, f"p{k * 7 % 11}", "c", 1, 10) for k in range(900)])
    orders, index = OI.build(lines, DeltaConfig())
    names = spark.createDataFrame([("one", "p1"), ("two", "p2"), ("two", "p3"), ("none", "zz")], "name string, product string")
    picked = OI.select(index, names)
    want = lines.join(names, "product").select("store_id", "name", F.col("sale_date").alias("date"), "order_id").distinct()
    got = OI.orders_of(orders, picked).select("store_id", "name", "date", "order_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    by_name = {(r["store_id"], r["name"]): r["orders"] for r in OI.counts(picked).collect()}
    assert by_name == {(r["store_id"], r["name"]): r["count"] for r in want.groupBy("store_id", "name").count().collect()}
