"""What a job leaves on disk: compressed exports, narrow shuffles, shuffle files that go with the step they were for."""

from __future__ import annotations

import glob
import gzip
import json
import os
import time
from datetime import datetime

import pytest

from pyspark.sql import functions as F

from tests.test_scale_steps import sheet, tables
from tillsight import session
from tillsight.operators import normalize as N
from tillsight.plans import queries_ingest as QI
from tillsight.plans import queries_jobs as QJ
from tillsight.plans.report import ReportJob
from tillsight.sources import bindings as B
from tillsight.sources import landing


def small_tables(spark, path) -> str:
    orders = [(k, k // 4 % 4 if k % 9 else None, datetime(1997, 5 + k % 3, 1 + k % 20, 9) if k % 11 else None) for k in range(40)]
    lines = [(k % 40, k % 4, 7, k % 5 if k % 13 else None, 2.0 if k % 7 else None, 10.0 + k, 0.5) for k in range(400)]
    tables(spark, str(path), lines + lines[:30], orders)
    return str(path)


def shuffle_files(spark) -> set[str]:
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f and f.endswith(".data")}


def test_written_tables_leave_no_shuffle_files(spark):
    name = session._REMOVAL
    held = spark.conf.get(name, None)
    before = shuffle_files(spark)
    df = spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 100).alias("k")).count()
    got = B.written(df, "t")
    for _ in range(20):
        left = {f for f in shuffle_files(spark) - before if os.path.exists(f)}
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(name, None) == held
    assert got.agg(F.sum("count")).first()[0] == 5000
    # one write inside another, and one that fails, put the setting back
    with pytest.raises(ValueError), session.shuffles_removed(spark):
        with session.shuffles_removed(spark):
            pass
        assert spark.conf.get(name) == "true"
        raise ValueError
    assert spark.conf.get(name, None) == held


def test_documents_are_compressed_and_hold_the_lines_that_have_every_cell(spark, tmp_path, monkeypatch):
    d = small_tables(spark, tmp_path)
    monkeypatch.setattr(QI, "DOCUMENT_ROWS", 10)
    path = QI._write_spreadsheetml(spark, d).removeprefix("file:")
    files = glob.glob(f"{path}/*/*/*/part-*")
    assert files and all(f.endswith(".txt.gz") for f in files)
    texts = {f: gzip.open(f, "rt").read() for f in files}
    # each is one whole document, in lines: a header and its rows
    assert all(t.count("<Workbook") == t.count("</Workbook>") == 1 and t.count("<Row>") == t.count("\n") for t in texts.values())
    assert len({f[:f.index("/bucket")] for f in files}) < len(files)  # a month has several
    want = sorted(tuple(r) for r in B.pos_export_text(spark, d).select("store_id", *[f"`{c}`" for c in QI.POS]).dropna(
        subset=list(QI.POS)).na.fill("__HIVE_DEFAULT_PARTITION__", ["store_id"]).collect())
    assert want and sorted(tuple(r) for r in QI.q_spreadsheetml_read(spark, d).collect()) == want


def test_packed_sheets_count_by_their_text(tmp_path):
    reader = landing._SheetsReader({"files": json.dumps([(f"{k}.xls.gz", landing.SHEET_BYTES_PER_TASK // 20) for k in range(4)])})
    assert [p.files for p in reader.partitions()] == [[f"{k}.xls.gz"] for k in range(4)]
    whole = tmp_path / "a.xls.gz"
    whole.write_bytes(gzip.compress(sheet("<Row><Cell><Data>x</Data></Cell></Row>")))
    got = [r for b in reader.read(landing.Files([str(whole)])) for r in b.to_pylist()]
    assert [r["cells"] for r in got] == [["x"]] and got[0]["error"] is None


def test_a_packed_file_without_a_line_end_is_known_by_its_text(tmp_path):
    long, short = tmp_path / "a.csv.gz", tmp_path / "b.csv.gz"
    long.write_bytes(gzip.compress(b"a," * landing.FIRST_BLOCK))
    short.write_bytes(gzip.compress(b"Fecha,Total"))
    assert landing.first_block(str(long), os.path.getsize(long), None)[-1] == "no line end in the first block"
    assert landing.first_block(str(short), os.path.getsize(short), None)[-1] is None


def test_cells_of_text_files_are_written_in_columns(tmp_path, spark):
    head = "Fecha,Hora,Código venta,Producto,Cantidad,Individual,Total"
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(f"{head}\n2024-01-01,1:00:00 PM,7,\"pan, ,\",2,5,10\n\n2024-01-02,,8\n".encode()))
    (tmp_path / "b.csv").write_text("Fecha;Ticket\n2024-01-03;9;x\n")
    scan = landing.scan(spark, str(tmp_path))
    got = {(os.path.basename(r["path"]), r["row_no"]): r["cells"] for r in scan.rows.where("row_no > 1").collect()}
    assert got == {("a.csv.gz", 2): ["2024-01-01", "1:00:00 PM", "7", "pan, ,", "2", "5", "10"],
                   ("a.csv.gz", 3): ["2024-01-02", None, "8", None, None, None, None], ("b.csv", 2): ["2024-01-03", "9", "x", *[None] * 4]}
    at = [f for f in scan.rows.inputFiles() if "landing-rows" in f]
    assert at and all(f.endswith(".zstd.parquet") for f in at)
    cells = spark.read.parquet(*at).schema["cells"].dataType
    assert cells.fieldNames() == [f"c{i}" for i in range(7)]


def test_landing_exports_are_compressed_and_paths_stay_with_their_files(spark, tmp_path, monkeypatch):
    d = small_tables(spark, tmp_path)
    seen = []
    held = QJ.N.consolidate
    monkeypatch.setattr(QJ.N, "consolidate", lambda raw, order: seen.append(raw.columns) or held(raw, order))
    got = {r["store_id"]: r for r in QJ.q_landing_consolidated(spark, d).collect()}
    assert seen and "source_file" not in seen[0] and "row_pos" in seen[0]
    base = QJ._base(spark, d, "landing_exports").removeprefix("file:")
    files = glob.glob(f"{base}/*/*/part-*") + glob.glob(f"{base}/*/*/*/part-*")
    assert {f[f.index(".", f.rindex("/")):].split(".", 2)[2] for f in files if os.path.isfile(f)} == {"csv.gz", "txt.gz"}
    want = B.numbered_export_text(spark, d).dropna(subset=list(QI.POS)).where("Fecha >= '1997-06-01'").na.fill(
        "__HIVE_DEFAULT_PARTITION__", ["store_id"]).groupBy("store_id").count().collect()
    assert want and {s: r["xls_rows"] for s, r in got.items() if r["xls_rows"]} == dict(want)
    assert all(r["dense"] for r in got.values())


def test_tenant_exports_are_compressed(spark, tmp_path):
    base = QJ._tenant_exports(spark, small_tables(spark, tmp_path)).removeprefix("file:")
    files = [f for x in "abcd" for f in glob.glob(f"{base}/{x}/**/part-*", recursive=True) if os.path.isfile(f)]
    assert {f[len(base) + 1] for f in files} == set("abcd") and all(f.endswith(".gz") for f in files)


def test_lines_are_numbered_without_what_no_export_has(spark, monkeypatch):
    seen = []
    held = N.dense_numbers
    monkeypatch.setattr(N, "dense_numbers", lambda rows, *a, **k: seen.append(rows.columns) or held(rows, *a, **k))
    raw = spark.createDataFrame([("S0", k, "2026-01-05", "1:00:00 PM", str(k), f"p{k % 2}", "1", "10", "10") for k in range(6)],
                                "store_id string, row_pos int, Fecha string, Hora string, `Código venta` string, Producto string, "
                                "Cantidad string, Individual string, Total string")
    pm = spark.createDataFrame([("p0", "P0", "C", "s", "20")], "sistema string, nombre string, categoria string, subcategoria string, "
                                                              "margen_pct string")
    got = sorted((r["row_seq"], r["Nombre Corregido"]) for r in ReportJob(spark).normalize(raw, pm).collect())
    assert got == [(k + 2, "p1" if k % 2 else "P0") for k in range(6)]
    assert seen and "match_kind" not in seen[0]
    # lines of one product are neighbours where copies are looked for, and take less space
    physical = N.consolidate(raw, ("row_pos",))._jdf.queryExecution().executedPlan().toString()
    assert "Sort [Producto#" in physical
