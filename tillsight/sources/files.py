"""File sources: POS exports (CSV, SpreadsheetML), discovery and upload profiling
(S1–S5, S8, S14).

Headers come from a file's first block and SpreadsheetML rows from a stream (the data sources of
:mod:`tillsight.sources.landing`); CSV rows from Spark's reader.  Only upload profiling reads whole files, one per
row of ``binaryFile``: an upload is bounded (20 MB in the hosted product).  Nothing is collected on the
driver but one row per file.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.config import POS_COLUMNS
from tillsight.sources import landing
from tillsight.sources.landing import SourceError

SAMPLE_CSV_NAME = "sales_carts_sample.csv"
ENRICHMENT_COLUMNS = ("Nombre Corregido", "Categoria Real", "Sub Categoria Real", "Month", "Week Day", "Hour", "margin_pct")


# ── S1/S2/S5: CSV exports ───────────────────────────────────────────────────

def csv_headers(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``source_file``, ``header`` (the first line) of every text file, from its first block."""
    files = landing.file_index(spark, paths).where("kind = 'text'")
    return files.select(F.col("path").alias("source_file"), F.col("header_line").alias("header"))


def _usable(header: str) -> bool:
    return set(POS_COLUMNS) <= set(landing.cells_of(header, ","))


def unusable_exports(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``source_file``, ``header`` of the files that :func:`read_csv_exports` skips for want of a POS column."""
    cells = F.transform(F.split("header", ","), lambda c: F.trim(F.btrim(c, F.lit('"'))))
    return csv_headers(spark, paths).where(F.size(F.array_except(F.array(*[F.lit(c) for c in POS_COLUMNS]), cells)) > 0)


def read_csv_exports(spark: SparkSession, paths: list[str] | str, legacy_suffix: str | None = None) -> DataFrame:
    """All-text scan of POS CSV exports with source order columns.

    Files may differ in column order and extra columns: files with the same header line are scanned
    together and columns are matched by name (absent extras are null).  Files without the 7 POS
    columns are skipped (S5) and listed by :func:`unusable_exports`; none usable is an error.
    ``source_order`` orders files (a legacy file — name ending with ``legacy_suffix`` — last, then by
    modification time, then path) and ``row_pos`` is the position inside the scan; use both as
    the consolidation order.  Enrichment columns of legacy files are dropped, other files keep theirs.  Malformed
    lines are kept as nulls (PERMISSIVE).
    """
    by_header: dict[tuple[str, bool], list[str]] = {}
    for r in csv_headers(spark, paths).orderBy("source_file").collect():  # one row per file, as in the listing
        if _usable(r["header"] or ""):
            legacy = bool(legacy_suffix) and r["source_file"].endswith(legacy_suffix)
            by_header.setdefault((r["header"], legacy), []).append(r["source_file"])
    if not by_header:
        raise SourceError("faltan columnas POS: " + ", ".join(POS_COLUMNS))
    out = None
    for (_, is_legacy), files in by_header.items():
        df = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("inferSchema", False)
              .option("encoding", "UTF-8").csv(files))
        path = F.col("_metadata.file_path")
        dropped = ENRICHMENT_COLUMNS if is_legacy else ()
        part = df.select(*[F.col(f"`{c}`").alias(c.lstrip("\ufeff")) for c in df.columns if c not in dropped],
                         path.alias("source_file"),
                         F.struct(F.lit(is_legacy).alias("is_legacy"), F.col("_metadata.file_modification_time").alias("mtime"),
                                  path.alias("path")).alias("source_order"),
                         F.monotonically_increasing_id().alias("row_pos"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def newest_csv(spark: SparkSession, folder: str, exclude: str = SAMPLE_CSV_NAME) -> DataFrame:
    """The most recently modified CSV in ``folder`` other than the sample (content not read)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
             .select("path", "modificationTime", "length"))
    files = files.filter(~F.col("path").endswith("/" + exclude))
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"),
                     F.max("modificationTime").alias("modificationTime"), F.count(F.lit(1)).alias("candidates"))


# ── S3/S4: SpreadsheetML and binary sheets ──────────────────────────────────

def scan_spreadsheetml(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """S3: SpreadsheetML ``.xls`` exports: ``source_file``, ``row_pos`` and the 7 POS columns (header = first row, short
    rows padded with null), and for a file that can't be read one row with ``row_pos`` -1 and its ``error``."""
    files = landing.file_index(spark, paths).select("path", "length", "kind", "header", F.when(
        F.col("kind") != "sheet", F.lit("not SpreadsheetML (binary .xls/.xlsx needs an optional reader)")).otherwise(
        F.col("error")).alias("error"))
    files = landing.written(files, "sheet-files")
    sheets = [tuple(r) for r in files.where("error is null").select("path", "length").collect()]  # one path per file
    rows = landing.sheet_scan(spark, sheets).where("row_no > 1 or error is not null")
    header = files.select("path", "header")
    pos = [F.get("cells", F.array_position("header", c).cast("int") - 1).alias(c) for c in POS_COLUMNS]
    read = rows.join(header, "path").select(
        F.col("path").alias("source_file"),
        F.when(F.col("error").isNull(), F.col("row_no") - 1).otherwise(-1).cast("int").alias("row_pos"), *pos, "error")
    none = [F.lit(None).cast("string").alias(c) for c in POS_COLUMNS]
    return read.unionByName(files.where("error is not null").select(
        F.col("path").alias("source_file"), F.lit(-1).alias("row_pos"), *none, "error"))


def read_spreadsheetml(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The data rows of :func:`scan_spreadsheetml`."""
    return scan_spreadsheetml(spark, paths).where("error is null").drop("error")


def read_errors(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The unreadable files of :func:`scan_spreadsheetml`."""
    return scan_spreadsheetml(spark, paths).where("error is not null").select(F.col("source_file").alias("path"), "error")


# ── S14: upload profile ─────────────────────────────────────────────────────

PROFILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("encoding", T.StringType()),
    T.StructField("delimiter", T.StringType()), T.StructField("headers", T.ArrayType(T.StringType())),
    T.StructField("sample", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("row_count", T.LongType()),
    T.StructField("sha256", T.StringType()),
])


def profile_bytes(path: str, buf: bytes, sample_rows: int = 5) -> tuple:
    """Encoding, delimiter, headers, sample, row count and digest of one file."""
    text, encoding = buf.decode("utf-8", errors="replace"), "utf-8"
    if text.count("\ufffd") > min(5, len(text) / 1000):
        text, encoding = buf.decode("latin-1"), "latin-1"
    lines = [line for line in text.splitlines() if line.strip()]
    head = lines[0] if lines else ""
    delimiter = landing.delimiter_of(head)
    table = [landing.cells_of(line, delimiter) for line in lines[:1 + sample_rows]]
    return (path, encoding, delimiter, table[0] if table else [], table[1:], max(0, len(lines) - 1),
            hashlib.sha256(buf).hexdigest())


def _profile_udf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [profile_bytes(p, bytes(c)) for p, c in zip(b["path"], b["content"])]
        yield pd.DataFrame(rows, columns=[f.name for f in PROFILE_SCHEMA.fields])


def profile_uploads(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Per file — encoding (UTF-8 unless replacement characters exceed 5 or 0.1 %),
    delimiter among ; , TAB on the first line, headers, 5 sample rows, non-empty row
    count and SHA-256, in parallel over files."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(_profile_udf, PROFILE_SCHEMA)
