"""Registered queries of the ingest side.

File queries write files derived from the driver tables into the session's scratch
folder (under ``spark.checkpoint.dir``) and read them back through the sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillsight.operators import ingest as IG
from tillsight.operators import normalize as N
from tillsight.operators import slice as SL
from tillsight.sources import jobspec as JS
from tillsight.sources import sinks as SK
from tillsight.operators import timeline as TL
from tillsight.operators import products as P
from tillsight.plans import oracle_sql as O
from tillsight.plans.registry import register, with_ctes
from tillsight.session import scratch_table_path, shuffles_removed
from tillsight.sources import bindings as B
from tillsight.sources import files as FS
from tillsight.sources import landing as L

# Test rules for part names (same shape as the product rules: first match wins,
# keyword at a word boundary).
PART_RULES = (("Herrajes", ("bolt", "gear", "ring")), ("Herramientas", ("anvil", "rod")),
              ("Artilugios", ("gizmo", "widget")), ("Vajilla", ("plate",)))


POS = ("Fecha", "Hora", "Código venta", "Producto", "Cantidad", "Individual", "Total")


def _sql_rule_case(col: str, rules) -> str:
    padded = f"(' ' || lower(strip_accents({col})) || ' ')"
    whens = " ".join(f"WHEN {' OR '.join(f'contains({padded}, {chr(39)} {kw}{chr(39)})' for kw in kws)} THEN '{cat}'"
                     for cat, kws in rules)
    return f"CASE {whens} END"


@register("category_suggestion", f"""
SELECT DISTINCT p_name AS product, {_sql_rule_case('p_name', PART_RULES)} AS suggestion,
       {_sql_rule_case('p_name', IG.CATEGORY_RULES)} AS food_suggestion FROM part""")
def q_category_suggestion(spark, d):
    names = B.table(spark, d, "part").select(F.col("p_name").alias("product")).distinct()
    return names.select("product", IG.suggest_category(F.col("product"), PART_RULES).alias("suggestion"),
                        IG.suggest_category(F.col("product")).alias("food_suggestion"))


def _header_table(spark, d):
    """The header cells of every written export, from its first block."""
    prof = L.file_index(spark, _write_csv_exports(spark, d))
    return prof.select(F.regexp_extract("path", "(store_id=[^/]+/year=[^/]+)", 1).alias("file_id"),
                       F.posexplode("header").alias("pos", "header")).distinct()


# The exports' headers are the POS columns, each an exact synonym of its field.
_FILES_SQL = """files AS (SELECT DISTINCT 'store_id=S' || CAST(o.o_custkey % 4 AS VARCHAR) || '/year=' || strftime(o.o_orderdate, '%Y') AS file_id
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""
_FIELDS_SQL = ", ".join(f"('{f}', {i}, '{h}')" for i, (f, h) in enumerate(zip(
    ("date", "time", "order_id", "product", "quantity", "unit_price", "total"), POS)))


@register("header_automap", f"""
WITH {_FILES_SQL}
SELECT file_id, field, CAST(i AS INTEGER) AS field_ix, header, CAST(i AS INTEGER) AS pos, 'exact' AS pass
FROM files CROSS JOIN (VALUES {_FIELDS_SQL}) f(field, i, header)""")
def q_header_automap(spark, d):
    return IG.automap_headers(_header_table(spark, d))


@register("mapping_checks", f"""
WITH {_FILES_SQL}
SELECT file_id, CAST([] AS VARCHAR[]) AS missing_required, 0 AS duplicated_sources, true AS valid FROM files""")
def q_mapping_checks(spark, d):
    return IG.mapping_checks(IG.automap_headers(_header_table(spark, d)))


def _xml_escape(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


XML_HEAD = ('<?xml version="1.0"?>\n<Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" '
            'xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet"><Worksheet ss:Name="Ventas"><Table>')
DOCUMENT_ROWS = 20_000
XML_TAIL = "</Table></Worksheet></Workbook>"
#: Where a null key is written.  With it in place, Spark knows that no key is null, and doesn't sort rows for that once more.
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def write_documents(lines, path: str, keys: list[str], order: list[str], cell, order_id=None) -> None:
    """Compressed SpreadsheetML documents of export lines (see :func:`B.pos_export_lines`), one for each value of ``keys``, its
    rows in ``order``; ``cell`` gives the opening tags of the cell of a column's number.  A line that lacks a value isn't written.

    Lines move and are sorted in narrow columns and become text where they are written, one by one: no task holds a document.
    """
    at = Window.partitionBy(*keys).orderBy(*order)
    dealt = lines.dropna(subset=list(B.EXPORT_VALUES)).withColumns(
        {k: F.coalesce(k, F.lit(_NO_VALUE)) for k, kind in lines.dtypes if k in keys and kind == "string"}).repartition(*keys)
    dealt = dealt.withColumns({"_first": F.lag(F.lit(True)).over(at).isNull(), "_last": F.lead(F.lit(True)).over(at).isNull()})
    text = B.export_text(dealt, "_first", "_last", *order, *[k for k in keys if k != "store_id"])
    if order_id is not None:
        text = text.withColumn("Código venta", order_id)
    head = XML_HEAD + "<Row>" + "".join(f"{cell(0)}{h}</Data></Cell>" for h in POS) + "</Row>"
    cells = [F.concat(F.lit(cell(i)), _xml_escape(F.col(f"`{c}`")), F.lit("</Data></Cell>")) for i, c in enumerate(POS)]
    value = F.concat(F.when(F.col("_first"), head).otherwise(""), F.lit("<Row>"), *cells, F.lit("</Row>"),
                     F.when(F.col("_last"), XML_TAIL).otherwise(""))
    with shuffles_removed(lines.sparkSession):
        text.select(*keys, value.alias("value")).write.mode("overwrite").option("compression", "gzip").partitionBy(*keys).text(path)


def _write_spreadsheetml(spark, d) -> str:
    """Monthly SpreadsheetML exports per store, in documents of about ``DOCUMENT_ROWS`` rows at most, cells written
    with explicit ``ss:Index`` on every other column to exercise sparse positions."""
    path = scratch_table_path(spark, f"{spark.sparkContext.applicationId}/xml_exports")
    lines = B.written(B.pos_export_lines(spark, d), "export-lines")  # counted, then dealt out
    lines = lines.withColumn("month", F.substring(F.date_format("day", "yyyy-MM-dd"), 1, 7))
    # the number of documents of a month follows from the fullest one, so that none outgrows a task
    fullest = lines.groupBy("store_id", "month").count().agg(F.max("count")).first()[0] or 0
    bucket = F.pmod(F.xxhash64(*lines.columns), F.lit(-(-fullest // DOCUMENT_ROWS) or 1))
    # row order inside a document does not reach the parsed output (only cells do)
    write_documents(lines.withColumn("bucket", bucket), path, ["store_id", "month", "bucket"], ["l_orderkey"],
                    lambda i: f"""<Cell{f' ss:Index="{i + 1}"' if i % 2 else ""}><Data ss:Type="String">""")
    return path


@register("spreadsheetml_read", f"""
SELECT 'S' || CAST(o.o_custkey % 4 AS VARCHAR) AS store_id, strftime(o.o_orderdate, '%Y-%m-%d') AS "Fecha",
       printf('%d:%02d:00 %s', (l.l_linenumber % 12) + 1, l.l_partkey % 60, CASE WHEN l.l_orderkey % 2 = 0 THEN 'AM' ELSE 'PM' END) AS "Hora",
       CAST(l.l_orderkey AS VARCHAR) AS "Código venta", p.p_name AS "Producto", CAST(CAST(l.l_quantity AS BIGINT) AS VARCHAR) AS "Cantidad",
       CAST(CAST(p.p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS "Individual",
       CAST(CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18,4)) AS VARCHAR) AS "Total"
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey""")
def q_spreadsheetml_read(spark, d):
    path = _write_spreadsheetml(spark, d)
    got = FS.read_spreadsheetml(spark, path + "/*/*/*/part-*")
    return got.select(F.regexp_extract("source_file", "store_id=([^/]+)", 1).alias("store_id"), *[F.col(f"`{c}`") for c in POS])


def _write_csv_exports(spark, d) -> str:
    """Yearly CSV exports per store; ';' delimiter for even stores, ',' for odd ones."""
    path = scratch_table_path(spark, f"{spark.sparkContext.applicationId}/csv_exports")
    raw = B.pos_export_text(spark, d).drop("o_orderdate").withColumn("year", F.substring("Fecha", 1, 4))
    for parity, delim in ((0, ";"), (1, ",")):
        part = raw.filter(F.substring("store_id", 2, 1).cast("int") % 2 == parity).select("store_id", "year", *[F.col(f"`{c}`") for c in POS])
        part.write.mode("append" if parity else "overwrite").option("header", True).option(
            "sep", delim).partitionBy("store_id", "year").csv(path)
    return path


@register("upload_profile", f"""
SELECT 'S' || CAST(o.o_custkey % 4 AS VARCHAR) AS store_id, strftime(o.o_orderdate, '%Y') AS year,
       'utf-8' AS encoding, CASE WHEN o.o_custkey % 4 % 2 = 0 THEN ';' ELSE ',' END AS delimiter,
       '{"|".join(POS)}' AS headers, count(*) AS row_count
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2, 3, 4, 5""")
def q_upload_profile(spark, d):
    path = _write_csv_exports(spark, d)
    prof = FS.profile_uploads(spark, path + "/*/*/part-*")
    per_file = prof.select(F.regexp_extract("path", "store_id=([^/]+)", 1).alias("store_id"),
                           F.regexp_extract("path", "year=([^/]+)", 1).alias("year"), "encoding", "delimiter",
                           F.array_join("headers", "|").alias("headers"), "row_count")
    return per_file.groupBy("store_id", "year", "encoding", "delimiter", "headers").agg(F.sum("row_count").alias("row_count"))


@register("newest_export", None)
def q_newest_export(spark, d):
    path = _write_csv_exports(spark, d)
    return FS.newest_csv(spark, path + "/*/*")


def _saved_map(spark, d):
    m = B.derived_product_map(spark, d)
    own = m.filter(F.col("map_seq") == 1).select("store_id", "sistema", F.when(F.length("sistema") % 4 == 0, F.lit("Otros")).otherwise(
        F.col("categoria")).alias("categoria"), "margen_pct")
    orphan = m.filter(F.col("map_seq") == 2).select("store_id", F.col("nombre").alias("sistema"), "categoria", "margen_pct")
    return own.unionByName(orphan)


WL_SQL = with_ctes(O.lines_a(), body=f"""
stats AS (SELECT store_id, product, arg_min(category, row_seq) AS category, sum(total) AS rev FROM lines_a GROUP BY 1, 2),
st AS (SELECT *, CAST(rev AS DOUBLE) AS revenue,
              {O.R('CAST(rev AS DOUBLE) / CAST(sum(rev) OVER (PARTITION BY store_id) AS DOUBLE) * 100.0', 2)} AS rev_share FROM stats),
od AS (SELECT store_id, product, count(DISTINCT order_id) AS orders FROM lines_a GROUP BY 1, 2),
{O.product_map()},
saved AS (SELECT store_id, sistema, CASE WHEN length(sistema) % 4 = 0 THEN 'Otros' ELSE categoria END AS categoria, margen_pct FROM pm WHERE map_seq = 1
          UNION ALL SELECT store_id, nombre, categoria, margen_pct FROM pm WHERE map_seq = 2),
j AS (SELECT COALESCE(s.store_id, v.store_id) AS store_id, COALESCE(s.product, v.sistema) AS sistema, s.category, s.revenue, s.rev_share,
             od.orders, v.categoria AS saved_cat, v.margen_pct AS saved_margin, v.sistema IS NOT NULL AS saved, s.product IS NOT NULL AS seen
      FROM st s LEFT JOIN od USING (store_id, product)
      FULL OUTER JOIN saved v ON v.store_id = s.store_id AND v.sistema = s.product)
SELECT store_id, sistema,
       CASE WHEN saved THEN CASE WHEN saved_cat = 'Otros' THEN '' ELSE COALESCE(saved_cat, '') END
            WHEN category IS NOT NULL AND category <> 'Otros' THEN category ELSE '' END AS categoria,
       saved_margin AS margen_pct, COALESCE(revenue, 0.0) AS revenue, COALESCE(rev_share, 0.0) AS rev_share,
       COALESCE(orders, 0) AS orders, seen AS in_latest_report
FROM j""")


def _worklist(spark, d):
    stats = P.products_pareto(B.tpch_lines(spark, d))
    return IG.worklist(stats, _saved_map(spark, d))


@register("product_worklist", WL_SQL)
def q_product_worklist(spark, d):
    return _worklist(spark, d)


@register("worklist_metrics", f"""
WITH wl AS ({WL_SQL}),
c AS (SELECT *, trim(categoria) AS cat, {_sql_rule_case('sistema', IG.CATEGORY_RULES)} AS sug FROM wl)
SELECT store_id, count(*) AS products, count(*) FILTER (WHERE cat <> '' AND cat <> 'Otros') AS classified,
       count(*) FILTER (WHERE cat = '' AND sug IS NOT NULL) AS pending_suggestions,
       count(DISTINCT CASE WHEN cat <> '' AND cat <> 'Otros' THEN cat END) AS categories_in_use,
       bool_or(NOT (cat <> '' AND cat <> 'Otros')) AS has_otros
FROM c GROUP BY store_id""")
def q_worklist_metrics(spark, d):
    return IG.worklist_metrics(_worklist(spark, d))


@register("saved_map_rows", f"""
WITH wl AS ({WL_SQL})
SELECT store_id, sistema, sistema AS nombre, CASE WHEN trim(categoria) = '' THEN 'Otros' ELSE trim(categoria) END AS categoria,
       CAST(NULL AS VARCHAR) AS subcategoria,
       CASE WHEN margen_pct IS NULL THEN NULL ELSE {O.R('least(greatest(CAST(margen_pct AS DOUBLE), 0.0), 99.0)', 2)} END AS margen_pct
FROM wl""")
def q_saved_map_rows(spark, d):
    return IG.saved_map_rows(_worklist(spark, d))


@register("interactive_base", with_ctes(O.lines_a(), body="""
SELECT store_id, strftime(sale_date, '%Y-%m-%d') AS date_str, year_week, year_month, weekday AS day, sale_hour AS hour,
       order_id, product, category, CAST(quantity AS DOUBLE) AS quantity, CAST(unit_price AS DOUBLE) AS unit_price,
       CAST(total AS DOUBLE) AS total, margin_pct FROM lines_a"""))
def q_interactive_base(spark, d):
    return SL.interactive_base(B.tpch_lines(spark, d))


@register("normalized_export", with_ctes(O.pos_sales(), O.product_map(), O.enrich_ctes(), body=f"""
h AS (SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(hour(o_orderdate) AS INTEGER) AS hr FROM orders)
SELECT strftime(sale_date, '%Y-%m-%d') AS "Fecha", printf('%02d:00:00', hr) AS "Hora", order_id AS "Código venta", product_raw AS "Producto",
       quantity AS "Cantidad", unit_price AS "Individual", total AS "Total", product AS "Nombre Corregido",
       category_raw AS "Categoria Real", subcategory AS "Sub Categoria Real", strftime(sale_date, '%b') AS "Month",
       {O.DAYS_SQL}[isodow(sale_date)] AS "Week Day", hr AS "Hour", margin_pct, store_id
FROM enriched JOIN h USING (order_id)"""))
def q_normalized_export(spark, d):
    """Every enriched line in the layout of the normalized export."""
    e = N.enrich(B.pos_sales(spark, d), N.prepare_product_map(B.derived_product_map(spark, d)))
    return N.normalized_export(e)


def _write_overlapping_exports(spark, d) -> list[str]:
    """Two raw CSV exports that overlap by one year, written in order (older first)."""
    base = scratch_table_path(spark, f"{spark.sparkContext.applicationId}/raw_exports")
    ex = B.overlapping_exports(spark, d)
    paths = []
    for rank in (1, 2):
        p = f"{base}/export_{rank}"
        ex.filter(F.col("source_rank") == rank).select("store_id", *[F.col(f"`{c}`") for c in POS]).write.mode(
            "overwrite").option("header", True).csv(p)
        paths.append(p)
    return paths


def _consolidate_sql() -> str:
    from tillsight.plans.queries_normalize import CONSOLIDATE_SQL
    return CONSOLIDATE_SQL


@register("raw_export_scan", f"""
WITH c AS ({_consolidate_sql()})
SELECT store_id, source_rank, count(*) AS lines FROM c GROUP BY 1, 2""")
def q_raw_export_scan(spark, d):
    """Exports read back through the CSV scan and consolidated; survivors per export
    (an export may be several part files, so the export directory ranks first)."""
    raw = FS.read_csv_exports(spark, _write_overlapping_exports(spark, d))
    raw = raw.withColumn("export_rank", F.regexp_extract("source_file", "export_([0-9]+)", 1).cast("int"))
    c = N.consolidate(raw, order_cols=("export_rank", "source_order", "row_pos"))
    return c.groupBy("store_id", F.col("export_rank").alias("source_rank")).agg(F.count(F.lit(1)).alias("lines"))


@register("job_specs", """
WITH st AS (SELECT DISTINCT 'S' || CAST(o.o_custkey % 4 AS VARCHAR) AS store_id
            FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
SELECT 'report-' || store_id AS job_id, store_id, 'report' AS type, '' AS problems, true AS valid FROM st
UNION ALL SELECT 'delta-' || store_id, store_id, 'delta', '', true FROM st
UNION ALL SELECT 'bad-' || store_id, store_id, 'forecast', 'unknown type forecast; empty input_files', false FROM st""")
def q_job_specs(spark, d):
    """Specs derived from the data's stores and the written exports: one report and one
    delta job per store (valid) and one with an unknown type and no inputs (invalid)."""
    paths = _write_overlapping_exports(spark, d)
    stores = B.written(B.tpch_lines_plan(spark, d).select("store_id").distinct(), "stores")
    margins = B.category_margins(spark, d).groupBy("store_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "margin_pct"))).alias("category_margins"))
    specs = stores.join(margins, "store_id").select(
        "store_id", F.inline(F.array(
            F.struct(F.concat(F.lit("report-"), F.col("store_id")).alias("job_id"), F.lit("report").alias("type"),
                     F.array(*[F.lit(p) for p in paths]).alias("input_files")),
            F.struct(F.concat(F.lit("delta-"), F.col("store_id")).alias("job_id"), F.lit("delta").alias("type"),
                     F.array(*[F.lit(p) for p in paths]).alias("input_files")),
            F.struct(F.concat(F.lit("bad-"), F.col("store_id")).alias("job_id"), F.lit("forecast").alias("type"),
                     F.array().cast("array<string>").alias("input_files")))), "category_margins")
    path = scratch_table_path(spark, f"{spark.sparkContext.applicationId}/job_specs")
    specs.write.mode("overwrite").json(path)
    v = JS.violations(JS.read_job_specs(spark, path))
    return v.withColumn("problems", F.array_join("problems", "; "))


@register("payload_documents", with_ctes(O.lines_a(), body="""
p AS (SELECT store_id, product, sum(total) AS revenue FROM lines_a GROUP BY 1, 2)
SELECT store_id, count(DISTINCT product) AS n_products,
       (SELECT count(DISTINCT sale_date) FROM lines_a l WHERE l.store_id = p.store_id) AS n_days,
       arg_max(product, revenue) AS first_product, arg_min(product, revenue) AS last_product FROM p GROUP BY 1"""))
def q_payload_documents(spark, d):
    """One gzip JSON document per store (all products in rank order, daily timeline), read back."""
    lines = B.tpch_lines(spark, d)
    path = scratch_table_path(spark, f"{spark.sparkContext.applicationId}/payload")
    SK.write_json_documents({"products": P.products_pareto(lines), "daily": TL.daily(lines)}, path, gzip=True)
    doc = spark.read.text(path)
    products = F.from_json(F.get_json_object("value", "$.products"), "array<struct<product:string>>")
    return doc.select(F.get_json_object("value", "$.store_id").alias("store_id"), products.alias("p"),
                      F.size(F.from_json(F.get_json_object("value", "$.daily"), "array<string>")).alias("n_days")).select(
        "store_id", F.size("p").cast("bigint").alias("n_products"), F.col("n_days").cast("bigint").alias("n_days"),
        F.element_at("p", 1)["product"].alias("first_product"), F.element_at("p", -1)["product"].alias("last_product"))


@register("raw_scan_mixed_headers", f"""
SELECT 'S' || CAST(o.o_custkey % 4 AS VARCHAR) AS store_id, l.l_orderkey % 2 = 1 AS has_caja, count(*) AS lines,
       sum(CAST(l.l_quantity AS BIGINT))::BIGINT AS units, count(DISTINCT l.l_orderkey) AS orders, 1 AS skipped_files
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2""")
def q_raw_scan_mixed_headers(spark, d):
    """Exports with two column orders and one file without the POS columns, scanned together."""
    base = scratch_table_path(spark, f"{spark.sparkContext.applicationId}/mixed_exports")
    text = B.pos_export_text(spark, d).select("store_id", *[F.col(f"`{c}`") for c in POS])
    odd = F.col("`Código venta`").cast("bigint") % 2 == 1
    text.where(~odd).write.mode("overwrite").option("header", True).csv(f"{base}/a")
    text.where(odd).select(F.lit("1").alias("Caja"), *[F.col(f"`{c}`") for c in reversed(POS)], "store_id").write.mode(
        "overwrite").option("header", True).csv(f"{base}/b")
    text.select("store_id", "Producto").distinct().coalesce(1).write.mode("overwrite").option("header", True).csv(f"{base}/c")
    paths = [f"{base}/{x}" for x in "abc"]
    skipped = FS.unusable_exports(spark, paths).agg(F.count(F.lit(1)).cast("int").alias("skipped_files"))
    got = FS.read_csv_exports(spark, paths).groupBy("store_id", F.col("Caja").isNotNull().alias("has_caja")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.col("Cantidad").cast("bigint")).alias("units"),
        F.count_distinct("Código venta").alias("orders"))
    return got.withColumn("skipped_files", F.lit(skipped.first()[0]))


@register("pipeline_lines", f"""
WITH c AS ({_consolidate_sql()})
SELECT store_id, product_raw AS product, 'Otros' AS category, substring(fecha, 1, 7) AS month, count(*) AS lines,
       round(sum(CAST(unit_price_txt AS DOUBLE)), 2) AS prices
FROM c GROUP BY 1, 2, 3, 4""")
def q_pipeline_lines(spark, d):
    """Written export files → scan → consolidate → fallback enrichment → normalized text → sanitized lines."""
    from tillsight.operators import clean
    from tillsight.plans.report import ReportJob

    raw = FS.read_csv_exports(spark, _write_overlapping_exports(spark, d))
    rank = F.regexp_extract("source_file", "export_([0-9]+)", 1).cast("int")
    raw = raw.withColumn("source_rank", F.struct(rank.alias("rank"), "source_order"))
    lines, _, _ = clean.sanitize(ReportJob(spark).normalize(raw))
    # the dedup key decides how many lines there are; which of two equal keys survives depends on the part files
    return lines.groupBy("store_id", "product", "category", F.date_format("sale_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.sum("unit_price").cast("double"), 2).alias("prices"))


@register("date_text_forms", """
WITH o AS (SELECT o_orderkey % 6 AS form, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders)
SELECT form, CASE WHEN form = 5 THEN NULL WHEN form = 4 AND d <= 12 THEN make_date(y, d, m) ELSE make_date(y, m, d) END AS sale_date,
       count(*) AS orders FROM o GROUP BY 1, 2""")
def q_date_text_forms(spark, d):
    """Order dates written in five forms and one bad one, read back (the month leads in year-last dates)."""
    from tillsight.functions.dates import parse_date

    o, at = B.table(spark, d, "orders"), F.col("o_orderdate")
    form = (F.col("o_orderkey") % 6).alias("form")
    text = (F.when(form == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).when(form == 1, F.date_format(at, "yyyy-MM-dd HH:mm"))
            .when(form == 2, F.date_format(at, "yyyy-M-d")).when(form == 3, F.date_format(at, "M/d/yyyy 10:00"))
            .when(form == 4, F.date_format(at, "d/M/yyyy")).otherwise(F.date_format(at, "yyyy-MM-dd 'x'")))
    return o.select(form, parse_date(text).alias("sale_date")).groupBy("form", "sale_date").agg(F.count(F.lit(1)).alias("orders"))
