"""Registered queries of whole jobs over files: landing folders, foreign headers, discarded rows (S1-S5, S11, P13, P17,
N5, N6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tillsight.config import DeltaConfig, StoreConfigs
from tillsight.operators import cart as C
from tillsight.operators import clean, contract, delta
from tillsight.operators import gating as G
from tillsight.operators import ingest as IG
from tillsight.operators import normalize as N
from tillsight.operators import products as P
from tillsight.operators import profitability as PF
from tillsight.operators import slice as SL
from tillsight.operators import summary as S
from tillsight.operators import timeline as TL
from tillsight.plans import jobs
from tillsight.plans import oracle_sql as O
from tillsight.plans import queries_ingest as QI
from tillsight.plans.registry import register, with_ctes
from tillsight.plans.report import ReportJob
from tillsight.session import scratch_table_path, shuffles_removed
from tillsight.sources import bindings as B
from tillsight.sources import jobspec as JS
from tillsight.sources import landing as L
from tillsight.sources import sinks as SK


_WRITTEN: dict[tuple[str, str], str] = {}


def _store_of_path():
    return F.regexp_extract("path", "store_id=([^/]+)", 1)


def _base(spark, d, name: str) -> str:
    return scratch_table_path(spark, f"{spark.sparkContext.applicationId}/{name}")


def _numbered_text(spark, d):
    """The export text of binding A with an order id of its own for every line (order and row number)."""
    return B.numbered_export_text(spark, d).withColumn("Código venta", F.concat_ws("-", "Código venta", "row_seq"))


def _sheets(lines, path: str) -> None:
    """SpreadsheetML documents of at most about ``QI.DOCUMENT_ROWS`` numbered lines of one store, in their order."""
    part = F.floor(F.col("row_seq") / QI.DOCUMENT_ROWS)
    QI.write_documents(lines.withColumn("part", part), path, ["store_id", "part"], ["row_seq"], lambda i: "<Cell><Data>",
                       F.concat_ws("-", "Código venta", "row_seq"))


def _write_csv(rows, path: str, **options) -> None:
    """Compressed CSV exports, a folder for each store."""
    with shuffles_removed(rows.sparkSession):
        rows.write.mode("overwrite").options(header=True, compression="gzip", **options).partitionBy("store_id").csv(path)


def _write_tenant_exports(spark, d) -> str:
    """The folder of :func:`_tenant_exports`, written once per session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _WRITTEN:
        _WRITTEN[key] = _tenant_exports(spark, d)
    return _WRITTEN[key]


def _tenant_exports(spark, d) -> str:
    """Exports of four stores, each in its own way: POS columns, foreign headers with own categories (``;``), English
    headers without a time (tab), and SpreadsheetML; and two files that no job can use."""
    base = _base(spark, d, f"tenant_exports_{len(_WRITTEN)}")
    rows = _numbered_text(spark, d).withColumn("p_type", F.lit(None))
    part = B.written(B.table(spark, d, "part").groupBy(F.col("p_name").alias("Producto")).agg(
        F.min("p_type").alias("familia")), "families")
    rows = rows.drop("p_type").join(part, "Producto")
    c = {n: F.col(f"`{n}`") for n in QI.POS}

    def store(k: int):
        return rows.where(F.col("store_id") == f"S{k}")

    _write_csv(store(0).select(*c.values(), F.lit("S0").alias("store_id")), f"{base}/a")
    margin = F.when(F.length("Producto") % 2 == 0, F.format_string("%d,5%%", F.length("Producto")))
    _write_csv(store(1).select(
        c["Total"].alias("Valor Total"), c["Producto"].alias("Artículo"), c["Fecha"].alias("FECHA VENTA"),
        c["Código venta"].alias("No. Factura"), c["Cantidad"].alias("Cant."), "familia", margin.alias("Margen %"),
        F.lit("S1").alias("store_id")), f"{base}/b", sep=";")
    _write_csv(store(2).select(
        c["Fecha"].alias("Date"), c["Código venta"].alias("Ticket"), c["Producto"].alias("Item"), c["Cantidad"].alias("Qty"),
        c["Individual"].alias("Unit price"), c["Total"].alias("Total"), F.lit("S2").alias("store_id")), f"{base}/c", sep="\t")
    _sheets(B.numbered_export_lines(spark, d).where("store_id = 'S3'"), f"{base}/d")
    spark.createDataFrame([("foo,bar",), ("1,2",)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/e")
    spark.createDataFrame([("<?xml version='1.0'?><Workbook><Row>",)], "value string").coalesce(1).write.mode(
        "overwrite").text(f"{base}/f")
    return base


def _tenant_map(spark, d):
    """Price-agnostic map rows of stores S0, S1 and S3 (S1 brings categories, so its rows must not be used)."""
    m = B.derived_product_map(spark, d).where("map_seq = 1")
    return m.where(F.col("store_id").isin("S0", "S1", "S3"))


def _tenant_lines(spark, d):
    landing = L.scan(spark, _write_tenant_exports(spark, d))
    rows = L.canonical_rows(landing, L.mappings(landing.files), _store_of_path())
    estimates = spark.createDataFrame([(f"S{k}", "Otros", 33.0) for k in range(4)], "store_id string, category string, margin_pct double")
    text = ReportJob(spark).normalize(rows, _tenant_map(spark, d), estimates)
    return landing, clean.sanitize(text)[0]


TENANT_SQL = f"""
src AS (
  SELECT 'S' || CAST(o.o_custkey % 4 AS VARCHAR) AS store_id, {O.ROW_SEQ} AS seq, p.p_name AS raw, length(p.p_name) AS n,
         (SELECT min(p_type) FROM part q WHERE q.p_name = p.p_name) AS cat, CAST(o.o_orderdate AS DATE) AS sale_date,
         CAST(l.l_quantity AS DECIMAL(18,6)) AS quantity,
         CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18,4)) AS total
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
), own AS (
  SELECT *, store_id IN ('S0', 'S3') AND n % 11 <> 0 AS mapped,
         CASE WHEN store_id = 'S1' AND n % 2 = 0 THEN n + 0.5 END AS own_margin
  FROM src
), t AS (
  SELECT store_id, seq, sale_date, quantity, total, CASE WHEN mapped THEN upper(raw) ELSE raw END AS product,
         CASE WHEN mapped OR store_id = 'S1' THEN cat ELSE 'Otros' END AS category,
         CAST(CASE WHEN mapped THEN n + 20 WHEN store_id = 'S1' THEN own_margin ELSE 33 END AS DOUBLE) AS margin_pct
  FROM own)"""


@register("tenant_lines", f"""
WITH {TENANT_SQL}
SELECT store_id, product, category, strftime(sale_date, '%Y-%m') AS month, count(*) AS lines, CAST(sum(quantity) AS DOUBLE) AS units,
       CAST(sum(total) AS DOUBLE) AS revenue, avg(margin_pct) AS margin, min(sale_date) AS first_day
FROM t GROUP BY 1, 2, 3, 4""")
def q_tenant_lines(spark, d):
    """Four stores' files, each with its own header, delimiter or format, from one scan to sanitized lines: the mapping
    found by synonyms, own categories before the map before ``Otros``, estimates for what has no margin."""
    _, lines = _tenant_lines(spark, d)
    return lines.groupBy("store_id", "product", "category", F.date_format("sale_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").cast("double").alias("units"),
        F.sum("total").cast("double").alias("revenue"), F.avg("margin_pct").alias("margin"), F.min("sale_date").alias("first_day"))


@register("tenant_row_order", f"""
WITH {TENANT_SQL}
SELECT store_id, count(*) AS lines, 2 AS first_row, count(*) + 1 AS last_row, count(DISTINCT sale_date) AS days,
       true AS by_date, 2 AS rejected_files
FROM t GROUP BY 1""")
def q_tenant_row_order(spark, d):
    """Rows of the consolidated files are numbered without gaps, by date; what no job can use is listed."""
    landing, lines = _tenant_lines(spark, d)
    bad = L.rejected(landing).select("path").union(
        L.mappings(landing.files).where(F.size("missing") > 0).select("path")).count()
    days = lines.groupBy("store_id", "sale_date").agg(F.min("row_seq").alias("a"), F.max("row_seq").alias("b"),
                                                      F.count(F.lit(1)).alias("n"))
    # a day's rows are consecutive: no day's range reaches into another's
    whole = days.groupBy("store_id").agg(
        F.sum("n").alias("lines"), F.min("a").cast("int").alias("first_row"), F.max("b").alias("last_row"),
        F.count(F.lit(1)).alias("days"), F.sum(F.col("b") - F.col("a") + 1).alias("_covered"),
        F.corr(F.datediff("sale_date", F.lit("1970-01-01").cast("date")), "a").alias("_up"))
    return whole.select("store_id", "lines", "first_row", "last_row", "days",
                        ((F.col("_covered") == F.col("lines")) & (F.col("_up") > 0)).alias("by_date"),
                        F.lit(bad).alias("rejected_files"))


@register("landing_consolidated", f"""
WITH {TENANT_SQL},
x AS (SELECT *, sale_date < DATE '1998-06-01' AS in_csv, sale_date >= DATE '1997-06-01' AS in_xls FROM t)
SELECT store_id, count(*) FILTER (WHERE in_csv) AS csv_rows, count(*) FILTER (WHERE in_xls) AS xls_rows, count(*) AS lines,
       CAST(sum(total) AS DOUBLE) AS revenue, true AS dense
FROM x GROUP BY 1""")
def q_landing_consolidated(spark, d):
    """CSV and SpreadsheetML exports of one store that overlap by a year, in the same load: each line once."""
    base = _base(spark, d, "landing_exports")
    rows = _numbered_text(spark, d)
    _write_csv(rows.where("Fecha < '1998-06-01'").select("store_id", *[F.col(f"`{c}`") for c in QI.POS]), f"{base}/csv")
    late = F.date_format("day", "yyyy-MM-dd") >= "1997-06-01"
    _sheets(B.numbered_export_lines(spark, d).where(late), f"{base}/xls")
    landing = L.scan(spark, [f"{base}/csv", f"{base}/xls"], prefix="part-")
    raw = L.canonical_rows(landing, L.mappings(landing.files), _store_of_path())
    raw = raw.drop("source_file")  # the file's number is in the row's place
    once = N.typed_pos(N.consolidate(raw, ("row_pos",))).groupBy("store_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("total").cast("double").alias("revenue"))
    kind = F.when(F.col("path").contains("/xls/"), "xls").otherwise("csv")
    per_file = landing.rows.where("row_no > 1").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("row_no").alias("last"))
    per_store = per_file.groupBy(_store_of_path().alias("store_id")).agg(
        F.sum(F.when(kind == "csv", F.col("n")).otherwise(0)).alias("csv_rows"),
        F.sum(F.when(kind == "xls", F.col("n")).otherwise(0)).alias("xls_rows"),
        F.bool_and(F.col("last") == F.col("n") + 1).alias("dense"))
    return once.join(per_store, "store_id")


@register("discarded_rows", with_ctes(O.raw_a(), O.typed_a(), body="""
SELECT t.store_id, t.row_seq AS fila_original, r."Fecha" AS fecha, r."Cantidad" AS cantidad, r."Total" AS total_txt, t.motivo_descarte
FROM typed_a t JOIN raw_a r ON r.store_id = t.store_id AND r.row_seq = t.row_seq WHERE t.motivo_descarte <> ''"""))
def q_discarded_rows(spark, d):
    """Discarded rows as they came, with their row number in the store's export."""
    _, discarded, _ = clean.sanitize(B.raw_pos_lines_plan(spark, d))  # read once: not written
    return discarded.select("store_id", "fila_original", F.col("Fecha").alias("fecha"), F.col("Cantidad").alias("cantidad"),
                            F.col("Total").alias("total_txt"), "motivo_descarte")


# ── per-store configuration (P9, P19, A15, A39, A41, A45, A47) ─────────────

# What the test stores set: a map and limits of its own, a fixed map, nothing, and a value that can't be read.
_TEST_MAP = {"STANDARD": "Normal", "SMALL": "Chico", "MEDIUM": "Medio", "LARGE": "Grande"}


def _configs(spark):
    import json

    given = {
        "S0": {"category_normalization": json.dumps(_TEST_MAP), "pareto_threshold": "50", "top_n_products": "3",
               "min_single_ticket_orders": "1", "nonsense": "1"},
        "S1": {"category_normalization": "report", "pareto_threshold": "90.5", "anomaly_std_threshold": "1.0"},
        "S2": {"top_n_products": "many", "ticket_bins": "[0, 100000, 1000000]", "ticket_labels": '["low", "high"]'},
    }
    specs = spark.createDataFrame([(s, c) for s, c in given.items()], "store_id string, tenant_config map<string,string>")
    return JS.store_configs(specs)


def _first_word(lines):
    """Binding A with the first word of the part type as the raw category."""
    return lines.withColumn("category_raw", F.split("category_raw", " ")[0])


_CATEGORY_SQL = (
    "CASE WHEN store_id = 'S0' THEN CASE cat " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TEST_MAP.items())
    + " ELSE 'Otros' END WHEN store_id = 'S1' THEN 'Otros' ELSE cat END")


@register("config_categories", with_ctes(O.lines_a(), body=f"""
w AS (SELECT store_id, string_split(category_raw, ' ')[1] AS cat, total FROM lines_a)
SELECT store_id, {_CATEGORY_SQL} AS category, count(*) AS lines, CAST(sum(total) AS DOUBLE) AS revenue FROM w GROUP BY 1, 2"""))
def q_config_categories(spark, d):
    """Four stores' categories by their own map, a fixed map or none, in one plan."""
    lines = clean.store_categories(_first_word(B.tpch_lines_plan(spark, d)), _configs(spark))  # read once: not written
    return lines.groupBy("store_id", "category").agg(F.count(F.lit(1)).alias("lines"),
                                                     F.sum("total").cast("double").alias("revenue"))


_TOP = "CASE store_id WHEN 'S0' THEN 3 ELSE 20 END"
_THRESHOLD = "CASE store_id WHEN 'S0' THEN 50.0 WHEN 'S1' THEN 90.5 ELSE 80.0 END"


@register("config_limits", with_ctes(O.lines_a(), body=f"""
p AS (WITH {O.products_pareto()})
SELECT store_id, rank, product, revenue, cum_rev_pct, cum_rev_pct <= {_THRESHOLD} AS in_pareto,
       CAST(greatest((SELECT count(*) FROM p q WHERE q.store_id = p.store_id AND q.cum_rev_pct <= {_THRESHOLD.replace('store_id', 'p.store_id')}), 1)
            AS BIGINT) AS n_pareto
FROM p WHERE rank <= {_TOP}"""))
def q_config_limits(spark, d):
    """The best products of each store, as many and up to the share that the store asks for."""
    top = P.products_top_n(B.tpch_lines(spark, d), StoreConfigs(table=_configs(spark)))
    return top.select("store_id", "rank", "product", "revenue", "cum_rev_pct", "in_pareto", "n_pareto")


@register("config_ticket_buckets", with_ctes(O.lines_a(), body="""
ot AS (SELECT store_id, order_id, CAST(sum(total) AS DOUBLE) AS t FROM lines_a GROUP BY 1, 2),
edges AS (SELECT * FROM (VALUES ('S0', 0, '<5K', 0.0, 5000.0), ('S0', 1, '5-10K', 5000, 10000), ('S0', 2, '10-15K', 10000, 15000),
  ('S0', 3, '15-20K', 15000, 20000), ('S0', 4, '20-30K', 20000, 30000), ('S0', 5, '30-50K', 30000, 50000),
  ('S0', 6, '50K+', 50000, 200000), ('S2', 0, 'low', 0, 100000), ('S2', 1, 'high', 100000, 1000000)) e(s, bucket_ix, bucket, lo, hi)),
dom AS (SELECT st.store_id, e.bucket_ix, e.bucket, e.lo, e.hi FROM (SELECT DISTINCT store_id FROM ot) st
        JOIN edges e ON e.s = CASE st.store_id WHEN 'S2' THEN 'S2' ELSE 'S0' END)
SELECT d.store_id, CAST(d.bucket_ix AS INTEGER) AS bucket_ix, d.bucket,
       count(*) FILTER (WHERE o.t > d.lo AND o.t <= d.hi) AS count
FROM dom d JOIN ot o USING (store_id) GROUP BY 1, 2, 3"""))
def q_config_ticket_buckets(spark, d):
    """Ticket buckets by each store's own edges and labels."""
    return C.ticket_buckets(B.tpch_lines(spark, d), StoreConfigs(table=_configs(spark)))


# ── jobs from specifications (S7, N5, N6, D1, D2) ──────────────────────────

def _write_job_specs(spark, d) -> str:
    """Per store a report job, and for two an event job with a date of its own; and jobs that can't run: an unknown type, a
    file that isn't there, a mapping to a header that no file has."""
    import json

    base = _write_tenant_exports(spark, d)
    path = _base(spark, d, "specs")
    folder = {k: f"{base}/{x}/store_id=S{k}" for k, x in enumerate("abcd")}
    mapping = {"date": "FECHA VENTA", "order_id": "No. Factura", "product": "Artículo", "quantity": "Cant.", "total": "Valor Total"}
    specs = [dict(job_id=f"report-S{k}", type="report", store_id=f"S{k}", input_files=[folder[k]],
                  category_margins={"Otros": 33.0}, tenant_config={"top_n_products": "2"}) for k in range(4)]
    specs[1]["column_mapping"] = mapping
    specs += [dict(job_id=f"delta-S{k}", type="delta", store_id=f"S{k}", input_files=[folder[k]], delta_config=c) for k, c in (
        (0, {"event_date": "1997-03-01", "window_days": "30"}), (2, {"as_of": "1998-09-01", "window_days": "7"}))]
    specs += [dict(job_id="bad-type", type="forecast", store_id="S0", input_files=[folder[0]]),
              dict(job_id="bad-file", type="report", store_id="S1", input_files=[f"{base}/none.csv"]),
              dict(job_id="bad-header", type="report", store_id="S1", input_files=[folder[1]], column_mapping=mapping | {"total": "Suma"})]
    spark.createDataFrame([(json.dumps(s),) for s in specs], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


@register("job_results", f"""
WITH {TENANT_SQL},
n AS (SELECT store_id, count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT product FROM t u WHERE u.store_id = t.store_id)) AS products
      FROM t GROUP BY 1),
jobs AS (SELECT 'report-' || store_id AS job_id, store_id, 'report' AS type, rows, least(products, 2) AS top FROM n
  UNION ALL SELECT 'delta-' || store_id, store_id, 'delta', rows, 1 FROM n WHERE store_id IN ('S0', 'S2'))
SELECT job_id, store_id, type, 'succeeded' AS status, CAST(NULL AS VARCHAR) AS problem, rows AS input_rows, rows AS normalized_rows,
       CAST(0 AS BIGINT) AS discarded_rows, top AS module_rows FROM jobs
UNION ALL SELECT 'bad-type', 'S0', 'forecast', 'failed', 'unknown type forecast', NULL, NULL, NULL, NULL
UNION ALL SELECT 'bad-file', 'S1', 'report', 'failed', 'input no encontrado', NULL, NULL, NULL, NULL
UNION ALL SELECT 'bad-header', 'S1', 'report', 'failed', 'faltan columnas tras aplicar el mapeo', NULL, NULL, NULL, NULL""")
def q_job_results(spark, d):
    """Nine specs, three of which can't run: a row for each, with its counts and the rows of one module that it wrote."""
    result, modules = jobs.run_specs(spark, JS.read_job_specs(spark, _write_job_specs(spark, d)),
                                     report_modules=["products"], delta_modules=["delta_kpis"])
    shown = modules["products"].where("rank <= 2").select("store_id").unionByName(modules["delta_kpis"].select("store_id"))
    rows = shown.groupBy(F.col("store_id").alias("job_id")).agg(F.count(F.lit(1)).alias("module_rows"))
    return result.join(rows, "job_id", "left").select(
        "job_id", "store_id", "type", "status", F.regexp_extract("error", "^[^:]*", 0).alias("problem"), "input_rows",
        "normalized_rows", "discarded_rows", "module_rows")


@register("delta_order_frame", with_ctes(O.lines_a(), body=f"""
SELECT store_id, sale_date AS date, order_id, {O.R('sum(total)', 2)} AS revenue, {O.R('sum(quantity)', 2)} AS units,
       array_to_string(list_sort(list(DISTINCT product)), '|') AS products,
       array_to_string(list_sort(list(DISTINCT category)), '|') AS categories
FROM lines_a GROUP BY 1, 2, 3"""))
def q_delta_order_frame(spark, d):
    """Orders with their products and categories."""
    got = delta.order_frame(B.tpch_lines(spark, d), DeltaConfig())
    return got.select("store_id", "date", "order_id", "revenue", "units", F.array_join("products", "|").alias("products"),
                      F.array_join("categories", "|").alias("categories"))


# ── outputs: contract, payload, overwrite, entitlement (S9, S13, S15, N8, P27) ─────

_BROKEN = (("category", "null", "rank % 7 = 0"), ("revenue", "finite", "rank % 5 = 0"), ("rank", "null", "rank % 11 = 0"),
           ("in_pareto", "null", "rank % 13 = 0"))


@register("contract_checks", with_ctes(O.lines_a(), body=f"""
p AS (WITH {O.products_pareto()}),
a AS (SELECT store_id, CAST(sum(total) AS DOUBLE) AS rev, sale_date FROM lines_a GROUP BY 1, 3),
d AS (SELECT store_id, order_id, count(DISTINCT product) AS n FROM lines_a GROUP BY 1, 2)
{" UNION ALL ".join(f"SELECT store_id, 'products' AS module, '{f}' AS field, '{c}' AS \"check\", count(*) FILTER (WHERE {w}) AS violations FROM p GROUP BY 1"
                    for f, c, w in _BROKEN)}
UNION ALL SELECT store_id, 'products', 'units', 'missing', count(*) FROM p GROUP BY 1
UNION ALL SELECT store_id, 'products', 'orders', 'type', count(*) FROM p GROUP BY 1
UNION ALL SELECT store_id, 'carts', 'items[].quantity', 'null', CAST(sum(n) AS BIGINT) FROM d GROUP BY 1
UNION ALL SELECT store_id, 'carts', 'size', 'values', count(*) FILTER (WHERE n > 4) FROM d GROUP BY 1"""))
def q_contract_checks(spark, d):
    """The contract over modules broken on purpose: nulls, NaN, a column gone, one of another type, nested nulls, an enum."""
    lines = B.tpch_lines(spark, d)
    p = P.products_pareto(lines)
    broken = p.drop("units").withColumns({
        "category": F.when(F.col("rank") % 7 != 0, F.col("category")),
        "revenue": F.when(F.col("rank") % 5 == 0, float("nan")).otherwise(F.col("revenue")),
        "in_pareto": F.when(F.col("rank") % 13 != 0, F.col("in_pareto")), "orders": F.col("orders").cast("string")})
    broken = broken.withColumn("rank", F.when(F.col("rank") % 11 != 0, F.col("rank")))
    carts = lines.groupBy("store_id", "order_id").agg(F.collect_set(F.struct(
        "product", F.lit(None).cast("double").alias("quantity"))).alias("items")).withColumn("size", F.size("items"))
    cart = (contract.Field("items", "list", fields=(contract.Field("product", "string"), contract.Field("quantity"))),
            contract.Field("size", values=(1, 2, 3, 4)))
    return contract.check(broken, "products").unionByName(contract.check(carts, "carts", cart)).where("violations > 0")


_PARTS = "report-summary report-products report-interactive_base delta-meta delta-orders".split()


@register("payload_parts", with_ctes(O.lines_a(), body="""
n AS (SELECT store_id, count(*) AS lines, count(DISTINCT product) AS products,
             (SELECT count(*) FROM (SELECT DISTINCT sale_date, order_id FROM lines_a b WHERE b.store_id = a.store_id)) AS orders
      FROM lines_a a GROUP BY 1),
parts AS (SELECT store_id, unnest([{'part': 'report-summary', 'n': 1}, {'part': 'report-products', 'n': products},
  {'part': 'report-interactive_base', 'n': lines}, {'part': 'delta-meta', 'n': 1}, {'part': 'delta-orders', 'n': orders}], recursive := true)
  FROM n)
SELECT store_id, part, n AS n_rows, CAST(ceil(n / 1000.0) AS BIGINT) AS records, true AS whole FROM parts"""))
def q_payload_parts(spark, d):
    """Both report types' payloads as ordered records of at most 1,000 rows, written as gzip JSON lines and read back."""
    lines = B.tpch_lines(spark, d)
    frame = {"report-summary": (S.summary(lines), []), "report-products": (P.products_pareto(lines), [F.col("rank")]),
             "report-interactive_base": (SL.interactive_base(lines.select("*")), [F.col("date_str"), F.col("order_id"), F.col("product")]),
             "delta-meta": (delta.meta(lines, DeltaConfig()), []),
             "delta-orders": (delta.order_frame(lines, DeltaConfig()), [F.col("date"), F.col("order_id")])}
    path = _base(spark, d, "payload_parts")
    SK.write_payload(SK.payload_records({n: frame[n] for n in _PARTS}, chunk=1000), path)
    back = spark.read.text(path).select("store_id", F.from_json(
        "value", "part string, seq bigint, n_rows int, value string").alias("r")).select("store_id", "r.*")
    held = back.withColumn("rows", F.json_array_length("value"))
    return held.groupBy("store_id", "part").agg(
        F.sum("rows").alias("n_rows"), F.count(F.lit(1)).alias("records"),
        (F.bool_and((F.col("rows") == F.col("n_rows")) & (F.col("rows") <= 1000)) & (F.max("seq") == F.count(F.lit(1)) - 1)
         ).alias("whole"))


@register("saved_map_overwrite", f"""
WITH wl AS ({QI.WL_SQL}),
m AS (SELECT store_id, sistema, CASE WHEN trim(categoria) = '' THEN 'Otros' ELSE trim(categoria) END AS categoria,
             CASE WHEN margen_pct IS NULL THEN NULL ELSE {O.R('least(greatest(CAST(margen_pct AS DOUBLE), 0.0), 99.0)', 2)} END AS margen_pct
      FROM wl)
SELECT store_id, sistema, CASE WHEN store_id = 'S1' THEN 'Nueva' ELSE categoria END AS categoria, margen_pct FROM m
WHERE store_id <> 'S1' OR length(sistema) % 2 = 0""")
def q_saved_map_overwrite(spark, d):
    """The saved maps of all stores, then one store's rows written again: fewer, and with another category."""
    rows = IG.saved_map_rows(QI._worklist(spark, d)).drop("subcategoria")
    path = _base(spark, d, "saved_maps")
    rows.write.mode("overwrite").partitionBy("store_id").parquet(path)
    again = spark.read.schema(rows.schema).parquet(path).where("store_id = 'S1' and length(sistema) % 2 = 0")
    SK.replace_stores(B.written(again.withColumn("categoria", F.lit("Nueva")), "again"), path)
    return spark.read.schema(rows.schema).parquet(path).select("store_id", "sistema", "categoria", "margen_pct")


@register("entitled_rows", with_ctes(O.lines_a(), body="""
t AS (SELECT * FROM (VALUES ('S0', 'free'), ('S1', 'pro'), ('S2', 'premium')) v(store_id, tier)),
m AS (SELECT * FROM (VALUES ('free', 'products'), ('free', 'timeline'), ('pro', 'products'), ('pro', 'timeline'), ('pro', 'anomalies'),
      ('premium', 'products'), ('premium', 'timeline'), ('premium', 'anomalies'), ('premium', 'profitability')) v(tier, module)),
rows AS (SELECT store_id, 'products' AS module, count(DISTINCT product) AS n FROM lines_a GROUP BY 1
  UNION ALL SELECT store_id, 'timeline', count(DISTINCT sale_date) FROM lines_a GROUP BY 1
  UNION ALL SELECT store_id, 'profitability', count(DISTINCT product) FILTER (WHERE margin_pct IS NOT NULL) FROM lines_a GROUP BY 1)
SELECT r.store_id, r.module, r.n AS rows, CAST(0 AS BIGINT) AS leaked FROM rows r JOIN t USING (store_id) JOIN m ON m.tier = t.tier AND m.module = r.module"""))
def q_entitled_rows(spark, d):
    """The module rows that each store's plan lets it see, and the proof that no other is in the output."""
    lines = B.tpch_lines(spark, d)
    tiers = spark.createDataFrame([("S0", "free"), ("S1", "pro"), ("S2", "premium")], "store_id string, tier string")
    modules = {"products": P.products_pareto(lines), "timeline": TL.daily(lines), "profitability": PF.profitability(lines)}
    rows = [df.select("store_id", F.lit(n).alias("module"), F.to_json(F.struct("*")).alias("row")) for n, df in modules.items()]
    shown = B.written(G.entitled(reduce(lambda a, b: a.unionByName(b), rows), tiers, F.col("module")), "entitled")
    bad = G.leaked(shown, tiers, F.col("module")).groupBy("store_id", "module").agg(F.count(F.lit(1)).alias("leaked"))
    return shown.groupBy("store_id", "module").agg(F.count(F.lit(1)).alias("rows")).join(
        bad, ["store_id", "module"], "left").na.fill(0, ["leaked"])


# ── normalized exports and event headers (S12, P2, P20) ────────────────────

@register("normalized_written", f"""
WITH {TENANT_SQL}
SELECT store_id, strftime(sale_date, '%b') AS month, {O.DAYS_SQL}[isodow(sale_date)] AS weekday, count(*) AS lines,
       CAST(sum(quantity) AS DOUBLE) AS units, CAST(sum(total) AS DOUBLE) AS revenue FROM t GROUP BY 1, 2, 3""")
def q_normalized_written(spark, d):
    """The tenants' normalized exports written as CSV per store and read back."""
    landing = L.scan(spark, _write_tenant_exports(spark, d))
    rows = L.canonical_rows(landing, L.mappings(landing.files), _store_of_path())
    text = ReportJob(spark).normalize(rows, _tenant_map(spark, d))
    path = _base(spark, d, "normalized")
    SK.write_normalized(text, path, fmt="csv")
    back = spark.read.option("header", True).csv(path)
    assert back.columns[:15] == ["row_seq", *N.OUTPUT_ORDER]
    return back.groupBy("store_id", F.col("Month").alias("month"), F.col("`Week Day`").alias("weekday")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.col("Cantidad").cast("decimal(18,6)")).cast("double").alias("units"),
        F.sum(F.col("Total").cast("decimal(18,4)")).cast("double").alias("revenue"))


@register("event_headers", with_ctes(O.lines_a(), body="""
SELECT store_id, count(*) AS lines, CAST(sum(quantity) AS DOUBLE) AS units, CAST(sum(total) AS DOUBLE) AS revenue,
       count(DISTINCT subcategory) AS subcategories FROM lines_a GROUP BY 1"""))
def q_event_headers(spark, d):
    """An event export with accents, capitals and a byte order mark in its headers."""
    lines = B.tpch_lines_plan(spark, d).select(  # read once: not written
        "store_id", F.col("sale_date").alias("\ufeffFECHA"), F.col("order_id").alias("Código  Venta"), F.col("quantity").alias("CANTIDAD"),
        F.col("total").alias("Total "), F.col("product").alias("Nombre corregido"), F.col("category").alias("Categoría Real"),
        F.col("subcategory").alias("Sub Categoría Real"))
    text = clean.canonicalize_columns(lines)
    return text.groupBy("store_id").agg(
        F.count("Codigo venta").alias("lines"), F.sum("Cantidad").cast("double").alias("units"),
        F.sum("Total").cast("double").alias("revenue"), F.count_distinct("Sub Categoria Real").alias("subcategories"))
