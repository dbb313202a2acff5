"""Registered queries of the normalization pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.operators import normalize as N
from tillsight.plans import oracle_sql as O
from tillsight.plans.oracle_sql import R
from tillsight.plans.registry import register, with_ctes
from tillsight.sources import bindings as B

ENRICH_SQL_HEAD = [O.pos_sales(), O.product_map(), O.enrich_ctes()]
_OUT = ["store_id", "sale_date", "order_id", "product_raw", "unit_price", "quantity", "total",
        "product", "category_raw", "subcategory", "margin_pct", "match_kind"]


def _enriched(spark, d):
    sales = B.pos_sales(spark, d)
    pm = N.prepare_product_map(B.derived_product_map(spark, d))
    return N.enrich(sales, pm)


def _out(df):
    return df.select(*[F.col(c).cast("double").alias(c) if c in ("unit_price", "quantity", "total") else F.col(c) for c in _OUT])


CONSOLIDATE_SQL = """
WITH ex AS (
  SELECT 'S' || CAST(o.o_custkey % 4 AS VARCHAR) AS store_id, o.o_orderdate,
         l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice,
         strftime(o.o_orderdate, '%Y-%m-%d') AS fecha,
         printf('%d:%02d:00 %s', (l.l_linenumber % 12) + 1, l.l_partkey % 60, CASE WHEN l.l_orderkey % 2 = 0 THEN 'AM' ELSE 'PM' END) AS hora,
         CAST(l.l_orderkey AS VARCHAR) AS order_id, p.p_name AS product_raw,
         CAST(CAST(l.l_quantity AS BIGINT) AS VARCHAR) AS quantity_txt,
         CAST(CAST(p.p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS unit_price_txt,
         CAST(CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18,4)) AS VARCHAR) AS total_txt
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
), both_ex AS (
  SELECT *, 1 AS source_rank FROM ex WHERE o_orderdate < TIMESTAMP '1998-06-01'
  UNION ALL SELECT *, 2 AS source_rank FROM ex WHERE o_orderdate >= TIMESTAMP '1997-06-01'
)
SELECT store_id, fecha, order_id, product_raw, unit_price_txt, hora, quantity_txt, total_txt, source_rank
FROM both_ex
QUALIFY row_number() OVER (PARTITION BY store_id, fecha, order_id, product_raw, unit_price_txt
                           ORDER BY source_rank, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1"""


@register("consolidate_dedup", CONSOLIDATE_SQL)
def q_consolidate_dedup(spark, d):
    c = N.consolidate(B.overlapping_exports(spark, d))
    return c.select("store_id", F.col("Fecha").alias("fecha"), F.col("`Código venta`").alias("order_id"),
                    F.col("Producto").alias("product_raw"), F.col("Individual").alias("unit_price_txt"),
                    F.col("Hora").alias("hora"), F.col("Cantidad").alias("quantity_txt"), F.col("Total").alias("total_txt"),
                    F.col("source_rank").cast("int").alias("source_rank"))


@register("product_map_asof", with_ctes(*ENRICH_SQL_HEAD, body=f"""
SELECT {O.ENRICHED_COLS} FROM enriched WHERE match_kind IN ('price', 'agnostic', 'any', 'unmatched')"""))
def q_product_map_asof(spark, d):
    return _out(_enriched(spark, d)).filter(F.col("match_kind").isin("price", "agnostic", "any", "unmatched"))


@register("product_unmatched", with_ctes(*ENRICH_SQL_HEAD, body="""
SELECT store_id, product AS label, match_kind, count(*) AS lines FROM enriched
WHERE match_kind IN ('unmatched', 'split_unmatched') GROUP BY 1, 2, 3"""))
def q_product_unmatched(spark, d):
    return N.unmatched_report(_enriched(spark, d))


@register("product_split_ratios", with_ctes(*ENRICH_SQL_HEAD, body=f"""
SELECT store_id, sistema, CAST(precio_post AS DOUBLE) AS precio_post, {R('ratio', 6)} AS ratio, cutoff, nombre FROM ratios"""))
def q_product_split_ratios(spark, d):
    r = N.split_ratios(B.pos_sales_plan(spark, d), N.prepare_product_map(B.derived_product_map(spark, d)))
    return r.select("store_id", "sistema", F.col("precio_post").cast("double").alias("precio_post"),
                    F.round("ratio", 6).alias("ratio"), "cutoff", "nombre")


@register("product_split_fanout", with_ctes(*ENRICH_SQL_HEAD, body=f"""
SELECT {O.ENRICHED_COLS} FROM enriched WHERE match_kind LIKE 'split%'"""))
def q_product_split_fanout(spark, d):
    return _out(_enriched(spark, d)).filter(F.col("match_kind").startswith("split"))


@register("normalize_mass_balance", with_ctes(*ENRICH_SQL_HEAD, body=f"""
a AS (SELECT store_id, CAST(sum(quantity) AS DOUBLE) AS units_in, CAST(sum(total) AS DOUBLE) AS revenue_in, count(*) AS lines_in FROM sales GROUP BY 1),
b AS (SELECT store_id, CAST(sum(quantity) AS DOUBLE) AS units_out, CAST(sum(total) AS DOUBLE) AS revenue_out, count(*) AS lines_out FROM enriched GROUP BY 1)
SELECT store_id, lines_in, lines_out, {R('units_in', 2)} AS units_in, {R('units_out', 2)} AS units_out,
       {R('revenue_in', 2)} AS revenue_in, {R('revenue_out', 2)} AS revenue_out FROM a JOIN b USING (store_id)"""))
def q_normalize_mass_balance(spark, d):
    sales = B.pos_sales(spark, d)
    e = _enriched(spark, d)
    a = sales.groupBy("store_id").agg(F.sum("quantity").cast("double").alias("ui"), F.sum("total").cast("double").alias("ri"),
                                      F.count(F.lit(1)).alias("lines_in"))
    b = e.groupBy("store_id").agg(F.sum("quantity").cast("double").alias("uo"), F.sum("total").cast("double").alias("ro"),
                                  F.count(F.lit(1)).alias("lines_out"))
    return a.join(b, "store_id").select("store_id", "lines_in", "lines_out", F.round("ui", 2).alias("units_in"),
                                        F.round("uo", 2).alias("units_out"), F.round("ri", 2).alias("revenue_in"),
                                        F.round("ro", 2).alias("revenue_out"))


@register("category_margin_fallback", with_ctes(O.lines_a(), body=f"""
cm AS (SELECT DISTINCT p_type AS category, CAST(length(p_type) + 25 AS DOUBLE) AS est FROM part),
f AS (SELECT l.store_id, l.category, l.margin_pct, COALESCE(l.margin_pct, cm.est) AS filled,
             CASE WHEN l.margin_pct IS NOT NULL THEN 'line' WHEN cm.est IS NOT NULL THEN 'category' ELSE 'none' END AS src
      FROM lines_a l LEFT JOIN cm USING (category))
SELECT store_id, category, count(*) AS lines, count(*) FILTER (WHERE src = 'line') AS line_margins,
       count(*) FILTER (WHERE src = 'category') AS filled_lines, {R('avg(filled)', 4)} AS avg_margin
FROM f GROUP BY 1, 2"""))
def q_category_margin_fallback(spark, d):
    f = N.category_margin_fallback(B.tpch_lines(spark, d), B.category_margins(spark, d))
    return f.groupBy("store_id", "category").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("margin_source") == "line").alias("line_margins"),
        F.count_if(F.col("margin_source") == "category").alias("filled_lines"), F.round(F.avg("margin_pct"), 4).alias("avg_margin"))


@register("store_category_identity", with_ctes(O.pos_sales(), body="""
SELECT s.store_id, COALESCE(p.p_type, 'Otros') AS category, s.product_raw AS product, count(*) AS lines
FROM sales s JOIN (SELECT DISTINCT p_name, min(p_type) OVER (PARTITION BY p_name) AS p_type FROM part) p ON p.p_name = s.product_raw
GROUP BY 1, 2, 3"""))
def q_store_category_identity(spark, d):
    part = B.written(B.table(spark, d, "part").groupBy("p_name").agg(F.min("p_type").alias("category_raw")), "part-types")
    lines = B.pos_sales(spark, d).join(part.withColumnRenamed("p_name", "product_raw"), "product_raw")
    out = N.enrich_by_store(lines)
    return out.groupBy("store_id", F.col("category_raw").alias("category"), "product").agg(F.count(F.lit(1)).alias("lines"))


VARIANT_MAPPING = {"date": "FECHA", "order_id": "No. Factura", "product": "Descripción", "quantity": "Cant.", "total": "Valor Total"}


@register("column_mapping", """
WITH v AS (
  SELECT 'S' || CAST(o.o_custkey % 4 AS VARCHAR) AS store_id, TRY_CAST(CAST(CAST(l.l_quantity AS BIGINT) AS VARCHAR) AS DOUBLE) AS q,
         TRY_CAST(CAST(CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18,4)) AS VARCHAR) AS DOUBLE) AS t
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
SELECT store_id, count(*) AS lines, 1 AS hours_seen,
       round(CAST(CAST(CAST(sum(CASE WHEN q <> 0 THEN t / q ELSE t END) AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18)), 2)::DOUBLE AS sum_unit_price
FROM v GROUP BY store_id""")
def q_column_mapping(spark, d):
    """An export with other headers (no time, no unit price) mapped back to the POS
    columns; time is synthesised as 00:00 and unit price as Total / Cantidad."""
    text = B.pos_export_text(spark, d).select(
        "store_id", F.col("Fecha").alias("FECHA"), F.col("Código venta").alias("No. Factura"),
        F.col("Producto").alias("Descripción"), F.col("Cantidad").alias("Cant."), F.col("Total").alias("Valor Total"))
    m = N.apply_column_mapping(text, VARIANT_MAPPING)
    return m.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("Hora").cast("int").alias("hours_seen"),
        F.round(F.sum(F.col("Individual").cast("double")), 2).alias("sum_unit_price"))


@register("map_null_price", with_ctes(O.pos_sales(), O.product_map(), body="""
s AS (SELECT store_id, product_raw, CASE WHEN CAST(order_id AS BIGINT) % 5 = 0 THEN NULL ELSE unit_price END AS price,
             CASE WHEN CAST(order_id AS BIGINT) % 7 = 0 THEN NULL ELSE sale_date END AS day FROM sales),
plain AS (SELECT * FROM s WHERE (SELECT count(DISTINCT m.nombre) FROM pm m WHERE m.store_id = s.store_id
             AND m.sistema = s.product_raw AND m.precio_post IS NOT NULL) <= 1),
best AS (SELECT p.store_id, p.product_raw, (SELECT m.nombre FROM pm m WHERE m.store_id = p.store_id AND m.sistema = p.product_raw
             AND (m.fecha_desde IS NULL OR m.fecha_desde <= p.day)
           ORDER BY CASE WHEN m.precio_post = p.price THEN 0 WHEN m.precio_post IS NULL THEN 1 ELSE 2 END,
             m.fecha_desde IS NULL, m.fecha_desde DESC, m.map_seq LIMIT 1) AS nombre FROM plain p)
SELECT store_id, product_raw, COALESCE(nombre, product_raw) AS product, nombre IS NOT NULL AS matched, count(*) AS lines
FROM best GROUP BY 1, 2, 3, 4"""))
def q_map_null_price(spark, d):
    """Map lookup of lines of which some have no price and some no date."""
    order = F.col("order_id").cast("bigint")
    sales = B.pos_sales(spark, d).withColumns({"unit_price": F.when(order % 5 != 0, F.col("unit_price")),
                                               "sale_date": F.when(order % 7 != 0, F.col("sale_date"))})
    e = N.enrich(sales, N.prepare_product_map(B.derived_product_map(spark, d)))
    e = e.where(~F.col("match_kind").startswith("split"))
    return e.groupBy("store_id", "product_raw", "product", (F.col("match_kind") != "unmatched").alias("matched")).agg(
        F.count(F.lit(1)).alias("lines"))
