"""The canonical ``sales_lines`` table every operator reads.

| column        | type          | meaning                                             |
|---------------|---------------|-----------------------------------------------------|
| store_id      | string        | leading key of every grouping / window               |
| row_seq       | bigint (null) | source row order; "first" = min_by(x, row_seq)       |
| sale_date     | date          |                                                     |
| sale_hour     | int           | 0-23                                                 |
| weekday       | string        | Lun … Dom                                            |
| weekday_ix    | int           | 0 = Monday                                           |
| order_id      | string        |                                                     |
| product       | string        | corrected product name                               |
| product_raw   | string        | POS product name                                     |
| category_raw  | string        |                                                     |
| category      | string        | normalized category, never null                      |
| subcategory   | string        |                                                     |
| quantity      | decimal(18,6) | fractional after split fan-out                       |
| unit_price    | decimal(18,4) |                                                     |
| total         | decimal(18,4) | line revenue                                         |
| margin_pct    | double (null) | null = not observed                                  |
| year_week     | string        | ISO ``YYYY-Www``                                     |
| year_month    | string        | ``YYYY-MM``                                          |

Money stays DECIMAL until aggregated, so sums are exact and independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.functions.dates import iso_year_week, weekday_es, weekday_ix, year_month

SALES_LINES_SCHEMA = T.StructType([
    T.StructField("store_id", T.StringType()),
    T.StructField("row_seq", T.LongType()),
    T.StructField("sale_date", T.DateType()),
    T.StructField("sale_hour", T.IntegerType()),
    T.StructField("weekday", T.StringType()),
    T.StructField("weekday_ix", T.IntegerType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("product_raw", T.StringType()),
    T.StructField("category_raw", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("quantity", T.DecimalType(18, 6)),
    T.StructField("unit_price", T.DecimalType(18, 4)),
    T.StructField("total", T.DecimalType(18, 4)),
    T.StructField("margin_pct", T.DoubleType()),
    T.StructField("year_week", T.StringType()),
    T.StructField("year_month", T.StringType()),
])

SALES_COLUMNS = [f.name for f in SALES_LINES_SCHEMA.fields]


def conform(df: DataFrame) -> DataFrame:
    """Derive calendar columns from ``sale_date`` and project to the canonical schema.

    Input needs store_id, sale_date, sale_hour, order_id, product, quantity, total; the
    rest default to null (category to ``Otros``).
    """
    cols = set(df.columns)

    def have(name: str, default):
        return F.col(name) if name in cols else default

    out = df.select(
        have("store_id", F.lit("S0")).cast("string").alias("store_id"),
        have("row_seq", F.lit(None)).cast("bigint").alias("row_seq"),
        F.col("sale_date").cast("date").alias("sale_date"),
        F.col("sale_hour").cast("int").alias("sale_hour"),
        weekday_es("sale_date").alias("weekday"),
        weekday_ix("sale_date").cast("int").alias("weekday_ix"),
        F.col("order_id").cast("string").alias("order_id"),
        F.col("product").cast("string").alias("product"),
        have("product_raw", F.col("product")).cast("string").alias("product_raw"),
        have("category_raw", F.lit(None)).cast("string").alias("category_raw"),
        F.coalesce(have("category", F.lit(None)).cast("string"), F.lit("Otros")).alias("category"),
        have("subcategory", F.lit(None)).cast("string").alias("subcategory"),
        F.col("quantity").cast("decimal(18,6)").alias("quantity"),
        have("unit_price", F.lit(None)).cast("decimal(18,4)").alias("unit_price"),
        F.col("total").cast("decimal(18,4)").alias("total"),
        have("margin_pct", F.lit(None)).cast("double").alias("margin_pct"),
        iso_year_week("sale_date").alias("year_week"),
        year_month("sale_date").alias("year_month"),
    )
    return out
