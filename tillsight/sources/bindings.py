"""Bindings of the driver's test tables to ``sales_lines``.

Binding A — ``lineitem ⋈ orders ⋈ part``: one line per lineitem, store = customer mod
``n_stores`` (an order has one customer, so it sits in one store), product = part name
(or brand), category = part type, unit price = part retail price, line total =
extended price after discount, margin derived from the part size (null when size is a
multiple of ten, so margin coverage is partial).

Binding B — ``events`` as a POS feed: order = user + day, product = event type, one
unit per event, total = value, real hours; orders span several hours.

Both are declared lazily; the joins are ordinary equi-joins that Catalyst plans (the
``part`` side is broadcast only when its measured size is under the broadcast
threshold, otherwise sort-merge).
"""

from __future__ import annotations

import hashlib
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillsight.functions.numbering import dense_numbers
from tillsight.schema import conform
from tillsight.session import scratch_table_path, shuffles_removed

N_STORES = 4


_TABLES: dict[tuple[int, str], DataFrame] = {}
_LOCK = threading.RLock()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of one driver table.  The DataFrame (not its data) is memoized per
    session and path, so file listing and footer schema discovery happen once."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (id(spark._jsparkSession), path)
    df = _TABLES.get(key)
    if df is None:
        df = _TABLES[key] = spark.read.parquet(path)
    return df


def materialized(spark: SparkSession, key: str, build) -> DataFrame:
    """Write ``build()`` once per session as parquet under the shared checkpoint folder
    and return a scan of it.

    The written table cuts lineage (a lost executor re-reads files instead of
    recomputing the join), lets every downstream operator prune columns and push
    filters into the scan, and is sorted within files by (store, date) so row-group
    statistics prune per store and per date range.  No repartition: a hot store spreads
    over all writer tasks instead of landing in one.
    """
    app = spark.sparkContext.applicationId
    mkey = (id(spark._jsparkSession), "materialized:" + key)
    with _LOCK:  # concurrent module jobs never build the same intermediate twice
        return _materialize_locked(spark, app, key, mkey, build)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder, in a place of its own, and scan it.

    What was shuffled for it goes at once: the table stands in for it.
    """
    path = scratch_table_path(df.sparkSession, f"{df.sparkSession.sparkContext.applicationId}/w{uuid.uuid4().hex}_{name}")
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _materialize_locked(spark: SparkSession, app: str, key: str, mkey, build) -> DataFrame:
    df = _TABLES.get(mkey)
    if df is None:
        safe = "".join(ch if ch.isalnum() else "_" for ch in key)[-60:]
        digest = hashlib.sha1(key.encode()).hexdigest()[:12]
        # never start a directory name with "_" or ".": Spark's file listing hides those
        path = scratch_table_path(spark, f"{app}/m{digest}_{safe.strip('_')}")
        src = build()
        sort_cols = [c for c in ("store_id", "sale_date") if c in src.columns]
        # Row groups are the unit a scan can split at: a size well under the split size
        # lets every core read its share without a repartition shuffle before the write.
        rg = int(spark.conf.get("spark.tillsight.materialize.rowGroupBytes", str(64 << 20)))
        (src.sortWithinPartitions(*sort_cols) if sort_cols else src).write.mode("overwrite").option(
            "parquet.block.size", rg).parquet(path)
        df = _TABLES[mkey] = spark.read.parquet(path)
    return df


#: Order of binding A's lines within a sale date: a total order of ``lineitem``.
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def numbered_lines(spark: SparkSession, sf_dir: str, n_stores: int = N_STORES) -> DataFrame:
    """Lines with their order's store and time, and ``row_seq``: a line's number in its store by sale date, then :data:`LINE_KEY`.

    This is the row order of a consolidated export, which is sorted by date.  ``lineitem`` and ``orders`` are joined and
    dealt out once per session, in narrow rows; every binding of the lines joins its columns of ``part`` to them.  A line
    without a whole key is counted, but isn't returned; lines that agree in the key each come with all their numbers.
    """
    key = (id(spark._jsparkSession), f"{sf_dir}|numbered|{n_stores}")
    with _LOCK:
        if key not in _TABLES:
            _TABLES[key] = _numbered_lines(spark, sf_dir, n_stores)
        return _TABLES[key]


def _joined_lines(spark: SparkSession, sf_dir: str, n_stores: int) -> DataFrame:
    """``lineitem`` with its orders, and ``_same``: how many lines have the line's key.

    Both sides are dealt by order, and counted there in the order that the join needs: neither is moved or sorted again.
    """
    n = F.count(F.lit(1))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    o = o.withColumn("_n_orders", n.over(Window.partitionBy("o_orderkey")))
    li = table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_discount").repartition("l_orderkey")
    li = li.withColumn("_n_lines", n.over(Window.partitionBy(*LINE_KEY)))
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        _store(n_stores), "o_orderdate", *LINE_KEY, "l_discount", (F.col("_n_lines") * F.col("_n_orders")).alias("_same"))


def plain_lines(spark: SparkSession, sf_dir: str, n_stores: int = N_STORES) -> DataFrame:
    """The rows of :func:`numbered_lines` without their numbers, for what reads none: lines are neither sorted by day nor written."""
    rows = _joined_lines(spark, sf_dir, n_stores).dropna(subset=list(LINE_KEY))
    # k equal lines each come with k numbers
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.col("_same").cast("int"))).alias("_k")).drop("_same", "_k")


def _numbered_lines(spark: SparkSession, sf_dir: str, n_stores: int) -> DataFrame:
    lines = _joined_lines(spark, sf_dir, n_stores)
    day = F.col("o_orderdate").cast("date")
    rows = dense_numbers(lines, ["store_id"], [day, *[F.col(c) for c in LINE_KEY]])
    rows = rows.dropna(subset=list(LINE_KEY))
    once, equal = rows.where("_same = 1").drop("_same"), rows.where("_same > 1").drop("_same")
    if equal.isEmpty():
        return once
    return once.unionByName(equal.drop("row_seq").join(equal.select(*LINE_KEY, "row_seq"), list(LINE_KEY)).select(*once.columns))


def _store(n_stores: int):
    return F.concat(F.lit("S"), (F.col("o_custkey") % n_stores).cast("string")).alias("store_id")


def tpch_lines(spark: SparkSession, sf_dir: str, product_col: str = "p_name", n_stores: int = N_STORES) -> DataFrame:
    """Binding A, materialized once per session (see :func:`materialized`)."""
    return materialized(spark, f"{sf_dir}|A|{product_col}|{n_stores}",
                        lambda: tpch_lines_plan(spark, sf_dir, product_col, n_stores))


def event_lines(spark: SparkSession, sf_dir: str, n_stores: int = N_STORES) -> DataFrame:
    """Binding B, materialized once per session."""
    return materialized(spark, f"{sf_dir}|B|{n_stores}", lambda: event_lines_plan(spark, sf_dir, n_stores))


def tpch_lines_plan(spark: SparkSession, sf_dir: str, product_col: str = "p_name", n_stores: int = N_STORES) -> DataFrame:
    """Binding A (see module doc) as a lazy plan."""
    li = numbered_lines(spark, sf_dir, n_stores)
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return conform(j.select(
        "store_id",
        "row_seq",
        F.col("o_orderdate").cast("date").alias("sale_date"),
        F.hour("o_orderdate").alias("sale_hour"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col(product_col).alias("product"),
        F.col("p_name").alias("product_raw"),
        F.col("p_type").alias("category_raw"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("subcategory"),
        F.col("l_quantity").cast("decimal(18,6)").alias("quantity"),
        F.col("p_retailprice").cast("decimal(18,4)").alias("unit_price"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("total"),
        F.when(F.col("p_size") % 10 == 0, F.lit(None)).otherwise(F.col("p_size") + 20).cast("double").alias("margin_pct"),
    ))


def event_lines_plan(spark: SparkSession, sf_dir: str, n_stores: int = N_STORES) -> DataFrame:
    """Binding B (see module doc) as a lazy plan."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    d = F.col("ts").cast("date")
    return conform(e.select(
        F.concat(F.lit("S"), (F.col("user_id") % n_stores).cast("string")).alias("store_id"),
        F.col("event_id").alias("row_seq"),
        d.alias("sale_date"),
        F.hour("ts").alias("sale_hour"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format(d, "yyyy-MM-dd")).alias("order_id"),
        F.col("event_type").alias("product"),
        F.col("event_type").alias("category"),
        F.lit(1).cast("decimal(18,6)").alias("quantity"),
        F.col("value").cast("decimal(18,4)").alias("unit_price"),
        F.col("value").cast("decimal(18,4)").alias("total"),
        F.when(F.col("event_id") % 10 == 0, F.lit(None)).otherwise(F.col("event_id") % 50 + 10).cast("double").alias("margin_pct"),
    ))


def raw_pos_lines(spark: SparkSession, sf_dir: str, n_stores: int = N_STORES) -> DataFrame:
    return materialized(spark, f"{sf_dir}|rawA|{n_stores}", lambda: raw_pos_lines_plan(spark, sf_dir, n_stores))


def raw_pos_lines_plan(spark: SparkSession, sf_dir: str, n_stores: int = N_STORES, numbered: bool = True) -> DataFrame:
    """Binding A rendered as a raw all-text POS export with deterministic bad values.

    Used by the cleaning operators (coercion, discard reasons, margin parsing): some
    dates, quantities, totals, hours, products and margins are made unparsable or blank
    by key, so every discard reason and both margin outcomes occur.  ``numbered`` = False leaves out ``row_seq``, for
    what counts rows and doesn't place them.
    """
    li = (numbered_lines if numbered else plain_lines)(spark, sf_dir, n_stores)
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    j = li.join(p, li.l_partkey == p.p_partkey)
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    date_txt = F.date_format("o_orderdate", "yyyy-MM-dd")
    hour_txt = F.format_string("%d:%02d:00 %s", (F.col("l_linenumber") % 12) + 1, F.col("l_partkey") % 60,
                               F.when(F.col("l_orderkey") % 2 == 0, F.lit("AM")).otherwise(F.lit("PM")))
    total_txt = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").cast("string")
    margin_txt = (
        F.when(k % 11 == 0, F.lit(""))
        .when(k % 13 == 0, F.lit("abc"))
        .when(k % 3 == 0, F.format_string("%d,5%%", F.col("p_size") + 20))
        .when(k % 3 == 1, F.format_string("%d%%", F.col("p_size") + 20))
        .otherwise(F.format_string("%d.25", F.col("p_size") + 20))
    )
    return j.select(
        "store_id",
        *([(F.col("row_seq") + 2).alias("row_seq")] if numbered else []),  # a file's first row is its header
        F.when(k % 101 == 0, F.lit("31/31/1999")).otherwise(date_txt).alias("Fecha"),
        F.when(k % 103 == 0, F.lit("xx")).otherwise(hour_txt).alias("Hora"),
        F.when(k % 107 == 0, F.lit(None)).otherwise(F.col("l_orderkey").cast("string")).alias("Código venta"),
        F.col("p_name").alias("Producto"),
        F.when(k % 109 == 0, F.lit(None)).otherwise(F.col("p_name")).alias("Nombre Corregido"),
        F.col("p_type").alias("Categoria Real"),
        F.when(k % 113 == 0, F.lit("n/a")).otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("Cantidad"),
        F.col("p_retailprice").cast("decimal(18,2)").cast("string").alias("Individual"),
        F.when(k % 127 == 0, F.lit("")).otherwise(total_txt).alias("Total"),
        margin_txt.alias("margin_pct"),
    )


def _stores(n_stores: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n_stores - 1))).alias("_s")


def derived_product_map(spark: SparkSession, sf_dir: str, n_stores: int = N_STORES) -> DataFrame:
    return materialized(spark, f"{sf_dir}|map|{n_stores}", lambda: derived_product_map_plan(spark, sf_dir, n_stores))


def derived_product_map_plan(spark: SparkSession, sf_dir: str, n_stores: int = N_STORES) -> DataFrame:
    """A product map built from ``part`` that exercises every enrichment branch.

    Per part name (``L`` = its length): an undated price-agnostic row unless ``L % 11 == 0``
    (those names stay unmapped); a dated agnostic row (1998-01-01) when ``L % 3 == 0``; a
    priced tracking row (same name, lowest price) when ``L % 5 == 0``; two priced
    variants with different names (lowest and highest price, dated 1998-01-01) when
    ``L % 7 == 0`` — those names are split products.  Replicated for every store.
    """
    part = table(spark, sf_dir, "part")
    names = part.groupBy("p_name").agg(
        F.min("p_type").alias("cat"), F.min("p_brand").alias("sub"),
        F.min("p_retailprice").alias("pmin"), F.max("p_retailprice").alias("pmax"))
    L = F.length("p_name")
    up = F.upper("p_name")
    cutoff = F.lit("1998-01-01").cast("date")
    none_price = F.lit(None).cast("decimal(18,4)")
    none_date = F.lit(None).cast("date")

    def rows(cond, seq, price, date, nombre, cat, margin):
        return names.filter(cond).select(
            F.col("p_name").alias("sistema"), price.cast("decimal(18,4)").alias("precio_post"), date.alias("fecha_desde"),
            nombre.alias("nombre"), cat.alias("categoria"), F.col("sub").alias("subcategoria"),
            margin.cast("double").alias("margen_pct"), F.lit(seq).cast("bigint").alias("map_seq"))

    m = (rows(L % 11 != 0, 1, none_price, none_date, up, F.col("cat"), L + 20)
         .unionByName(rows(L % 3 == 0, 2, none_price, cutoff, F.concat(up, F.lit(" V2")), F.lit("Renovado"), F.lit(35)))
         .unionByName(rows(L % 5 == 0, 3, F.col("pmin"), none_date, up, F.col("cat"), F.lit(50)))
         .unionByName(rows(L % 7 == 0, 4, F.col("pmin"), cutoff, F.concat(up, F.lit(" CHICO")), F.col("cat"), F.lit(40)))
         .unionByName(rows(L % 7 == 0, 5, F.col("pmax"), cutoff, F.concat(up, F.lit(" GRANDE")), F.col("cat"), F.lit(45))))
    return m.select(_stores(n_stores), "*").select(F.concat(F.lit("S"), F.col("_s").cast("string")).alias("store_id"), *m.columns)


def pos_sales(spark: SparkSession, sf_dir: str, n_stores: int = N_STORES) -> DataFrame:
    return materialized(spark, f"{sf_dir}|posA|{n_stores}", lambda: pos_sales_plan(spark, sf_dir, n_stores))


def pos_sales_plan(spark: SparkSession, sf_dir: str, n_stores: int = N_STORES) -> DataFrame:
    """Binding A before enrichment: typed POS lines keyed by the raw product name.  No step of it reads a row number."""
    li = plain_lines(spark, sf_dir, n_stores)
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select(
        "store_id",
        F.col("o_orderdate").cast("date").alias("sale_date"),
        F.hour("o_orderdate").alias("sale_hour"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("p_name").alias("product_raw"),
        F.col("l_quantity").cast("decimal(18,6)").alias("quantity"),
        F.col("p_retailprice").cast("decimal(18,4)").alias("unit_price"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("total"),
    )


def overlapping_exports(spark: SparkSession, sf_dir: str, n_stores: int = N_STORES) -> DataFrame:
    """Two raw POS exports of binding A that overlap by one year (source rank 1: orders
    before 1998-06-01; rank 2: orders from 1997-06-01), unioned as text."""
    text = pos_export_text(spark, sf_dir, n_stores)
    e1 = text.filter(F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp_ntz")).withColumn("source_rank", F.lit(1))
    e2 = text.filter(F.col("o_orderdate") >= F.lit("1997-06-01").cast("timestamp_ntz")).withColumn("source_rank", F.lit(2))
    return e1.unionByName(e2).drop("o_orderdate")


def pos_export_text(spark: SparkSession, sf_dir: str, n_stores: int = N_STORES) -> DataFrame:
    """Every line of binding A once, as raw POS export text (plus ``o_orderdate`` and a
    ``row_pos`` struct giving a total order inside an export)."""
    o = table(spark, sf_dir, "orders").select(_store(n_stores), "o_orderkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    lines = li.join(o, li.l_orderkey == o.o_orderkey).select("*", F.struct(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("row_pos"), *_line_amounts())
    return export_text(_export_lines(spark, sf_dir, lines, "row_pos"), "o_orderdate", "row_pos")


def numbered_export_text(spark: SparkSession, sf_dir: str, n_stores: int = N_STORES) -> DataFrame:
    """:func:`pos_export_text` of the numbered lines, with ``row_seq`` instead of ``o_orderdate`` and ``row_pos``."""
    return export_text(numbered_export_lines(spark, sf_dir, n_stores), "row_seq")


def pos_export_lines(spark: SparkSession, sf_dir: str, n_stores: int = N_STORES) -> DataFrame:
    """The lines of :func:`pos_export_text` in the narrow columns that :func:`export_text` makes text of."""
    o = table(spark, sf_dir, "orders").select(_store(n_stores), "o_orderkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", *_line_amounts())
    return _export_lines(spark, sf_dir, li.join(o, li.l_orderkey == o.o_orderkey)).drop("o_orderdate")


def numbered_export_lines(spark: SparkSession, sf_dir: str, n_stores: int = N_STORES) -> DataFrame:
    """The lines of :func:`numbered_export_text` in the narrow columns that :func:`export_text` makes text of."""
    lines = numbered_lines(spark, sf_dir, n_stores)
    lines = lines.select("row_seq", "store_id", "o_orderdate", "l_orderkey", "l_partkey", "l_linenumber", *_line_amounts())
    return _export_lines(spark, sf_dir, lines, "row_seq").drop("o_orderdate")


#: What a line must have so that each of its cells has a text.
EXPORT_VALUES = ("day", "l_orderkey", "minute", "p_name", "units", "price", "total")


def _line_amounts():
    return [F.col("l_quantity").cast("bigint").alias("units"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("total")]


def _export_lines(spark: SparkSession, sf_dir: str, lines: DataFrame, *kept: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    return lines.join(p, lines.l_partkey == p.p_partkey).select(
        *kept, "store_id", "o_orderdate", F.col("o_orderdate").cast("date").alias("day"), "l_orderkey", "l_linenumber",
        (F.col("l_partkey") % 60).alias("minute"), "p_name", "units", F.col("p_retailprice").cast("decimal(18,2)").alias("price"),
        "total")


def export_text(lines: DataFrame, *kept: str) -> DataFrame:
    """Lines (see :func:`pos_export_lines`) as raw POS export text, with the columns ``kept``."""
    minute = F.col("minute").cast("string")
    return lines.select(
        *kept,
        "store_id",
        F.date_format("day", "yyyy-MM-dd").alias("Fecha"),
        F.concat(F.coalesce(((F.col("l_linenumber") % 12) + 1).cast("string"), F.lit("null")), F.lit(":"),
                 F.lpad(minute, F.greatest(F.lit(2), F.length(minute)), F.lit("0")),
                 F.when(F.col("l_orderkey") % 2 == 0, F.lit(":00 AM")).otherwise(F.lit(":00 PM"))).alias("Hora"),
        F.col("l_orderkey").cast("string").alias("Código venta"),
        F.col("p_name").alias("Producto"),
        F.col("units").cast("string").alias("Cantidad"),
        F.col("price").cast("string").alias("Individual"),
        F.col("total").cast("string").alias("Total"),
    )


def category_margins(spark: SparkSession, sf_dir: str, n_stores: int = N_STORES) -> DataFrame:
    """Per-store category margin estimates derived from part types: 25 + length(type)."""
    t = table(spark, sf_dir, "part").select(F.col("p_type").alias("category")).distinct()
    t = t.select(_stores(n_stores), "category", (F.length("category") + 25).cast("double").alias("margin_pct"))
    return t.select(F.concat(F.lit("S"), F.col("_s").cast("string")).alias("store_id"), "category", "margin_pct")
