"""DuckDB oracle SQL for the registered queries.

Each oracle rebuilds the same binding of the test tables to ``sales_lines`` (CTE
``lines_a`` / ``lines_b``) and computes the query independently in SQL.  Conventions
that keep both engines bit-identical:

* money is summed as DECIMAL and cast to DOUBLE afterwards;
* ``R(x, k)`` rounds like Spark's ``round(double)`` (shortest decimal text, half up);
* truncation (Python ``int``) is ``trunc`` — a DuckDB cast would round;
* every ordering has a final key, so no output depends on an unbroken tie.
"""

from __future__ import annotations


def R(x: str, k: int) -> str:
    """Spark-compatible rounding of a double expression."""
    return f"round(CAST(CAST(CAST(({x}) AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18)), {k})::DOUBLE"


def T(x: str) -> str:
    """Python ``int(x)``: truncation toward zero, as BIGINT."""
    return f"CAST(trunc(CAST(({x}) AS DOUBLE)) AS BIGINT)"


DAYS_SQL = "['Lun','Mar','Mié','Jue','Vie','Sáb','Dom']"


def _calendar(d: str) -> str:
    return (
        f"{DAYS_SQL}[isodow({d})] AS weekday, CAST(isodow({d}) - 1 AS INTEGER) AS weekday_ix, "
        f"strftime({d}, '%G-W%V') AS year_week, strftime({d}, '%Y-%m') AS year_month"
    )


#: Number of a line of binding A in its store, by sale date, then the key of lineitem.
ROW_SEQ = """row_number() OVER (PARTITION BY o.o_custkey % 4 ORDER BY CAST(o.o_orderdate AS DATE), l.l_orderkey,
           l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice) - 1"""


def lines_a(product_col: str = "p_name", name: str = "lines_a") -> str:
    """Binding A: lineitem ⋈ orders ⋈ part (see tillsight.sources.bindings)."""
    return f"""{name} AS (
  SELECT 'S' || CAST(o.o_custkey % 4 AS VARCHAR) AS store_id,
         {ROW_SEQ} AS row_seq,
         CAST(o.o_orderdate AS DATE) AS sale_date,
         CAST(hour(o.o_orderdate) AS INTEGER) AS sale_hour,
         {_calendar('CAST(o.o_orderdate AS DATE)')},
         CAST(l.l_orderkey AS VARCHAR) AS order_id,
         p.{product_col} AS product,
         p.p_name AS product_raw,
         p.p_type AS category_raw,
         COALESCE(p.p_type, 'Otros') AS category,
         p.p_brand AS subcategory,
         CAST(l.l_quantity AS DECIMAL(18,6)) AS quantity,
         CAST(p.p_retailprice AS DECIMAL(18,4)) AS unit_price,
         CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18,4)) AS total,
         CAST(CASE WHEN p.p_size % 10 = 0 THEN NULL ELSE p.p_size + 20 END AS DOUBLE) AS margin_pct
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
)"""


def lines_b(name: str = "lines_b") -> str:
    """Binding B: events as a POS feed."""
    return f"""{name} AS (
  SELECT 'S' || CAST(e.user_id % 4 AS VARCHAR) AS store_id,
         e.event_id AS row_seq,
         CAST(e.ts AS DATE) AS sale_date,
         CAST(hour(e.ts) AS INTEGER) AS sale_hour,
         {_calendar('CAST(e.ts AS DATE)')},
         CAST(e.user_id AS VARCHAR) || '-' || strftime(CAST(e.ts AS DATE), '%Y-%m-%d') AS order_id,
         e.event_type AS product,
         e.event_type AS product_raw,
         CAST(NULL AS VARCHAR) AS category_raw,
         COALESCE(e.event_type, 'Otros') AS category,
         CAST(NULL AS VARCHAR) AS subcategory,
         CAST(1 AS DECIMAL(18,6)) AS quantity,
         CAST(e.value AS DECIMAL(18,4)) AS unit_price,
         CAST(e.value AS DECIMAL(18,4)) AS total,
         CAST(CASE WHEN e.event_id % 10 = 0 THEN NULL ELSE e.event_id % 50 + 10 END AS DOUBLE) AS margin_pct
  FROM events e
)"""


def products_pareto(src: str = "lines_a", thr: float = 80.0, where: str = "") -> str:
    return f"""
stats AS (
  SELECT store_id, product, sum(quantity) AS units_dec, sum(total) AS revenue_dec,
         count(DISTINCT order_id) AS orders, avg(unit_price) AS avg_price_dec, arg_min(category, row_seq) AS category
  FROM {src} GROUP BY store_id, product
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY store_id ORDER BY revenue_dec DESC, product) AS INTEGER) AS rank,
         sum(revenue_dec) OVER (PARTITION BY store_id ORDER BY revenue_dec DESC, product
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_dec,
         sum(revenue_dec) OVER (PARTITION BY store_id) AS store_rev_dec
  FROM stats
), shares AS (
  SELECT *, {R('CAST(cum_dec AS DOUBLE) / CAST(store_rev_dec AS DOUBLE) * 100.0', 1)} AS cum_rev_pct,
         {R('CAST(revenue_dec AS DOUBLE) / CAST(store_rev_dec AS DOUBLE) * 100.0', 2)} AS rev_share
  FROM ranked
)
SELECT store_id, rank, product, category, CAST(units_dec AS DOUBLE) AS units, CAST(revenue_dec AS DOUBLE) AS revenue,
       orders, {R('avg_price_dec', 2)} AS avg_price, cum_rev_pct, rev_share, cum_rev_pct <= {thr} AS in_pareto,
       greatest(count(*) FILTER (WHERE cum_rev_pct <= {thr}) OVER (PARTITION BY store_id), 1) AS n_pareto,
       count(*) OVER (PARTITION BY store_id) AS total_products
FROM shares""" if not where else f"""
full_pareto AS (WITH {products_pareto(src, thr)})
SELECT * FROM full_pareto {where}"""


# ---------------------------------------------------------------------------
# Reusable CTE builders (each returns "name AS (...)" items joined by commas)
# ---------------------------------------------------------------------------

def order_totals(src: str, name: str = "ot") -> str:
    return f"""{name} AS (
  SELECT store_id, order_id, count(*) AS n_lines, sum(total) AS ticket_dec, sum(quantity) AS items_dec,
         count(DISTINCT product) AS unique_products, count(DISTINCT category) AS categories
  FROM {src} GROUP BY store_id, order_id)"""


def basket(src: str, item: str = "product", min_size: int = 2, p: str = "") -> str:
    """sizes/items/tb/ic/pc CTEs (prefixed by ``p``) for pairs of ``item`` in multi-line orders."""
    return f"""{p}sizes AS (
  SELECT store_id, order_id FROM {src} GROUP BY store_id, order_id HAVING count(*) >= {min_size}
), {p}items AS (
  SELECT DISTINCT l.store_id, l.order_id, l.{item} AS item FROM {src} l JOIN {p}sizes s USING (store_id, order_id)
), {p}tb AS (
  SELECT store_id, count(*) AS total_baskets FROM {p}sizes GROUP BY store_id
), {p}ic AS (
  SELECT store_id, item, count(*) AS item_orders FROM {p}items GROUP BY store_id, item
), {p}pc AS (
  SELECT a.store_id, a.item AS item_a, b.item AS item_b, count(*) AS "count"
  FROM {p}items a JOIN {p}items b ON a.store_id = b.store_id AND a.order_id = b.order_id AND a.item < b.item
  GROUP BY a.store_id, a.item, b.item)"""


def pair_measures(pairs: str, p: str = "") -> str:
    """SELECT list source joining pairs with item counts; yields support_raw and lift_raw."""
    return f"""(SELECT x.*, t.total_baskets, ca.item_orders AS count_a, cb.item_orders AS count_b,
          CAST(x."count" AS DOUBLE) / CAST(t.total_baskets AS DOUBLE) AS support_raw,
          (CAST(x."count" AS DOUBLE) / CAST(t.total_baskets AS DOUBLE))
            / ((ca.item_orders / CAST(t.total_baskets AS DOUBLE)) * (cb.item_orders / CAST(t.total_baskets AS DOUBLE))) AS lift_raw
   FROM {pairs} x JOIN {p}tb t USING (store_id)
   JOIN {p}ic ca ON ca.store_id = x.store_id AND ca.item = x.item_a
   JOIN {p}ic cb ON cb.store_id = x.store_id AND cb.item = x.item_b)"""


def product_pairs(keep: int, p: str = "") -> str:
    """{p}pairs: top ``keep`` pairs per store with rank, support, lift."""
    return f"""{p}ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY store_id ORDER BY "count" DESC, item_a, item_b) AS INTEGER) AS rank
  FROM {p}pc QUALIFY rank <= {keep}
), {p}pairs AS (
  SELECT store_id, rank, item_a AS product_a, item_b AS product_b, "count",
         {R('support_raw', 4)} AS support, {R('lift_raw', 2)} AS lift, total_baskets
  FROM {pair_measures(f'{p}ranked', p)})"""


def rules(min_count: int, min_conf: float, top: int, p: str = "") -> str:
    """{p}rules CTE chain (needs basket CTEs with the same prefix)."""
    conf = 'CAST("count" AS DOUBLE) / count_a'
    sup_b = 'count_b / CAST(total_baskets AS DOUBLE)'
    return f"""{p}pcf AS (SELECT * FROM {p}pc WHERE "count" >= {min_count}
), {p}dir AS (
  SELECT store_id, item_a, item_b, "count" FROM {p}pcf
  UNION ALL SELECT store_id, item_b AS item_a, item_a AS item_b, "count" FROM {p}pcf
), {p}rall AS (
  SELECT store_id, item_a AS antecedent, item_b AS consequent, "count",
         {R('support_raw', 4)} AS support, {R(conf, 3)} AS confidence, {R('lift_raw', 2)} AS lift,
         COALESCE(CASE WHEN {conf} < 0.999 THEN {R(f'(1 - {sup_b}) / (1 - {conf})', 2)} END, 99.99) AS conviction,
         {R(f'{conf} * lift_raw * ln("count" + 1)', 3)} AS score
  FROM {pair_measures(f'{p}dir', p)}
), {p}rbest AS (
  SELECT * FROM {p}rall WHERE confidence >= {min_conf}
  QUALIFY row_number() OVER (PARTITION BY store_id, least(antecedent, consequent), greatest(antecedent, consequent)
                             ORDER BY score DESC, "count" DESC, confidence DESC, antecedent, consequent) = 1
), {p}rules AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY store_id ORDER BY score DESC, "count" DESC, confidence DESC, antecedent, consequent) AS INTEGER) AS rank
  FROM {p}rbest QUALIFY rank <= {top})"""


def margin_products(src: str, name: str = "mp", item: str = "product") -> str:
    return f"""{name}_g AS (
  SELECT store_id, {item} AS product, sum(quantity) AS units_dec, sum(total) AS revenue_dec,
         count(DISTINCT order_id) AS orders, avg(margin_pct) AS avg_margin, arg_min(category, row_seq) AS category
  FROM {src} GROUP BY store_id, {item}
), {name} AS (
  SELECT *, CAST(revenue_dec AS DOUBLE) * avg_margin / 100.0 AS profit FROM {name}_g WHERE avg_margin IS NOT NULL)"""


def profitability(src: str, thr: float = 80.0, name: str = "prof", item: str = "product") -> str:
    return f"""{margin_products(src, name + '_mp', item)}, {name}_w AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY store_id ORDER BY profit DESC, product) AS INTEGER) AS rank,
         {R('sum(profit) OVER (PARTITION BY store_id ORDER BY profit DESC, product ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(profit) OVER (PARTITION BY store_id) * 100.0', 1)} AS cum_profit_pct,
         {R('profit / sum(profit) OVER (PARTITION BY store_id) * 100.0', 2)} AS profit_share,
         median(CAST(orders AS DOUBLE)) OVER (PARTITION BY store_id) AS orders_median_raw,
         median(avg_margin) OVER (PARTITION BY store_id) AS margin_median_raw
  FROM {name}_mp
), {name} AS (
  SELECT store_id, rank, product, category, CAST(units_dec AS DOUBLE) AS units, CAST(revenue_dec AS DOUBLE) AS revenue,
         orders, {R('avg_margin', 4)} AS avg_margin, {R('profit', 2)} AS profit, profit AS profit_raw, cum_profit_pct, profit_share,
         cum_profit_pct <= {thr} AS in_profit_pareto,
         greatest(count(*) FILTER (WHERE cum_profit_pct <= {thr}) OVER (PARTITION BY store_id), 1) AS n_profit_pareto,
         CASE WHEN orders >= orders_median_raw AND avg_margin >= margin_median_raw THEN 'Champion'
              WHEN orders >= orders_median_raw THEN 'Tractor'
              WHEN avg_margin >= margin_median_raw THEN 'Gem' ELSE 'Niche' END AS class,
         {R('orders_median_raw', 4)} AS orders_median, {R('margin_median_raw', 4)} AS margin_median,
         margin_median_raw
  FROM {name}_w)"""


def weekday_domain(stores_sql: str) -> str:
    return f"""(SELECT s.store_id, d.weekday_ix, d.weekday FROM ({stores_sql}) s CROSS JOIN
  (SELECT CAST(i AS INTEGER) AS weekday_ix, {DAYS_SQL}[i + 1] AS weekday FROM range(7) t(i)) d)"""


def raw_a(name: str = "raw_a") -> str:
    """Binding A as an all-text POS export with deterministic bad values (see bindings.raw_pos_lines)."""
    k = "(l.l_orderkey * 7 + l.l_linenumber)"
    return f"""{name} AS (
  SELECT 'S' || CAST(o.o_custkey % 4 AS VARCHAR) AS store_id, {ROW_SEQ} + 2 AS row_seq,
         CASE WHEN {k} % 101 = 0 THEN '31/31/1999' ELSE strftime(o.o_orderdate, '%Y-%m-%d') END AS "Fecha",
         CASE WHEN {k} % 103 = 0 THEN 'xx' ELSE printf('%d:%02d:00 %s', (l.l_linenumber % 12) + 1, l.l_partkey % 60,
              CASE WHEN l.l_orderkey % 2 = 0 THEN 'AM' ELSE 'PM' END) END AS "Hora",
         CASE WHEN {k} % 107 = 0 THEN NULL ELSE CAST(l.l_orderkey AS VARCHAR) END AS "Código venta",
         p.p_name AS "Producto",
         CASE WHEN {k} % 109 = 0 THEN NULL ELSE p.p_name END AS "Nombre Corregido",
         p.p_type AS "Categoria Real",
         CASE WHEN {k} % 113 = 0 THEN 'n/a' ELSE CAST(CAST(l.l_quantity AS BIGINT) AS VARCHAR) END AS "Cantidad",
         CAST(CAST(p.p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS "Individual",
         CASE WHEN {k} % 127 = 0 THEN '' ELSE CAST(CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18,4)) AS VARCHAR) END AS "Total",
         CASE WHEN {k} % 11 = 0 THEN ''
              WHEN {k} % 13 = 0 THEN 'abc'
              WHEN {k} % 3 = 0 THEN printf('%d,5%%', p.p_size + 20)
              WHEN {k} % 3 = 1 THEN printf('%d%%', p.p_size + 20)
              ELSE printf('%d.25', p.p_size + 20) END AS margin_pct
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
)"""


def typed_a(src: str = "raw_a", name: str = "typed_a") -> str:
    mtxt = "trim(replace(replace(margin_pct, '%', ''), ',', '.'))"
    miss = f"({mtxt} IS NULL OR {mtxt} = '' OR lower({mtxt}) IN ('nan', 'none'))"
    return f"""{name}_t AS (
  SELECT store_id, row_seq,
         CAST(try_strptime(trim("Fecha"), '%Y-%m-%d') AS DATE) AS sale_date,
         CAST(hour(try_strptime(trim("Hora"), '%I:%M:%S %p')) AS INTEGER) AS sale_hour,
         CASE WHEN trim("Código venta") IN ('', 'nan') THEN NULL ELSE trim("Código venta") END AS order_id,
         CASE WHEN trim("Nombre Corregido") IN ('', 'nan') THEN NULL ELSE trim("Nombre Corregido") END AS product,
         "Categoria Real" AS category_raw,
         TRY_CAST(trim("Cantidad") AS DECIMAL(18,6)) AS quantity,
         TRY_CAST(trim("Individual") AS DECIMAL(18,4)) AS unit_price,
         TRY_CAST(trim("Total") AS DECIMAL(18,4)) AS total,
         CASE WHEN {miss} THEN NULL ELSE TRY_CAST({mtxt} AS DOUBLE) END AS margin_pct,
         CASE WHEN {miss} THEN 'missing' WHEN TRY_CAST({mtxt} AS DOUBLE) IS NULL THEN 'invalid' ELSE 'present' END AS margin_state
  FROM {src}
), {name} AS (
  SELECT *, concat_ws('; ',
      CASE WHEN sale_date IS NULL THEN 'Fecha inválida' END,
      CASE WHEN order_id IS NULL THEN 'Código de venta faltante' END,
      CASE WHEN product IS NULL THEN 'Producto faltante' END,
      CASE WHEN quantity IS NULL THEN 'Cantidad inválida' END,
      CASE WHEN total IS NULL THEN 'Total inválido' END,
      CASE WHEN sale_hour IS NULL THEN 'Hora inválida' END) AS motivo_descarte
  FROM {name}_t
), {name}_clean AS (
  SELECT store_id, row_seq, sale_date, sale_hour, {DAYS_SQL}[isodow(sale_date)] AS weekday,
         CAST(isodow(sale_date) - 1 AS INTEGER) AS weekday_ix, order_id, product, COALESCE(category_raw, 'Otros') AS category,
         quantity, unit_price, total, margin_pct,
         strftime(sale_date, '%G-W%V') AS year_week, strftime(sale_date, '%Y-%m') AS year_month
  FROM {name} WHERE motivo_descarte = ''
)"""


STORES_SQL = "(SELECT 'S' || CAST(i AS VARCHAR) AS store_id FROM range(4) t(i))"


def product_map(name: str = "pm") -> str:
    """The derived product map (see bindings.derived_product_map)."""
    up = "upper(p_name)"
    return f"""{name}_names AS (
  SELECT p_name, min(p_type) AS cat, min(p_brand) AS sub, min(p_retailprice) AS pmin, max(p_retailprice) AS pmax
  FROM part GROUP BY p_name
), {name}_rows AS (
  SELECT p_name AS sistema, CAST(NULL AS DECIMAL(18,4)) AS precio_post, CAST(NULL AS DATE) AS fecha_desde, {up} AS nombre,
         cat AS categoria, sub AS subcategoria, CAST(length(p_name) + 20 AS DOUBLE) AS margen_pct, CAST(1 AS BIGINT) AS map_seq
  FROM {name}_names WHERE length(p_name) % 11 <> 0
  UNION ALL SELECT p_name, NULL, DATE '1998-01-01', {up} || ' V2', 'Renovado', sub, 35.0, 2 FROM {name}_names WHERE length(p_name) % 3 = 0
  UNION ALL SELECT p_name, CAST(pmin AS DECIMAL(18,4)), NULL, {up}, cat, sub, 50.0, 3 FROM {name}_names WHERE length(p_name) % 5 = 0
  UNION ALL SELECT p_name, CAST(pmin AS DECIMAL(18,4)), DATE '1998-01-01', {up} || ' CHICO', cat, sub, 40.0, 4 FROM {name}_names WHERE length(p_name) % 7 = 0
  UNION ALL SELECT p_name, CAST(pmax AS DECIMAL(18,4)), DATE '1998-01-01', {up} || ' GRANDE', cat, sub, 45.0, 5 FROM {name}_names WHERE length(p_name) % 7 = 0
), {name} AS (SELECT s.store_id, r.* FROM {STORES_SQL} s CROSS JOIN {name}_rows r)"""


def pos_sales(name: str = "sales") -> str:
    return f"""{name} AS (
  SELECT 'S' || CAST(o.o_custkey % 4 AS VARCHAR) AS store_id, CAST(o.o_orderdate AS DATE) AS sale_date,
         CAST(l.l_orderkey AS VARCHAR) AS order_id, p.p_name AS product_raw,
         CAST(l.l_quantity AS DECIMAL(18,6)) AS quantity, CAST(p.p_retailprice AS DECIMAL(18,4)) AS unit_price,
         CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18,4)) AS total
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
)"""


RECENCY = "(fecha_desde IS NULL), fecha_desde DESC, CASE WHEN fecha_desde IS NOT NULL THEN -map_seq ELSE map_seq END"


def enrich_ctes() -> str:
    """split / simple / best / variants / ratios CTEs over ``sales`` and ``pm``."""
    return f"""split AS (SELECT store_id, sistema FROM pm WHERE precio_post IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT nombre) > 1
), simple AS (SELECT s.* FROM sales s ANTI JOIN split x ON x.store_id = s.store_id AND x.sistema = s.product_raw
), ssales AS (SELECT s.* FROM sales s SEMI JOIN split x ON x.store_id = s.store_id AND x.sistema = s.product_raw
), k AS (SELECT DISTINCT store_id, product_raw, unit_price, sale_date FROM simple
), cand AS (
  SELECT k.*, pm.precio_post, pm.fecha_desde, pm.nombre, pm.categoria, pm.subcategoria, pm.margen_pct, pm.map_seq,
         CASE WHEN pm.precio_post = k.unit_price THEN 0 WHEN pm.precio_post IS NULL THEN 1 ELSE 2 END AS prio
  FROM k JOIN pm ON pm.store_id = k.store_id AND pm.sistema = k.product_raw
  WHERE pm.fecha_desde IS NULL OR pm.fecha_desde <= k.sale_date
), best AS (
  SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY store_id, product_raw, unit_price, sale_date ORDER BY prio, {RECENCY}) = 1
), priced AS (SELECT pm.* FROM pm SEMI JOIN split x ON x.store_id = pm.store_id AND x.sistema = pm.sistema WHERE pm.precio_post IS NOT NULL
), variants AS (
  SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY store_id, sistema, precio_post ORDER BY {RECENCY}) = 1
), cuts AS (SELECT store_id, sistema, min(fecha_desde) AS cutoff, count(DISTINCT precio_post) AS n_variants FROM priced GROUP BY 1, 2
), post_units AS (
  SELECT s.store_id, s.product_raw AS sistema, s.unit_price AS precio_post, sum(s.quantity) AS units
  FROM sales s JOIN cuts c ON c.store_id = s.store_id AND c.sistema = s.product_raw
  WHERE s.sale_date IS NOT NULL AND (c.cutoff IS NULL OR s.sale_date >= c.cutoff) GROUP BY 1, 2, 3
), ratios AS (
  SELECT v.store_id, v.sistema, v.precio_post, v.nombre, v.categoria, v.subcategoria, v.margen_pct, c.cutoff,
         CASE WHEN sum(CAST(COALESCE(u.units, 0) AS DOUBLE)) OVER (PARTITION BY v.store_id, v.sistema) > 0
              THEN CAST(COALESCE(u.units, 0) AS DOUBLE) / sum(CAST(COALESCE(u.units, 0) AS DOUBLE)) OVER (PARTITION BY v.store_id, v.sistema)
              ELSE 1.0 / c.n_variants END AS ratio
  FROM variants v JOIN cuts c USING (store_id, sistema)
  LEFT JOIN post_units u ON u.store_id = v.store_id AND u.sistema = v.sistema AND u.precio_post = v.precio_post
), scut AS (SELECT s.*, c.cutoff FROM ssales s LEFT JOIN cuts c ON c.store_id = s.store_id AND c.sistema = s.product_raw
), pk AS (SELECT DISTINCT store_id, product_raw, unit_price, sale_date FROM scut
          WHERE sale_date IS NOT NULL AND (cutoff IS NULL OR sale_date >= cutoff)
), pbest AS (
  SELECT pk.*, p.nombre, p.categoria, p.subcategoria, p.margen_pct FROM pk JOIN priced p
    ON p.store_id = pk.store_id AND p.sistema = pk.product_raw AND p.precio_post = pk.unit_price
   AND (p.fecha_desde IS NULL OR p.fecha_desde <= pk.sale_date)
  QUALIFY row_number() OVER (PARTITION BY pk.store_id, pk.product_raw, pk.unit_price, pk.sale_date ORDER BY {RECENCY.replace('fecha_desde', 'p.fecha_desde').replace('map_seq', 'p.map_seq')}) = 1
), enriched AS (
  SELECT s.store_id, s.sale_date, s.order_id, s.product_raw, s.unit_price, s.quantity, s.total,
         COALESCE(b.nombre, s.product_raw) AS product, b.categoria AS category_raw, b.subcategoria AS subcategory, b.margen_pct AS margin_pct,
         CASE b.prio WHEN 0 THEN 'price' WHEN 1 THEN 'agnostic' WHEN 2 THEN 'any' ELSE 'unmatched' END AS match_kind
  FROM simple s LEFT JOIN best b USING (store_id, product_raw, unit_price, sale_date)
  UNION ALL
  SELECT s.store_id, s.sale_date, s.order_id, s.product_raw, s.unit_price, s.quantity, s.total,
         CASE WHEN b.nombre IS NULL THEN s.product_raw || ' (precio ' || CAST(CAST(s.unit_price AS DOUBLE) AS VARCHAR) || ')' ELSE b.nombre END,
         b.categoria, b.subcategoria, b.margen_pct, CASE WHEN b.nombre IS NULL THEN 'split_unmatched' ELSE 'split_price' END
  FROM scut s LEFT JOIN pbest b USING (store_id, product_raw, unit_price, sale_date)
  WHERE s.sale_date IS NOT NULL AND (s.cutoff IS NULL OR s.sale_date >= s.cutoff)
  UNION ALL
  SELECT s.store_id, s.sale_date, s.order_id, s.product_raw, s.unit_price,
         CAST(CAST(s.quantity AS DOUBLE) * r.ratio AS DECIMAL(18,6)), CAST(CAST(s.total AS DOUBLE) * r.ratio AS DECIMAL(18,4)),
         r.nombre, r.categoria, r.subcategoria, r.margen_pct, 'split_fanout'
  FROM scut s JOIN ratios r ON r.store_id = s.store_id AND r.sistema = s.product_raw
  WHERE s.cutoff IS NOT NULL AND s.sale_date < s.cutoff
  UNION ALL
  SELECT s.store_id, s.sale_date, s.order_id, s.product_raw, s.unit_price, s.quantity, s.total,
         s.product_raw, NULL, NULL, NULL, 'split_nodate' FROM scut s WHERE s.sale_date IS NULL
)"""


ENRICHED_COLS = ("store_id, sale_date, order_id, product_raw, CAST(unit_price AS DOUBLE) AS unit_price, "
                 "CAST(quantity AS DOUBLE) AS quantity, CAST(total AS DOUBLE) AS total, product, category_raw, "
                 "subcategory, margin_pct, match_kind")
