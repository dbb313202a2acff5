"""Market basket (A27–A32): product and category pairs, lift, A→B rules.

Plan shape, chosen for scale:

1. one ``groupBy(store, order)`` computes the line count (multi-line = at least
   ``min_basket_size`` *lines*, not distinct products) and the sorted set of distinct
   items in a single shuffle; ``collect_set`` de-duplicates map-side, so a huge order
   contributes at most one entry per distinct catalog item, never its raw lines;
2. pairs are generated per *item row* (``posexplode`` then the items after it), so one
   wide basket is spread over as many rows as it has items;
3. pair counts are a hash aggregate on (store, a, b) with map-side combine; item
   supports and basket totals are aggregates of the same basket table.

Pair output per order is bounded by (distinct items)², i.e. by the catalog, not by rows.
All joins after step 3 are on small aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.config import DEFAULT_REPORT, ReportConfig
from tillsight.operators._common import STORE, is_shared, limits, shared, top_k
from tillsight.operators.summary import order_sets


def baskets(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT, item: str = "product") -> DataFrame:
    """(store, order, basket): sorted distinct items of every multi-line order."""
    if is_shared(lines) and item == "product":
        return order_sets(lines).filter(F.col("n_lines") >= cfg.min_basket_size).select(STORE, "order_id", "basket")

    def build():
        b = lines.groupBy(STORE, "order_id").agg(
            F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_set(F.col(item))).alias("basket"))
        return b.filter(F.col("n_lines") >= cfg.min_basket_size).select(STORE, "order_id", "basket")
    return shared(lines, f"baskets_{item}_{cfg.min_basket_size}", build)


def basket_counts(bk: DataFrame) -> DataFrame:
    """One aggregation for all basket statistics: ``kind`` 0 = baskets per store,
    1 = baskets per item, 2 = baskets per item pair (a < b).

    Each basket emits one total marker, and per item one item marker plus the pairs
    with the items after it; a single hash aggregate (map-side combined) counts them."""
    per_item = bk.select(STORE, "basket", F.posexplode("basket").alias("pos", "item_a"))
    none = F.lit(None).cast("string")
    rest = F.slice("basket", F.col("pos") + 2, F.size("basket") - F.col("pos") - 1)
    marks = F.concat(
        F.array(F.struct(F.lit(1).alias("kind"), none.alias("b"))),
        F.when(F.col("pos") == 0, F.array(F.struct(F.lit(0).alias("kind"), none.alias("b")))).otherwise(
            F.array().cast("array<struct<kind:int,b:string>>")),
        F.transform(rest, lambda x: F.struct(F.lit(2).alias("kind"), x.alias("b"))),
    )
    rows = per_item.select(STORE, "item_a", F.inline(marks))
    k = rows.select(STORE, "kind", F.when(F.col("kind") > 0, F.col("item_a")).alias("item_a"), F.col("b").alias("item_b"))
    return k.groupBy(STORE, "kind", "item_a", "item_b").agg(F.count(F.lit(1)).alias("count"))


def counts_of(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT, item: str = "product") -> DataFrame:
    """:func:`basket_counts` of a line table, written: filters on ``kind`` would else be pushed below the
    aggregate and explode the pairs once for each use."""
    return shared(lines, f"basket_counts_{item}_{cfg.min_basket_size}",
                  lambda: basket_counts(baskets(lines, cfg, item)), always=True)


def item_counts(bc: DataFrame) -> DataFrame:
    """(store, item, item_orders) — multi-line baskets containing the item."""
    return bc.filter(F.col("kind") == 1).select(STORE, F.col("item_a").alias("item"), F.col("count").alias("item_orders"))


def basket_totals(bc: DataFrame) -> DataFrame:
    return bc.filter(F.col("kind") == 0).select(STORE, F.col("count").alias("total_baskets"))


def pair_counts(bc: DataFrame) -> DataFrame:
    """(store, item_a, item_b, count) with item_a < item_b, count = orders holding both."""
    return bc.filter(F.col("kind") == 2).select(STORE, "item_a", "item_b", "count")


def _pair_measures(pairs: DataFrame, counts: DataFrame, tb: DataFrame) -> DataFrame:
    ca = counts.select(STORE, F.col("item").alias("item_a"), F.col("item_orders").alias("count_a"))
    cb = counts.select(STORE, F.col("item").alias("item_b"), F.col("item_orders").alias("count_b"))
    j = pairs.join(tb, STORE).join(ca, [STORE, "item_a"]).join(cb, [STORE, "item_b"])
    n = F.col("total_baskets").cast("double")
    support = F.col("count") / n
    lift = support / ((F.col("count_a") / n) * (F.col("count_b") / n))
    return j.withColumn("support_raw", support).withColumn("lift_raw", lift)


def product_pairs(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT, item: str = "product",
                  keep: int | None = None) -> DataFrame:
    """Top pairs by count (ties: a, b) with support (4 dp) and lift (2 dp).

    ``keep`` defaults to ``2 * top_n_pairs`` (the candidate list the high-lift filter
    scans); ``rank <= top_n_pairs`` is the shown list.
    """
    bc = counts_of(lines, cfg, item)
    counts, (shown,) = limits(pair_counts(bc), cfg, "top_n_pairs")
    ranked = top_k(counts, keep if keep is not None else 2 * (shown if "_cfg_top_n_pairs" in counts.columns else cfg.top_n_pairs),
                   [F.col("count").desc(), F.col("item_a"), F.col("item_b")])
    m = _pair_measures(ranked, item_counts(bc), basket_totals(bc))
    return m.select(
        STORE, "rank", F.col("item_a").alias("product_a"), F.col("item_b").alias("product_b"), "count",
        F.round("support_raw", 4).alias("support"), F.round("lift_raw", 2).alias("lift"), "total_baskets",
    )


def lift_band(lift):
    return F.when(lift >= 1.5, "strong").when(lift >= 1.0, "moderate").otherwise("negative")


def pairs_with_bands(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    pairs = product_pairs(lines, cfg)
    held, (k,) = limits(pairs, cfg, "top_n_pairs")
    return held.filter(F.col("rank") <= k).select(*pairs.columns, lift_band(F.col("lift")).alias("band"))


def high_lift_pairs(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT, item: str = "product") -> DataFrame:
    """Within the top ``2*top_n_pairs`` by count: rounded lift ≥ threshold, first k in count order."""
    pairs = product_pairs(lines, cfg, item)
    held, (least,) = limits(pairs, cfg, "high_lift_threshold")
    cands = held.filter(F.col("lift") >= least).select(*pairs.columns)
    return top_k(cands.drop("rank"), cfg.high_lift_top_k, [F.col("count").desc(), F.col("product_a"), F.col("product_b")])


def category_pairs(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT) -> DataFrame:
    pairs = pair_counts(counts_of(lines, cfg, "category"))
    ranked = top_k(pairs, cfg.cat_pairs_top_k, [F.col("count").desc(), F.col("item_a"), F.col("item_b")])
    return ranked.select(STORE, "rank", F.col("item_a").alias("cat_a"), F.col("item_b").alias("cat_b"), "count")


def rules(lines: DataFrame, cfg: ReportConfig = DEFAULT_REPORT, item: str = "product") -> DataFrame:
    """Directed rules A→B over multi-line baskets.

    count, support (4 dp), confidence = count/count(A) (3 dp), lift (2 dp), conviction
    (99.99 when confidence ≥ 0.999), score = conf·lift·ln(1+count) from unrounded values
    (3 dp).  Kept: count ≥ min_count and *rounded* confidence ≥ min_confidence; per
    unordered pair the best by (score, count, confidence) on rounded values; top k.
    The count filter runs on the pair aggregate, before any join.
    """
    bc = counts_of(lines, cfg, item)
    pairs, (least,) = limits(pair_counts(bc), cfg, "rule_min_count")
    pairs = pairs.filter(F.col("count") >= least)
    directed = pairs.select(STORE, F.inline(F.array(
        F.struct(F.col("item_a"), F.col("item_b")),
        F.struct(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b")))), "count")
    m = _pair_measures(directed, item_counts(bc), basket_totals(bc))
    conf = F.col("count") / F.col("count_a")
    sup_b = F.col("count_b") / F.col("total_baskets").cast("double")
    conviction = F.when(conf < 0.999, (1 - sup_b) / (1 - conf))
    r = m.select(
        STORE, F.col("item_a").alias("antecedent"), F.col("item_b").alias("consequent"), "count",
        F.round("support_raw", 4).alias("support"),
        F.round(conf, 3).alias("confidence"),
        F.round("lift_raw", 2).alias("lift"),
        F.coalesce(F.round(conviction, 2), F.lit(99.99)).alias("conviction"),
        F.round(conf * F.col("lift_raw") * F.ln(F.col("count") + 1), 3).alias("score"),
    )
    columns = r.columns
    r, (sure, k) = limits(r, cfg, "rule_min_confidence", "rule_top_k")
    r = r.filter(F.col("confidence") >= sure)
    order = [F.col("score").desc(), F.col("count").desc(), F.col("confidence").desc(),
             F.col("antecedent"), F.col("consequent")]
    r = r.withColumn("pair_lo", F.least("antecedent", "consequent")).withColumn("pair_hi", F.greatest("antecedent", "consequent"))
    best = top_k(r, 1, order, partition=(STORE, "pair_lo", "pair_hi"), rank_col="_dir").drop("_dir", "pair_lo", "pair_hi")
    return top_k(best, k if "_cfg_rule_top_k" in best.columns else cfg.rule_top_k, order).select(*columns, "rank")
