"""Micro fixtures with hand-computed expectations (FIXTURES.md §4)."""

from __future__ import annotations

from tillsight.config import ReportConfig
from tillsight.operators import basket, bundles, cart, products, slice as SL, ticket, timeline, trends


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_iso_week(make_lines):
    df = make_lines([("S", 1, "2026-12-31", 9, "a", "c", 1, 10), ("S", 2, "2027-01-01", 9, "a", "c", 1, 10),
                     ("S", 3, "2027-01-04", 9, "a", "c", 1, 10)])
    assert rows(df, "sale_date", "year_week") == [
        (__import__("datetime").date(2026, 12, 31), "2026-W53"),
        (__import__("datetime").date(2027, 1, 1), "2026-W53"),
        (__import__("datetime").date(2027, 1, 4), "2027-W01")]


def test_ticket_edges_right_closed(make_lines):
    totals = [0, 5000, 5000.01, 200000, 200001]
    df = make_lines([("S", i, "2026-01-05", 9, "p", "c", 1, t) for i, t in enumerate(totals)])
    out = {r["bucket"]: r["count"] for r in cart.ticket_buckets(df, ReportConfig()).collect()}
    # 0 and 200001 fall outside (0, 200000]; 5000 is in (0, 5000]; 5000.01 in (5000, 10000]
    assert out == {"<5K": 1, "5-10K": 1, "10-15K": 0, "15-20K": 0, "20-30K": 0, "30-50K": 0, "50K+": 1}


def test_cart_fraction_segments(make_lines):
    df = make_lines([("S", 1, "2026-01-05", 9, "a", "c", 1, 10), ("S", 2, "2026-01-05", 9, "a", "c", 1.5, 15),
                     ("S", 3, "2026-01-05", 9, "a", "c", 2.5, 25), ("S", 4, "2026-01-05", 9, "a", "c", 4, 40)])
    seg = {r["segment"]: (r["orders"], r["share_pct"]) for r in cart.cart_segments(df).collect()}
    assert seg == {"1 unidad": (1, 25.0), "2+ unidades": (2, 50.0)}  # 1.5 units is in neither
    mb = {r["bucket"]: (r["orders"], r["share_multi_pct"]) for r in cart.multi_buckets(df).collect()}
    assert mb == {"2 unidades": (1, 50.0), "4+ unidades": (1, 50.0)}  # 2.5 truncates to 2


def test_pairs_count_lines_not_products(make_lines):
    # order 1: a,a (two lines, one product) -> multi-line order but no pair
    # orders 2..4: a,b ; order 5: single line
    r = [("S", 1, "2026-01-05", 9, "a", "c", 1, 1), ("S", 1, "2026-01-05", 9, "a", "c", 1, 1)]
    for o in (2, 3, 4):
        r += [("S", o, "2026-01-05", 9, "a", "c", 1, 1), ("S", o, "2026-01-05", 9, "b", "c", 1, 1)]
    r += [("S", 5, "2026-01-05", 9, "b", "c", 1, 1)]
    p = basket.product_pairs(make_lines(r), ReportConfig()).collect()
    assert len(p) == 1
    row = p[0]
    assert (row["product_a"], row["product_b"], row["count"], row["total_baskets"]) == ("a", "b", 3, 4)
    # support 3/4; sup_a = 4/4, sup_b = 3/4 -> lift 1.0
    assert row["support"] == 0.75 and row["lift"] == 1.0


def test_rules_conviction_branch(make_lines):
    r = []
    for o in range(20):  # b always with a: conf(b->a) = 1.0
        r += [("S", o, "2026-01-05", 9, "a", "c", 1, 1), ("S", o, "2026-01-05", 9, "b", "c", 1, 1)]
    for o in range(20, 30):  # a alone in multi-line orders with c
        r += [("S", o, "2026-01-05", 9, "a", "c", 1, 1), ("S", o, "2026-01-05", 9, "c", "c", 1, 1)]
    cfg = ReportConfig(rule_min_count=5, rule_min_confidence=0.1)
    out = {(x["antecedent"], x["consequent"]): x for x in basket.rules(make_lines(r), cfg).collect()}
    assert out[("b", "a")]["conviction"] == 99.99
    assert out[("b", "a")]["confidence"] == 1.0


def test_constant_scores_balanced_half(make_lines):
    r = []
    for o in range(20):
        r += [("S", o, "2026-01-05", 9, "a", "c", 1, 1), ("S", o, "2026-01-05", 9, "b", "c", 1, 1)]
    cfg = ReportConfig(rule_min_count=5, rule_min_confidence=0.1)
    s = bundles.bundle_scores(make_lines(r), cfg).collect()
    assert len(s) == 1 and s[0]["balanced_score"] == 0.5


def test_std_zero_no_anomalies(make_lines):
    df = make_lines([("S", i, f"2026-01-{i + 1:02d}", 9, "a", "c", 1, 100) for i in range(5)])
    assert trends.anomaly_days(df, ReportConfig()).count() == 0
    one = make_lines([("S", 1, "2026-01-01", 9, "a", "c", 1, 100)])
    assert trends.anomaly_days(one, ReportConfig()).count() == 0


def test_closed_sunday(make_lines):
    # 2026-01-05 is a Monday; six days Mon..Sat, no Sunday
    df = make_lines([("S", i, f"2026-01-{5 + i:02d}", 9, "a", "c", 1, 10) for i in range(6)])
    dow = {r["day"]: r["orders"] for r in timeline.dow(df).collect()}
    assert dow["Dom"] is None and dow["Lun"] == 1
    sdow = {r["day"]: r["orders"] for r in SL.dow(df, SL.SliceFilter()).collect()}
    assert sdow["Dom"] == 0
    dt = {r["day"]: (r["orders"], r["avg_ticket"]) for r in ticket.day_ticket(df).collect()}
    assert dt["Dom"] == (0, None)


def test_order_spans_hours(make_lines):
    df = make_lines([("S", 1, "2026-01-05", 10, "a", "c", 1, 10, None, None, 1),
                     ("S", 1, "2026-01-05", 11, "b", "c", 1, 20, None, None, 2)])
    ht = {r["sale_hour"]: (r["orders"], r["avg_ticket"]) for r in ticket.hour_ticket(df).collect()}
    assert ht == {10: (1, 10.0), 11: (1, 20.0)}  # report: one slot per (order, weekday, hour)
    st = {r["sale_hour"]: (r["orders"], r["avg_ticket"]) for r in SL.ticket(df, SL.SliceFilter()).collect()}
    assert st == {10: (1, 30.0)}  # slice: the order's first line's hour, full ticket


def test_trend_partial_month(make_lines):
    def month(m, days, rev):
        return [("S", f"{m}-{d}", f"2026-{m:02d}-{d:02d}", 9, "a", "c", 1, rev) for d in range(1, days + 1)]
    cfg = ReportConfig(trend_min_base_revenue=1, trend_min_base_orders=1)
    base = month(1, 20, 10) + month(2, 20, 20)
    # last month with 19 days and >2 months -> compare = February
    out = trends.trend_months(make_lines(base + month(3, 19, 5)), cfg).collect()[0]
    assert (out["base_month"], out["compare_month"]) == ("2026-01", "2026-02")
    out = trends.trend_months(make_lines(base + month(3, 20, 5)), cfg).collect()[0]
    assert out["compare_month"] == "2026-03"
    g = trends.product_trends(make_lines(base + month(3, 19, 5)), cfg).collect()
    assert [(r["direction"], r["growth_pct"]) for r in g] == [("up", 100.0)]


def test_one_month_has_no_trends(make_lines):
    df = make_lines([("S", 1, "2026-01-05", 9, "a", "c", 1, 10)])
    assert trends.product_trends(df, ReportConfig()).count() == 0


def test_pareto_crossing_product_not_counted(make_lines):
    df = make_lines([("S", 1, "2026-01-05", 9, "a", "c", 1, 70), ("S", 2, "2026-01-05", 9, "b", "c", 1, 20),
                     ("S", 3, "2026-01-05", 9, "c", "c", 1, 10)])
    p = products.products_pareto(df).collect()
    assert {r["product"]: r["cum_rev_pct"] for r in p} == {"a": 70.0, "b": 90.0, "c": 100.0}
    assert p[0]["n_pareto"] == 1


def test_exact_quantiles_match_percentile(spark):
    from pyspark.sql import functions as F
    from tillsight.functions.quantiles import exact_quantiles
    rows = [("a", float(v)) for v in (5, 1, 9, 3, 3, 7, 100)] + [("b", 2.0)] + [("c", float(v)) for v in range(1, 1001)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    qs = [0.0, 0.25, 0.5, 0.6, 0.75, 1.0]
    got = {r["k"]: [r[f"q{i}"] for i in range(len(qs))] for r in exact_quantiles(df, ["k"], "v", qs).collect()}
    ref = {r["k"]: list(r["p"]) for r in df.groupBy("k").agg(F.percentile("v", qs).alias("p")).collect()}
    for k in ref:
        assert [round(x, 9) for x in got[k]] == [round(x, 9) for x in ref[k]], k
