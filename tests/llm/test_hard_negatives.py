"""Hard negatives against a search of every window by itself."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillsight.llm import hard_negatives as hn


def _plain(rows, n_pos=5, n_neg=3, low=50, high=95, every=50):
    """Anchor by anchor over all rows."""
    ok = [(i, y, [math.floor(256 * x) for x in v]) for i, v, y in rows
          if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, v in {(i, y, tuple(v)) for i, y, v in ok if i % every == 0}:
        other = [(-sum(x * z for x, z in zip(v, w)), i, y) for i, y, w in ok if i != a]
        for p, pos, _ in sorted(r for r in other if r[2] == label)[:n_pos]:
            got = sorted(r for r in other if r[2] != label and low * -p <= 100 * -r[0] <= high * -p)[:n_neg]
            out += [(a, pos, k + 1, neg, -p, -n) for k, (n, neg, _) in enumerate(got)]
    return sorted(out)


def _rows(seed, n, dim=6, labels=3, step=0.05):
    rng = random.Random(seed)
    return [(i, [round(rng.gauss(0.3, 0.3) / step) * step for _ in range(dim)], rng.randrange(labels)) for i in range(n)]


SCHEMA = "vec_id bigint, embedding array<float>, label int"


def _mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted(tuple(r) for r in hn.mine(df, F.col("vec_id") % 50 == 0, **kw).collect())


def _as_float32(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {"n_pos": 2, "n_neg": 7}), (3, {"low": 80, "high": 99})])
def test_windows_equal_a_search_of_each(spark, seed, kw):
    rows = _rows(seed, 700)
    got = _mined(spark, rows, **kw)
    assert got and got == _plain(_as_float32(rows), **kw)


def test_ties_repeats_nulls_and_odd_vectors(spark):
    rows = _rows(4, 300) + [(i, [0.25] * 6, 1) for i in range(300, 900)]        # one vector with most rows
    rows += [(50, v, y) for i, v, y in rows if i == 50] + [(7, [0.5] * 6, 0)] * 3   # equal anchors, repeated rows
    rows += [(950, [0.1] * 6, None), (1000, None, 1), (None, [0.3] * 6, 1), (1050, [0.1, None], 1), (1100, [], 2),
             (1150, [float("nan")] * 6, 1), (1200, [float("inf")] * 6, 1), (1250, [0.5, 0.5], 0),
             (1300, [0.5] * 9, 0), (1350, [-0.5] * 6, 2), (-50, [0.2] * 6, 2)]
    got = _mined(spark, rows)
    assert got == _plain(_as_float32(rows))
    assert _mined(spark, rows[:1]) == [] == _mined(spark, [])
    assert _mined(spark, rows, n_pos=1) == _plain(_as_float32(rows), n_pos=1)


def test_blocks_of_anchors_give_the_same_rows(spark, monkeypatch):
    rows = _rows(5, 600)
    want = _mined(spark, rows)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 6)
    monkeypatch.setattr(hn, "TILE", 16)
    assert _mined(spark, rows) == want


def test_columns_of_other_names_are_not_read(spark):
    rows = _rows(6, 200)
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.select("vec_id", "embedding", "label", F.lit("x").alias("score"), F.lit(1).alias("anchor"),
                      F.lit(2).alias("vector"), F.lit(3).alias("id"), F.lit("no").alias("place"))
    got = sorted(tuple(r) for r in hn.mine(clash, F.col("vec_id") % 50 == 0).collect())
    assert got == _mined(spark, rows) == _plain(_as_float32(rows))


def test_scores_are_exact_or_refused():
    big = pa.array([[float(1 << 17), -3.0], [1.0, 2.0 ** -8]])
    rows = hn.quantised(big)
    assert hn.scores(rows, rows).tolist() == [[(1 << 50) + 768 ** 2, (1 << 33) - 768], [(1 << 33) - 768, 65537]]
    rows = hn.quantised(pa.array([[float(1 << 18)], [float((1 << 18) + 1)]]))
    assert hn.scores(rows, rows)[1, 1] == (256 * ((1 << 18) + 1)) ** 2
    with pytest.raises(ArithmeticError):
        hn.scores(*[hn.quantised(pa.array([[1e20]]))] * 2)
