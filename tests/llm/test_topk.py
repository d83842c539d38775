import math
import random

import pytest

import plumbline.llm.topk as tk


def brute(rows, k=10):
    ok = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in ok:
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(b) == len(a))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def check(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(tuple(r) for r in tk.top_k(df).collect()) == brute(rows)


def test_against_all_pairs(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(900)]
    rows += [(i, [rng.choice([-0.5, 0.0, 0.25]) for _ in range(6)]) for i in range(900, 1100)]  # many ties
    rows += [rows[3], (5000, None), (5100, []), (5200, [float("nan")] * 6), (None, [0.1] * 6), (5300, [1.0, None] * 3)]
    rows += [(6000, [1.0, 2.0]), (6001, [0.5, 0.5]), (7000, [9.0]), (100, [0.3] * 6)]
    check(spark, rows)


def test_huge_values_and_empty(spark):
    check(spark, [(0, [1e6, -2e6]), (1, [3e6, 1e6]), (2, [-3e6, 2e6])])
    check(spark, [(1, [1.0])])
    check(spark, [])


def test_lists_stop_early_and_bounds_hold():
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(2)
    items = np.floor(rng.normal(0, 200, (2000, 4)))
    queries = np.floor(rng.normal(0, 200, (20, 4)))
    lists = tk.SortedLists(items)
    lists.advance(125)
    lower, upper = lists.bounds(queries)
    score = queries @ items.T
    assert (lower <= score).all() and (score <= upper).all()
    q, i, s = tk.search_block(queries, items, np.zeros((20, 2000), bool), 10)
    for n in range(20):
        assert set(np.sort(score[n])[-10:]) <= set(s[q == n])
    assert len(q) < 20 * 100
