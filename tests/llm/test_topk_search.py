"""Exact top-k search against all products."""

from __future__ import annotations

import math
import random

from forgelens.llm.topk_search import Search, top_k


def brute(data, every, k):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asking = {}
    for i, v in good:
        if i % every == 0:
            asking[i] = max(asking.get(i, v), v)
    out = []
    for q, a in asking.items():
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_matches_all_products(spark):
    rng = random.Random(9)
    data = [(i, [rng.gauss(0, 1) * rng.choice([0.1, 1, 3]) for _ in range(12)]) for i in range(700)]
    data += [(i, [0.5] * 12) for i in range(700, 900)]  # one very common vector
    data += [(10, None), (20, [1.0, None]), (30, [float("nan")] * 12), (40, [float("inf")] * 12), (None, [1.0] * 12), (1000, []), (1001, [9.0, -9.0]), (50, [2.0] * 12), (1050, [-5.0] * 12), (3, [0.25] * 12), (3, [0.25] * 12), (1100, [1e17] * 12)]
    rng.shuffle(data)
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in data], "vec_id long, embedding array<double>, rank int, norm double").repartition(3)
    want = brute([x for x in data if x[0] != 1100], 10, 5)
    small = Search(query_block=20, seeds=16, sample=50, rows=32)
    assert sorted(map(tuple, top_k(df.where("vec_id is null or vec_id <> 1100"), 10, small).collect())) == want
    assert sorted(map(tuple, top_k(df.where("vec_id is null or vec_id <> 1100"), 10).collect())) == want
    assert top_k(df, 10).count() >= len(want)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [-1.0]), (2, [0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(df, 2).collect())) == [(0, 1, 2, 0), (0, 2, 1, -65536), (2, 1, 0, 0), (2, 2, 1, 0)]
    assert top_k(df.limit(0)).count() == 0


def test_floor_of_tiny_negative_components(spark):
    data = [(0, [-1.0, 0.0]), (1, [0.0, 0.0]), (2, [-1e-20, 0.0]), (3, [-1e-300, 5e-324]), (4, [-0.0, -2.0**-60])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(df, 10).collect())) == brute(data, 10, 5)
    assert [r.vec_id for r in top_k(df, 10).orderBy("rank").collect()][:2] == [2, 3]
