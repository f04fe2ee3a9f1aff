"""Exact vector top-k in blocks and by expressions, against ranking all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolex.operators import nearest, retrieval


def brute(rows, k):
    def score(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        dot, x, y = 0.0, 0.0, 0.0
        for u, v in zip(a, b):
            dot, x, y = dot + u * v, x + u * u, y + v * v
        s = math.sqrt(x) * math.sqrt(y)
        c = dot / s if s else math.nan
        return None if math.isnan(c) else round(max(-1.0, min(1.0, c)), 6)

    out = []
    for q, a in rows:
        if q is not None and q % 5 == 0:
            found = [(v, score(b, a)) for v, b in rows if v is not None and v != q]
            out += [(q, v, s, r + 1) for r, (v, s) in enumerate(sorted(found, key=lambda x: (x[1] is None, -(x[1] or 0.0), x[0]))[:k])]
    return sorted(out)


def table(n, dims=6, seed=1):
    some = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in some.normal(size=dims)]) for i in range(n)]
    for i in range(0, n, 7):  # copies
        rows[i] = (i, list(rows[0][1]))
    return rows


ODD = [(100, None), (101, [0.0] * 6), (102, [1.0, 2.0]), (105, [math.nan] * 6), (103, [math.inf] + [1.0] * 5), (104, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (110, [3.0, -1.0]), (115, []), (None, [1.0] * 6)]


@pytest.mark.parametrize("native", [False, True])
@pytest.mark.parametrize("rows, k", [(table(90), 4), (table(60) + ODD, 10), (table(8) + ODD, 30), (table(70, dims=70), 5), ([], 3)])
def test_first_k_of_every_query(spark, monkeypatch, native, rows, k):
    monkeypatch.setattr(nearest, "STEP", 16)
    monkeypatch.setattr(nearest, "QUERIES", 8)
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = retrieval.dense(v.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, k, native=native)
    assert sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in found.collect()) == brute(rows, k)


@pytest.mark.parametrize("way", [nearest.by_blocks, nearest.by_expressions])
def test_most_pairs_are_never_ranked(spark, way):
    some = np.random.default_rng(2).normal(size=(3000, 8))
    v = spark.createDataFrame([(i, [float(x) for x in e]) for i, e in enumerate(some)], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    assert 60 * 10 <= way(q, v, 10, 2e-6).count() < 60 * 3000 / 8
