import math

import numpy as np

from markscope.llm import topk
from pyspark.sql import functions as F


def brute(rows, k):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, q in fine:
        if qi % 100 == 0:
            got = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in fine if i != qi and len(v) == len(q))[:k]
            out += [(qi, r, i, -s) for r, (s, i) in enumerate(got, 1)]
    return sorted(out)


def test_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vs = rng.normal(size=(700, 12))
    vs[300:420] = vs[5]  # ties
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vs)]
    rows += [(800, None), (801, [1.0, None] + [0.0] * 10), (900, [float("nan")] * 12), (901, [float("inf")] * 12), (1000, [1.0, 2.0]), (1001, [0.5, 0.5]), (None, [0.0] * 12)]
    want = brute(rows, 10)
    for block, size in ((1024, 8192), (3, 100)):
        monkeypatch.setattr(topk, "QUERY_BLOCK", block)
        monkeypatch.setattr(topk, "SLICE", size)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        got = topk.top_k(df, F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score").collect()
        assert sorted(map(tuple, got)) == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_huge_components(spark):
    rows = [(0, [1e9, 3e9]), (1, [2e9, -1e9]), (2, [5e8, 5e8])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 2, k=2, scale=1.0).collect()
    assert [(r.vec_id, r.score) for r in got] == [(0, 2 * 10**18), (1, 5 * 10**17)]


def test_products_beyond_a_long(spark):
    rows = [(0, [1e10, 1e10]), (1, [1e10, -1e10]), (2, [1e10, 1e10]), (3, [-1e10, -1e10]), (4, [1e300, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 2**63 - 1), (4, 2**63 - 1), (1, 0), (3, -(2**63))]
