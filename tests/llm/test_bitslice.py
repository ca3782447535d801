"""Bit-sliced top-k against plain sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import bitslice


def brute(rows, every, k):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ints = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in ok]
    out = []
    for n, (q, w) in enumerate(ints):
        if q % every == 0:
            scored = [(-sum(a * b for a, b in zip(w, v)), c) for m, (c, v) in enumerate(ints) if m != n and len(v) == len(w)]
            out += [(q, rank + 1, c, max(-(2**63), min(2**63 - 1, -s))) for rank, (s, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def run(spark, rows, every=7, k=5):
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, row int, score int")
    found = bitslice.top_k(df.repartition(3), F.col("id") % every == 0, k)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())


@pytest.mark.parametrize("block", [64, 1 << 15])
def test_against_plain_sums(spark, monkeypatch, block):
    monkeypatch.setattr(bitslice, "BLOCK_ROWS", block)
    monkeypatch.setattr(bitslice, "QUERY_ROWS", 10)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 12)]) for i in range(150)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]  # ties
    rows += [(2000 + i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(40)]
    rows += [(3003, []), (3010, []), (3017, [1.0]), (3500, [0.0] * 12), (3507, [-1.0] * 12)]
    rows += [(4004, None), (4011, [None] * 12), (4018, [float("nan")] * 12), (4025, [float("inf")] + [0.0] * 11), (None, [0.1] * 12)]
    assert run(spark, rows) == brute(rows, 7, 5)


def test_repeats_large_values_and_empty(spark):
    rows = [(0, [0.5, 0.5]), (0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [-0.25, 0.001])]
    assert run(spark, rows, k=2) == brute(rows, 7, 2)
    large = [(0, [1e30, -1e9, 0.5]), (7, [1e9, 1e9, 1e9]), (8, [-1e12, 3.0, 4.0]), (9, [0.0, 0.0, 0.0])]
    assert run(spark, large) == brute(large, 7, 5)
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
