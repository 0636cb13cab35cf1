import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score int, pivot string, v string"


def brute(rows, every, k):
    ints = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ints:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def run(spark, rows, every, k=10, **options):
    frame = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA)
    got = topk.search(topk.integer_vectors(frame), F.col("vec_id") % every == 0, k, **options).collect()
    assert len({(r.query_id, r.rank) for r in got}) == len(got)
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in got}


def vectors(n=700, d=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    v = centres[rng.integers(0, 8, n)] + 0.2 * rng.normal(size=(n, d))
    v[n // 3 : n // 2] = v[0]  # one vector that is very common: ties
    return [(i, [float(x) for x in row]) for i, row in enumerate(v)]


@pytest.mark.parametrize(("pivots", "part_bytes"), [(64, 32 << 20), (3, 500), (1, 9000)])
def test_against_brute_force(spark, pivots, part_bytes):
    rows = vectors()
    assert run(spark, rows, 50, pivots=pivots, part_bytes=part_bytes) == brute(rows, 50, 10)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [-3.0, 0.5]), (6, [0.0, 0.0]), (50, [1.0, 2.0])]
    assert run(spark, rows, 50) == brute(rows, 50, 10)
    assert run(spark, [*rows, (7, [4.0])], 50) == brute([*rows, (7, [4.0, 0.0])], 50, 10)


def test_huge_components_stay_exact(spark):
    rows = [(i, [float(np.float32(2e5 + 10 * i)), float(np.float32(-2e5 + 3 * i * i))]) for i in range(60)]
    assert run(spark, rows, 50) == brute(rows, 50, 10)


def test_few_and_no_rows(spark):
    assert run(spark, [], 100) == set()
    assert run(spark, [(1, [1.0])], 100) == set()
    assert run(spark, [(100, [1.0])], 100) == set()
    assert run(spark, [(100, [1.0]), (100, [2.0]), (7, [-1.0])], 100, k=2) <= {(100, 1, 7, -1024 * 1024), (100, 1, 7, -2048 * 1024)}


def test_annuli_prune():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 1, (2000, 3)), rng.normal(60, 1, (2000, 3))]).round() * 10
    m = float((v**2).sum(1).max())
    lifted = topk._lift(v.astype(np.int64), m)
    pivot = lifted[0]
    dist = np.sqrt(((lifted - pivot) ** 2).sum(1))
    order = np.argsort(dist)
    best, q = topk._Best(10), v[3000]
    near = float(np.sqrt(((np.append(q, 0.0) - pivot) ** 2).sum()))
    seen = topk.search_run(best, q, -1, near, dist[order], order, v[order], 1e-3, float((q**2).sum() + m), True)
    assert best.scores.tolist() == sorted((v @ q).astype(int).tolist(), reverse=True)[:10]
    assert seen < 4000
