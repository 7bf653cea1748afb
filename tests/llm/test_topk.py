from collections import Counter

import numpy as np
import pytest

from pixsieve.llm import topk


def brute(rows, every=20, k=20):
    """Counter of (query_id, rank, vec_id, score) in whole numbers of Python."""
    kept = []
    for i, x in rows:
        if i is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        kept.append((i, [int(np.floor(64 * np.float64(c))) for c in x]))
    out = Counter()
    for n, (i, q) in enumerate(kept):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(kept) if m != n)
            out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k]))
    return out


def run(spark, rows, **options):
    table = spark.createDataFrame([(i, x, "x", "y") for i, x in rows], "vec_id LONG, embedding ARRAY<DOUBLE>, score STRING, number STRING").repartition(3)
    return Counter((r.query_id, r.rank, r.vec_id, r.score) for r in topk.nearest(table, **options).collect())


def test_outlines_bound_products():
    rng = np.random.default_rng(3)
    for places in (1, 3, 16, 37):
        a, b = rng.integers(-60, 60, (40, places)), rng.integers(-60, 60, (50, places))
        for n in topk.LEVELS:
            assert (topk.outline(a, n) @ topk.outline(b, n).T >= a @ b.T - 1e-6).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [nan, 1.0]), (80, [inf, 1.0]), (None, [1.0, 1.0]), (100, []), (-20, [0.5, -0.25, 3.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, 2.0]), (120, [-0.001, 1e9])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == Counter() and run(spark, [(20, [1.0])]) == Counter()
    wide = [(i, [float(1 << 35) + 100 * i, -3.0e9 * i]) for i in range(30)]
    wide = [(i, [x / 2.0**12 for x in v]) for i, v in wide]
    assert run(spark, wide) == brute(wide)


@pytest.mark.parametrize("rows_a_chunk", [8, 4096])
def test_equals_brute_force(spark, monkeypatch, rows_a_chunk):
    monkeypatch.setattr(topk, "CHUNK_ROWS", rows_a_chunk)
    monkeypatch.setattr(topk, "SLAB", 5)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(5, 24)) * 2
    rows = [(int(i), (centres[i % 5] + rng.normal(size=24) * 0.3).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # a hot vector, with queries of its own
    rows += [(2000 + i, np.round(rng.normal(size=24)).tolist()) for i in range(100)]
    assert run(spark, rows) == brute(rows)
    few = rows[:60]
    assert run(spark, few, every=7, k=3) == brute(few, 7, 3)
