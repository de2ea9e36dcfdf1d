"""Approximate neighbours: exact scores and order, recall against a comparison with all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.llm import pivot_index
from courtside.llm.pivot_index import Pivots, agreements, nearest_neighbours, postings

SCHEMA = "vec_id bigint, embedding array<float>"


def truth(rows, k):
    kept = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in kept.items():
        if q % 20 == 0:
            score = {i: sum(x * y for x, y in zip(v.tolist(), w.tolist(), strict=True)) for i, w in kept.items() if i != q}
            out[q] = [(i, score[i]) for i in sorted(score, key=lambda i: (-score[i], i))[:k]]
    return out


def answer(spark, rows, extra=False, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", *[f"'x' as {c}" for c in ("id", "v", "query", "key", "ids", "prefix", "list", "score", "near", "query_id")])
    out = {}
    for r in sorted(nearest_neighbours(df, F.col("vec_id") % 20 == 0, **more).collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def random_rows(n, dim, seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in row]) for i, row in enumerate((rng.normal(size=(n, dim)) * scale).astype(np.float32))]


@pytest.mark.parametrize("unit", [True, False])
def test_recall_and_exact_scores(spark, monkeypatch, unit):
    monkeypatch.setattr(pivot_index, "GROUP", 64)  # several slices and blocks
    rows = random_rows(1500, 24)
    if unit:
        rows = [(i, (np.array(v) / np.linalg.norm(v)).tolist()) for i, v in rows]
    want, got = truth(rows, 20), answer(spark, rows, extra=True)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    found = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(found) >= 0.9
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, near in got.items():
        assert near == sorted(near, key=lambda n: (-n[1], n[0]))
        assert all(abs(s - vectors[q] @ vectors[i]) < 1e-12 and i != q for i, s in near)


def test_copies_ties_and_repeated_rows(spark):
    rows = [(i, [1.0, 0.0] if i % 3 else [0.6, 0.8]) for i in range(120)]
    assert answer(spark, rows + rows[:5]) == truth(rows, 20)


def test_few_rows_and_odd_rows(spark):
    odd = [(200, None), (220, []), (240, [0.0, 0.0, 0.0]), (260, [None, 1.0, 1.0]), (280, [math.nan, 1.0, 1.0]), (300, [math.inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    rows = random_rows(15, 3) + odd
    assert answer(spark, rows) == truth(rows, 20)
    assert answer(spark, odd) == answer(spark, []) == answer(spark, [(0, [1.0])]) == {}
    with pytest.raises(ValueError, match="components"):
        answer(spark, [(0, [1.0]), (1, [1.0, 2.0])])


def test_query_that_finds_too_few_compares_all(spark, monkeypatch):
    monkeypatch.setattr(pivot_index.PivotIndex, "settings", lambda *a: (1, 0.01))
    rows = random_rows(300, 8, seed=2)
    got = answer(spark, rows, pivots=64, prefix=4)
    assert all(len(v) == 20 for v in got.values())
    assert len(got) == 15


def test_agreement_is_the_footrule():
    rng = np.random.default_rng(1)
    known = Pivots(rng.normal(size=(200, 6)), 9.0, 32, 8)
    a, b = known.prefixes(known.filled(rng.normal(size=(30, 6)))), known.prefixes(known.filled(rng.normal(size=(40, 6))))
    agreed = agreements(a, postings(b, known.count), len(b), known.count)
    for i, x in enumerate(a.tolist()):
        assert agreed[i].tolist() == known.agreement(a[i], known.weights_of(b)).tolist()
        for j, y in enumerate(b.tolist()):
            foot = sum(abs((x.index(p) if p in x else 8) - (y.index(p) if p in y else 8)) for p in set(x) | set(y))
            assert foot == 8 * 9 - 2 * agreed[i, j]
