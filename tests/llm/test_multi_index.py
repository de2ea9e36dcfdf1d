"""Hard negatives against a comparison with all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.llm import multi_index
from courtside.llm.multi_index import Cells, codebook, mine_hard_negatives, nearest, next_cells

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, positives=5, negatives=5):
    kept = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            kept[i] = (label, [math.floor(256 * float(np.float32(x))) for x in v])
    out = []
    for a, (label, q) in kept.items():
        if a % 10:
            continue
        score = {i: sum(x * y for x, y in zip(q, w, strict=True)) for i, (_, w) in kept.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if kept[i][0] == label][:positives]:
            fit = [i for i in order if kept[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:negatives]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit)]
    return sorted(out)


def answer(spark, rows, extra=False, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", *[f"'x' as {c}" for c in ("id", "q", "key", "cell", "found", "ids", "hash", "anchor", "v", "near")])
    return sorted(tuple(r) for r in mine_hard_negatives(df, F.col("vec_id") % 10 == 0, **more).collect())


def random_rows(n, dim=6, seed=1, labels=3):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(dim)] for _ in range(4)]
    return [(i, [c + r.gauss(0, 0.2) for c in r.choice(centres)], r.randrange(labels)) for i in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "FIRST_CELLS", 1)  # several rounds
    monkeypatch.setattr(multi_index, "GROUP", 8)  # several slices and blocks
    rows = random_rows(300)
    assert answer(spark, rows, extra=True, rows_per_cell=4) == brute(rows)


def test_copies_ties_and_repeated_rows(spark):
    v, w = [0.5, 0.5, 0.0], [0.5, 0.5, 0.001]
    rows = [(i, v if i % 3 else w, i % 2) for i in range(60)]
    rows += [(i, [0.0, 0.0, 0.0], i % 2) for i in range(60, 90)]
    assert answer(spark, rows + rows[:7]) == brute(rows)


def test_odd_rows(spark):
    odd = [(200, None, 1), (210, [], 1), (220, [None, 1.0, 1.0], 1), (230, [math.nan, 1.0, 1.0], 1), (240, [math.inf, 1.0, 1.0], 1), (250, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    rows = random_rows(60, dim=3) + odd
    assert answer(spark, rows) == brute(rows)
    assert answer(spark, odd) == answer(spark, []) == []
    assert answer(spark, [(0, [1.0], 1)]) == []


def test_large_components_stay_exact(spark):
    r = random.Random(4)
    rows = [(i, [float(r.randrange(-(1 << 18), 1 << 18)) for _ in range(4)], r.randrange(2)) for i in range(80)]
    assert answer(spark, rows) == brute(rows)
    with pytest.raises(ValueError, match="64 bits"):
        answer(spark, [(0, [1e30], 1), (1, [1e30], 1)])
    with pytest.raises(ValueError, match="components"):
        answer(spark, [(0, [1.0], 1), (1, [1.0, 2.0], 1)])


def test_walk_visits_cells_in_falling_order_and_bounds_hold():
    rng = np.random.default_rng(0)
    q = rng.integers(-200, 200, (400, 8))
    books = [codebook(q[:, :4], 6), codebook(q[:, 4:], 6)]
    (i, d), (j, e) = nearest(q[:, :4], books[0]), nearest(q[:, 4:], books[1])
    radii = [np.array([x[c == k].max(initial=0) for k in range(6)]) for c, x in ((i, d), (j, e))]
    cell = i * 6 + j
    cells = Cells(books, radii, set(cell.tolist()))
    for a in q[:20]:
        walk = list(cells.walk(a))
        assert sorted(c for _, _, c in walk) == sorted(cells.filled)
        assert all(x[0] >= y[0] for x, y in zip(walk, walk[1:], strict=False))
        score = q @ a
        for high, low, c in walk:
            assert low <= score[cell == c].min() and score[cell == c].max() <= high
        need = int(np.sort(score)[-5])
        read, _, done = next_cells(iter(walk), 0, 1000, need, multi_index.UNBOUNDED)
        assert done and set(cell[score >= need].tolist()) <= set(read)
        first, passed, _ = next_cells(iter(walk), 0, 3, -multi_index.UNBOUNDED, multi_index.UNBOUNDED)
        more, _, _ = next_cells(iter(walk), passed, 3, -multi_index.UNBOUNDED, multi_index.UNBOUNDED)
        assert first + more == [c for _, _, c in walk[:6]]
