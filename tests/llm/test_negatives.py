"""Hard negatives against brute force, and the bounds of the codes against exact products."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import negatives


def brute(rows, positives=5, k=5, percent=80, scale=256):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in sorted({i for i, *_ in kept if i % 100 == 0}):
        _, label, q = min((r for r in kept if r[0] == a), key=lambda r: (str(r[1]), r[2]))
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, other) for i, other, v in kept if i != a and len(v) == len(q))
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            for rank, (n, nid, _) in enumerate([s for s in scored if s[2] != label and percent * -p <= 100 * -s[0] <= 100 * -p][:k]):
                out.append((a, pid, rank + 1, nid, -p, -n))
    return sorted(out)


def table(seed, n=700):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + random.normal(size=12) * 0.6).round(2).tolist(), int(random.integers(0, 3)) if i % 3 else 7) for i in range(n)]
    rows[40:60] = [(i, rows[0][1], i % 2) for i in range(40, 60)]  # ties
    rows += [(1000, None, 1), (1100, [0.0] * 12, 1), (1200, [1.0, None] + [0.0] * 10, 1), (1300, [float("nan")] * 12, 1), (1400, [float("inf")] * 12, 1), (1500, [1.0] * 12, None), (None, [1.0] * 12, 1)]
    rows += [(1600, [1.0, 2.0, -1.0], 1), (1601, [1.0, 2.0, 0.0], 1), (1602, [1.0, 1.9, 0.1], 2), (1700, [], 1), (1701, [], 2), (1702, [], 1)]
    return rows + [rows[5], rows[5], rows[100]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<double>, label int, codes int, salt string")


@pytest.mark.parametrize("bounds", [{}, {"SAMPLE": 30, "AT_ONCE": 2}, {"SAMPLE_BYTES": 8 * 12}])
def test_equals_brute_force(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(negatives, name, value)
    if bounds:
        monkeypatch.setattr(negatives, "_side", lambda dim: dim * 0 + 16)  # many blocks and groups
    rows = table(len(bounds))
    found = negatives.hard_negatives(frame(spark, rows), lambda i: i % 100 == 0)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)


def test_empty_tables(spark):
    assert negatives.hard_negatives(frame(spark, []), lambda i: i % 100 == 0).count() == 0
    assert negatives.hard_negatives(frame(spark, [(3, [1.0], 2), (100, [1.0], 3)]), lambda i: i % 100 == 0).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 60), st.integers(0, 10**6), st.sampled_from([1, 50, 10**5]))
def test_bounds_hold_for_vectors_outside_of_the_sample(dim, n, seed, size):
    random = np.random.default_rng(seed)
    book = negatives.Codebook(random.integers(-size, size + 1, (n, dim)))
    v, q = random.integers(-3 * size, 3 * size + 1, (40, dim)), random.integers(-size, size + 1, (7, dim))
    score, slack = book.bounds(q, *book.encode(v))
    assert (np.abs(v @ q.T - score) <= slack).all()
