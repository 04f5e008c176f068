import random

import numpy as np
import pytest

from threadloom.llm import negatives as ng

SCHEMA = "vec_id long, embedding array<float>, label int, row string, key int"


def brute(rows):
    """Rows of the result from (vec_id, vector, label): all pairs, sorted in Python."""
    rows = [(i, [int(np.floor(256.0 * x)) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, (a, va, ya) in enumerate(rows):
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(va, v)), i, y) for j, (i, v, y) in enumerate(rows) if j != k and len(v) == len(va))
        positives = [(-s, i) for s, i, y in scored if y == ya][:5]
        for s, p in positives:
            fit = [(i, -n) for n, i, y in scored if y != ya and 30 * s <= -100 * n <= 90 * s][:10]
            out += [(a, p, r + 1, i, s, n) for r, (i, n) in enumerate(fit)]
    return sorted(out)


def result(spark, rows, parts=5):
    df = spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in ng.hard_negatives(df).collect())


def some_vectors(n, dim, labels, seed):
    r = random.Random(seed)
    return [(i, [float(np.float32(r.choice([0.5, 0.25, -0.25, r.uniform(-1, 1)]))) for _ in range(dim)], r.choice(labels)) for i in range(n)]


@pytest.mark.parametrize("rows", [
    some_vectors(420, 3, [0, 1, 2], 1), some_vectors(330, 1, [0, 0, 0, 0, 1], 2),
    [(i % 150, [0.5, 0.5], i % 2) for i in range(400)],
    [(i, [0.0], i % 3) for i in range(203)],
    [*some_vectors(250, 2, [0, 1], 3), (None, [1.0, 1.0], 1), (7, None, 1), (8, [1.0, None], 0), (9, [float("nan"), 1.0], 0), (10, [float("inf"), 1.0], 1), (11, [1.0, 1.0], None), (300, [1.0], 1), (301, [1.0], 1), (302, [0.5], 0), (400, [], 0), (401, [], 0), (402, [], 1)],
], ids=["ties", "one label holds most", "repeated rows", "all scores zero", "nulls and lengths"])
def test_same_as_all_pairs(spark, rows):
    assert result(spark, rows) == brute(rows)


def test_groups_of_anchors(spark, monkeypatch):
    rows = some_vectors(900, 4, [0, 1], 4)
    monkeypatch.setattr(ng, "GROUP_BYTES", 200)
    assert result(spark, rows) == brute(rows)


def test_empty(spark):
    assert result(spark, []) == [] and result(spark, [(1, [1.0], 0)]) == [] and result(spark, [(100, [1.0], 0)]) == []


def test_keys_sort_as_the_stream_needs():
    keys = ng.pack(np.array([5, 5, 5, 5, -3]), np.array([1, 1, 1, 1, 1]), np.array([7, -7, 7, 7, 0]), 1, np.array([2, 2, 1, -1, 0]))
    assert [ng.unpack(k)[2:] for k in sorted(keys)] == [(0, 1, 0), (7, 1, -1), (7, 1, 1), (7, 1, 2), (-7, 1, 2)]
    assert ng.pack(np.array([1]), np.array([1]), np.array([7]), 0, np.array([9]))[0] < ng.pack(np.array([1]), np.array([1]), np.array([7]), 1, np.array([0]))[0]


def test_products_beyond_53_bits():
    a = np.array([[2.0**40, 3.0], [1e300, 0.0]])
    assert ng.products(a, a)[0, 0] == ng.MOST and ng.products(a, np.array([[2.0**20, 1.0]])).tolist() == [[2**60 + 3], [ng.MOST]]
    assert ng.products(np.zeros((2, 0)), np.zeros((3, 0))).tolist() == [[0] * 3] * 2
