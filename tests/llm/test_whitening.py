from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from tickwatch.llm import whitening

ROWS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
        # names that the result has too
        T.StructField("component", T.StringType()), T.StructField("n", T.StringType()), T.StructField("x", T.IntegerType()),
    ]
)


@pytest.fixture(scope="module")
def table(spark):
    def make(pairs):
        return spark.createDataFrame([(i, v, "c", "n", 1) for i, v in pairs], ROWS)

    return make


def brute(pairs, k=16):
    """(id, x) rows, n, sums, variances and components, from whole numbers and a symmetric eigenproblem."""
    kept = [(i, v) for i, v in pairs if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in kept), default=0)
    rows = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) + (1_000_000,) * (d - len(v))) for i, v in kept]
    fit = sorted({x for _, x in rows})
    n, sums = len(fit), [sum(x[j] for x in fit) for j in range(d)]
    y = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit]).reshape(n, d)
    e, v = np.linalg.eigh(y.T @ y / max(n, 1))
    return rows, n, sums, e[::-1], v[:, ::-1]


def held(got, pairs, k=16):
    rows, n, sums, e, v = brute(pairs)
    d = len(sums)
    assert len(got) == len(rows) * min(k, d)
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
        assert r["n"] == n
    assert set(by) == set(range(1, min(k, d) + 1))
    want = sorted((str(i), sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in rows)
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in by[1]) == want
    for j, own in by.items():
        assert own[0]["explained"] == pytest.approx(e[j - 1] / e.sum(), rel=1e-9, abs=1e-15)
        if e[j - 1] < 1e-9 * e[0]:
            assert all(r["whitened"] is None for r in own)
            continue
        assert max(r["identity_error"] for r in own) < 1e-9
        place = {(i, sum((n * c - s) ** 2 for c, s in zip(x, sums))): sum((n * c - s) / n * w for c, s, w in zip(x, sums, v[:, j - 1])) / math.sqrt(e[j - 1]) for i, x in rows}
        mine = np.array([r["whitened"] for r in own])
        theirs = np.array([place[r["vec_id"], r["deviation"]] for r in own])
        sign = np.sign(mine @ theirs)
        assert np.abs(mine - sign * theirs).max() < 1e-6 * np.abs(theirs).max()


def test_equals_eigenvectors(table):
    r = random.Random(1)
    scale = [3.0 * 0.8**j for j in range(20)]
    pairs = [(i, [r.gauss(0.1, s) for s in scale]) for i in range(600)]
    held(whitening.whiten(table(pairs)).collect(), pairs)


def test_repeated_vectors_count_once(table):
    r = random.Random(2)
    pairs = [(i, [r.gauss(0, 1) * (j + 1) for j in range(5)]) for i in range(200)]
    hot = pairs + [(1000 + i, [0.5, -7.0, 3.0, 2.0, 9.0]) for i in range(400)]
    got = whitening.whiten(table(hot)).collect()
    held(got, hot)
    assert got[0]["n"] == 201


def test_components_without_variance(table):
    r = random.Random(3)
    # the third is a sum of others, the fourth does not vary
    pairs = [(i, [float(a := r.randint(-500, 500)), float(b := r.randint(-50, 50)), float(a + b), 0.25]) for i in range(300)]
    got = whitening.whiten(table(pairs)).collect()
    held(got, pairs)
    assert {r["component"] for r in got if r["whitened"] is None} == {3, 4}


def test_very_uneven_variances(table):
    r = random.Random(4)
    pairs = [(i, [r.gauss(0, 1e6), r.gauss(0, 100.0), r.gauss(0, 0.5)]) for i in range(2000)]
    got = whitening.whiten(table(pairs)).collect()
    by = {j: np.array([r["whitened"] for r in got if r["component"] == j]) for j in (1, 2, 3)}
    for j in by:
        assert by[j].std() == pytest.approx(1, abs=1e-6) and abs(by[j].mean()) < 1e-6
    assert got[0]["identity_error"] < 1e-8


def test_awkward_rows(table):
    nan, inf = float("nan"), float("inf")
    pairs = [
        (1, None), (2, [1.0, None]), (3, [nan, 0.0]), (4, [inf, 0.0]), (None, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [0.0, -2.0]),
        (6, [3.0]), (7, []), (8, [0.0, 0.0]), (9, [-1.0, 5.0]), (9, [-1.0, 5.0]),
    ]
    held(whitening.whiten(table(pairs)).collect(), pairs)
    assert whitening.whiten(table([])).collect() == []
    assert whitening.whiten(table([(1, None), (2, [])])).collect() == []
    one = whitening.whiten(table([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in sorted(one)] == [
        (i, c, 1, 0, None, None) for i in (1, 2) for c in (1, 2)
    ]


def test_numbers_beyond_64_bits(table):
    pairs = [(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [0.0, 5.0]), (4, [1e30, 0.0])]
    got = {r["vec_id"]: r for r in whitening.whiten(table(pairs)).collect() if r["component"] == 1}
    assert all(r["deviation"] is None for r in got.values()) and got[1]["explained"] == pytest.approx(1)
    # exact where squares pass 64 bits on the way to no more than 64
    x = np.array([[1 << 40, 5], [-(1 << 40), 6]])
    sums = [0, 11]
    assert whitening.deviations(whitening.centred(x, 2, sums)) == [None, None]
    x[:, 0] >>= 12
    assert whitening.deviations(whitening.centred(x, 2, sums)) == [(2 << 28) ** 2 + 1, (2 << 28) ** 2 + 1]


def test_solved_and_factored():
    rnd = np.random.default_rng(1)
    a = rnd.normal(size=(50, 7))
    r = whitening.factor(a.T @ a, 50, True)
    q = whitening.solved(a, r)
    assert np.abs(q @ r - a).max() < 1e-10 and np.abs(q.T @ q - np.eye(7)).max() < 1e-6
