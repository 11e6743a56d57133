from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from tickwatch.llm import exact_search, near_search
from tickwatch.llm.vectors import finite_vectors

from .conftest import SF

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("rank", T.StringType()), T.StructField("v", T.LongType()), T.StructField("query", T.LongType())]
)
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="session")
def embeddings(spark):
    def make(pairs):
        return spark.createDataFrame([(i, [float(x) if x is not None else None for x in v] if v is not None else None, 1, "x", 5, 6) for i, v in pairs], SCHEMA)

    return make


def usable(pairs):
    return [(i, np.array(np.float32(v), float)) for i, v in pairs if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]


def brute_exact(pairs, k=20, every=20):
    rows = [(i, np.floor(64 * v).astype(int)) for i, v in usable(pairs)]
    out = []
    for q in sorted({i for i, _ in rows if i % every == 0}):
        qv = min((v.tolist() for i, v in rows if i == q))
        best = sorted((-int(np.dot(qv, v)), i) for i, v in rows if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def random_vectors(n, dim, seed, copies=0):
    r = np.random.default_rng(seed)
    rows = [(i, r.normal(size=dim).tolist()) for i in range(n)]
    return rows + [(n + i, rows[7][1]) for i in range(copies)]


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


def test_exact(spark, embeddings):
    rows = random_vectors(400, 9, 1, copies=150)
    assert rows_of(exact_search.search(embeddings(rows))) == sorted(brute_exact(rows))


def test_exact_in_many_tiles(embeddings):
    rows = random_vectors(300, 5, 2, copies=60)
    from tickwatch.llm.vectors import finite_vectors

    v = finite_vectors(embeddings(rows))
    got = exact_search.top_k(v.where("vec_id % 20 = 0"), v, k=7, query_tile=4, vector_tile=10)
    assert rows_of(got) == sorted(brute_exact(rows, k=7))


AWKWARD = [
    (0, [1, 0, 0]), (20, [0.5, 0.5, 0]), (40, None), (60, [NAN, 0, 0]), (80, [INF, 1, 1]), (100, [0, 0, 0]), (120, []), (140, [1, None, 2]), (None, [1, 1, 1]),
    (1, [1, 0, 0]), (2, [1, 0, 0]), (2, [1, 0, 0]), (3, [-1, 0, 0]), (20, [0.5, 0.5, 0]), (160, [-0.01, 0.3, 0.2]),
]


def test_exact_awkward_rows(embeddings):
    assert rows_of(exact_search.search(embeddings(AWKWARD))) == sorted(brute_exact(AWKWARD))
    assert exact_search.search(embeddings([])).collect() == []
    assert exact_search.search(embeddings([(0, [1, 2])])).collect() == []


def test_large_numbers_stay_exact():
    r = np.random.default_rng(3)
    q, v = r.integers(-(1 << 28), 1 << 28, (3, 16)), r.integers(-(1 << 28), 1 << 28, (5, 16))
    assert (exact_search.product(q, v) == np.array([[sum(int(a) * int(b) for a, b in zip(x, y)) for y in v] for x in q])).all()


def brute_near(pairs, k=20, every=20):
    rows = [(i, v) for i, v in usable(pairs) if v.any()]
    out = {}
    for q in sorted({i for i, _ in rows if i % every == 0}):
        qv = np.array(min(v.tolist() for i, v in rows if i == q))
        found = {}
        for i, v in rows:
            if i != q:
                found[i] = float(sum(a * b for a, b in zip(qv, v)))
        out[q] = sorted((-s, i) for i, s in found.items())[:k]
    return out


def recall(df, pairs, k=20):
    want, got = brute_near(pairs, k), {}
    for q, rank, i, score in rows_of(df):
        got.setdefault(q, []).append((rank, i, score))
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        exact = {i: -s for s, i in brute_near([p for p in pairs if p[0] in {q, *(i for _, i, _ in found)}], 10**6).get(q, [])}
        assert all(exact[i] == s for _, i, s in found)
    hits = sum(len({i for _, i in w} & {i for _, i, _ in got.get(q, [])}) for q, w in want.items())
    return hits / max(1, sum(map(len, want.values())))


def test_near_finds_most(spark, embeddings):
    rows = random_vectors(900, 12, 4, copies=100)
    assert recall(near_search.search(embeddings(rows)), rows) >= 0.9


def test_near_on_the_given_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in table.collect()]
    assert recall(near_search.search(table), rows) >= 0.9


def test_near_awkward_rows(embeddings):
    assert recall(near_search.search(embeddings(AWKWARD)), AWKWARD) == 1
    assert near_search.search(embeddings([])).collect() == []


def test_probes_come_cheapest_first():
    sets = near_search.probe_sets(4, 1000)
    assert sets[0] == () and sets[1] == (0,) and len(sets) == len(set(sets)) == 81


def test_near_meets_its_recall_when_probes_run_out(embeddings, monkeypatch):
    rows = random_vectors(600, 12, 5)
    monkeypatch.setattr(near_search, "MAX_PROBES", 1)
    assert recall(near_search.search(embeddings(rows)), rows) >= 0.96
    v = finite_vectors(embeddings(rows))
    assert recall(near_search.nearest(v.where("vec_id % 20 = 0"), v, recall=1.0), rows) == 1


def test_near_repeated_rows_leave_room_for_other_ids(embeddings):
    rows = [(0, [1, 0.1, 0])] + [(1, [1, 0, 0])] * 25 + [(i, [1, 0, 0]) for i in range(2, 8)] + [(8, [0, 1, 0])]
    assert recall(near_search.search(embeddings(rows)), rows) == 1


def test_near_with_unequal_norms(embeddings, monkeypatch):
    """One long vector, many short ones, and lengths over many powers of two."""
    monkeypatch.setattr(near_search, "CELL", 64)
    r = np.random.default_rng(6)
    unit = r.normal(size=(800, 16))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    long_ = unit * np.concatenate([[100.0], np.ones(799)])[:, None]
    wide = unit * (2.0 ** r.integers(-3, 4, 800))[:, None]
    for v in (long_, wide):
        rows = [(i, x.tolist()) for i, x in enumerate(v)]
        assert recall(near_search.search(embeddings(rows)), rows) >= 0.9


def test_near_long_vectors_with_scores_near_zero(embeddings):
    """Scores far below the rounding of long vectors' products are still told apart."""
    r = np.random.default_rng(7)
    rows = [(0, [1e15, 1e15, 1.0])] + [(i, [1e15, -1e15, float(x)]) for i, x in enumerate(r.permutation(60) + 1, 1)]
    assert recall(near_search.search(embeddings(rows)), rows) == 1


def test_near_short_vectors_count_as_padded(embeddings):
    rows = [(0, [1, 2]), (20, [3]), (1, [0.5, 1, 2]), (2, [1, -1, 0]), (3, [2]), (4, [0, 0, 1])]
    assert recall(near_search.search(embeddings(rows)), rows) == 1


def test_a_hot_cell_is_many_bounded_groups(spark, monkeypatch):
    """All rows and all queries in one cell: groups stay small, and every query meets every row once."""
    monkeypatch.setattr(near_search, "CELL", 50)
    monkeypatch.setattr(near_search, "VISITORS", 40)
    placed = spark.range(1000).selectExpr("3L as cell", "0L as code", "id as vec_id", "cast('v' as binary) as v").union(spark.sql("select 9L, 0L, 5000L, cast('v' as binary)"))
    visits = spark.range(300).selectExpr("3L as in_cell", "id as query", "cast('q' as binary) as q", "cast('c' as binary) as codes")
    rows, visitors = near_search.dealt(placed, visits)
    split = {(x["split"], x["block"]): x["count"] for x in rows.groupBy("split", "block").count().collect()}
    block = {(x["in_split"], x["in_block"]): x["count"] for x in visitors.groupBy("in_split", "in_block").count().collect()}
    assert split.keys() == block.keys() and len(split) == 10 * 8
    assert max(split.values()) <= 200 and max(block.values()) <= 80
    assert sum(n * block[at] for at, n in split.items()) == 1000 * 300
