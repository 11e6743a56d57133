"""Exact top-k search by inner product, as tiled matrix products.

Vectors and queries are cut into tiles of fixed size. Every pair of a query tile and a vector tile is one
matrix product in one task; it hands on the ``k`` best of each query only. Lists of one query tile are then
merged as a tree, ``FAN`` at a time, so that no task ever sees more than ``FAN`` lists per query.

Components become floor(64 * x), so scores are whole numbers and ties are exact. Defined results: vectors
that are null, empty, or hold null or non-finite components take no part, nor do rows without vec_id.
vec_id names a row: rows with the query's vec_id are its own and no candidates for it; repeated rows of
other ids are candidates each, and equal (score, vec_id) are ranked as they come. A repeated query is
answered once. Vectors of another length than the longest count as followed by zeros. Scores must fit
64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwatch.llm.common import materialise
from tickwatch.llm.vectors import finite_vectors

FAN = 16
TILE = "tile long, n int, ids binary, rows binary"
TOP = "q_tile long, part long, queries binary, ids binary, scores binary"
RESULT = "query_id long, rank int, vec_id long, score long"
NONE = np.iinfo(np.int64).min


def tiles(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors (vec_id, q array<long>) as rows of up to ``size`` vectors each, cut within each partition."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ids: list[int] = []
        rows: list[np.ndarray] = []
        made = TaskContext.get().partitionId() << 32

        def tile() -> pd.DataFrame:
            width = max(map(len, rows))
            block = np.zeros((len(rows), width), "<i8")
            for i, r in enumerate(rows):
                block[i, : len(r)] = r
            return pd.DataFrame([(made, len(rows), np.array(ids, "<i8").tobytes(), block.tobytes())], columns=["tile", "n", "ids", "rows"])

        for batch in batches:
            for i, r in zip(batch["vec_id"], batch["q"]):
                ids.append(i)
                rows.append(r)
                if len(rows) == size:
                    yield tile()
                    made, ids, rows = made + 1, [], []
        if rows:
            yield tile()

    return vectors.mapInPandas(cut, TILE)


def unpack(n: int, ids: bytes, rows: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<i8").reshape(n, -1)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores of each row and their ids, best first, ties to the smaller id. One id per
    column, ascending; NONE is no candidate."""
    if scores.shape[1] > 4 * k:  # drop what lies below the k-th score; its ties stay
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        row, col = np.nonzero((scores >= kth[:, None]) & (scores > NONE))
        at = np.arange(len(row)) - np.searchsorted(row, row)
        short = np.full((len(scores), max(1, int(at.max(initial=0)) + 1)), NONE)
        short_ids = np.zeros_like(short)
        short[row, at], short_ids[row, at] = scores[row, col], ids[col]
        ids, scores = short_ids, short
    ids = np.broadcast_to(ids, scores.shape)
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products; in floating point, which is far faster, where that cannot round."""
    width = min(q.shape[1], v.shape[1])
    q, v = q[:, :width], v[:, :width]
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * width < 1 << 52:
        return (q.astype(float) @ v.astype(float).T).astype(np.int64)
    return q @ v.T


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 20, query_tile: int = 1024, vector_tile: int = 8192) -> DataFrame:
    """The ``k`` best of ``vectors`` for each of ``queries``, both (vec_id, v): query_id, rank, vec_id, score."""
    whole = F.transform("v", lambda x: F.floor(x * 64).cast("long")).alias("q")
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", whole)
    asked = materialise(tiles(asked.repartition(tasks(asked, query_tile)), query_tile).withColumnRenamed("tile", "q_tile"), "query-tiles")
    given = vectors.select("vec_id", whole)
    given = materialise(tiles(given.repartition(tasks(given, vector_tile)), vector_tile), "vector-tiles")
    # the grid of tiles: every query meets every vector, a tile at a time, and ids alone are paired
    n = max(1, given.select("tile").count())
    named = given.groupBy().agg(F.array_sort(F.collect_list("tile")).alias("all")).select(F.posexplode("all").alias("part", "tile"))
    given = given.join(named.withColumn("part", F.col("part").cast("long")), "tile")
    grid = asked.select("q_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("part"))
    cells = grid.join(asked.select("q_tile", F.col("n").alias("qn"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows")), "q_tile").join(given, "part")

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c in batch.itertuples():
                (q_ids, q), (ids, v) = unpack(c.qn, c.q_ids, c.q_rows), unpack(c.n, c.ids, c.rows)
                order = np.argsort(ids, kind="stable")
                ids, v = ids[order], v[order]
                found = []
                for at in range(0, len(q), 128):
                    scores = product(q[at : at + 128], v)
                    scores[ids[None, :] == q_ids[at : at + 128, None]] = NONE
                    found.append(best(ids, scores, k))
                yield pd.DataFrame([(c.q_tile, c.part, c.q_ids, *(np.vstack(x).tobytes() for x in zip(*found)))], columns=["q_tile", "part", "queries", "ids", "scores"])

    lists = cells.mapInPandas(multiply, TOP)
    while n > 1:
        n = -(-n // FAN)
        lists = lists.withColumn("part", F.pmod("part", F.lit(n))).groupBy("q_tile", "part").applyInPandas(lambda x: merged(x, k), TOP)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c in batch.itertuples():
                queries_ = np.frombuffer(c.queries, "<i8")
                ids, scores = (np.frombuffer(x, "<i8").reshape(len(queries_), -1) for x in (c.ids, c.scores))
                ranks = np.broadcast_to(np.arange(1, ids.shape[1] + 1), ids.shape)
                frame = pd.DataFrame({"query_id": np.repeat(queries_, ids.shape[1]), "rank": ranks.ravel(), "vec_id": ids.ravel(), "score": scores.ravel()})
                yield frame[frame["score"] > NONE]

    return lists.mapInPandas(rows, RESULT)


def tasks(df: DataFrame, tile: int) -> int:
    return max(1, -(-df.count() // tile))


def merged(group: pd.DataFrame, k: int) -> pd.DataFrame:
    """The lists of one query tile as one."""
    first = group.iloc[0]
    n = len(first["queries"]) // 8
    ids, scores = (np.hstack([np.frombuffer(x, "<i8").reshape(n, -1) for x in group[c]]) for c in ("ids", "scores"))
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]
    ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    return pd.DataFrame([(first["q_tile"], first["part"], first["queries"], ids.tobytes(), scores.tobytes())], columns=["q_tile", "part", "queries", "ids", "scores"])


def search(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """Every row whose vec_id is divisible by ``every`` against all rows."""
    vectors = finite_vectors(embeddings)
    return top_k(vectors.where(F.col("vec_id") % every == 0), vectors, k)
