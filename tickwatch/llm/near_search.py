"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are cut into bands of norms, a factor of two each, so that a few long vectors do not make the others look alike. Within a
band, largest inner product becomes smallest distance: every vector gets one more component, so that all have the band's
largest norm ``M``; queries are scaled to ``M``. Each of ``tables`` hash tables cuts ``K`` Gaussian projections
into steps of width ``2 * M``; K grows with the logarithm of the number of vectors. A query visits its own
bucket and then perturbed ones (steps up or down by one), in the order of their estimated success: the sum of
squared distances to the step borders it would have to cross. Bands of fewer than ``CELL`` rows share one bucket that every query
visits.

The number of probes is fitted in each band, not guessed: ``SAMPLE`` queries are answered exactly, and the smallest number of
probes is taken with which their neighbours in the band would have been found with ``recall`` (0.96 by default). If not even
MAX_PROBES reach it, K is lowered by one and the probes are fitted anew; K = 0 is one bucket with all rows, an exact
search, so the target is always met on the sample. All rows are indexed. Candidates from all tables are ranked by the inner
product of the original vectors in double precision, added from the first component to the last.

Scale: buckets are dealt to cells of about ``CELL`` rows; larger cells are split by row, and the queries that visit a cell are
dealt into blocks of about ``VISITORS``, so a hot bucket is many groups of bounded size. Of equal vectors only the k + 1 smallest ids
enter the index, as no query can return more, repeated rows count once, and equal queries are answered once. A query goes to a
cell once, with all its probes there. The driver sees a row per band, of which doubles have about two thousand.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite components take no part, nor do
rows without vec_id; a vector shorter than the longest counts as if zeros followed. Rows with the query's vec_id are no
candidates for it; a repeated query is answered once. Fewer than k candidates found give fewer rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwatch.llm.common import materialise, mix
from tickwatch.llm.vectors import finite_vectors

#: Queries that the number of probes is fitted on.
SAMPLE = 128
CELL = 8192
#: Queries that meet a split of a cell in one group, about.
VISITORS = 4096
MAX_PROBES = 4096
U = np.uint64
#: Lists of candidates that are merged in one task's group.
MERGED = 30_000
LISTS = "query long, ids binary, scores binary"
FOUND = "query long, vec_id long, score double"


def probe_sets(k: int, most: int) -> list[tuple[int, ...]]:
    """Sets of border crossings in the order of their expected cost, where crossing j is the j-th cheapest of 2k.

    The expected square of the j-th smallest of 2k distances is known in closed form; sets are made cheapest
    first from a heap by moving or adding the last member. No set crosses both borders of one projection.
    """
    near = [j * (j + 1) / (4 * (k + 1) * (k + 2)) for j in range(1, k + 1)]
    cost = near + [1 - 2 * (j / (2 * (k + 1))) + c for j, c in zip(range(k, 0, -1), reversed(near))]
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))] if k else []
    while heap and len(out) < most:
        _, made = heapq.heappop(heap)
        if len({min(j, 2 * k - 1 - j) for j in made}) == len(made):
            out.append(made)
        last = made[-1]
        if last + 1 < 2 * k:
            for more in ((*made[:-1], last + 1), (*made, last + 1)):
                heapq.heappush(heap, (sum(cost[j] for j in more), more))
    return out


class Hashes:
    """The tables' projections, the same in every process."""

    def __init__(self, dim: int, tables: int, k: int, width: float, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.tables, self.k, self.dim = tables, k, dim
        self.a = rng.normal(size=(tables, dim, k)) / width
        self.b = rng.uniform(size=(tables, k))

    def steps(self, x: np.ndarray, table: int) -> np.ndarray:
        return x @ self.a[table] + self.b[table]

    def codes(self, cells: np.ndarray, table: int) -> np.ndarray:
        """One number for each bucket, its last axis being the steps."""
        out = np.full(cells.shape[:-1], table + 1, U)
        for j in range(cells.shape[-1]):
            out = mix(out * U(0x9E3779B97F4A7C15) + cells[..., j].astype(np.int64).astype(U))
        return out

    def probes(self, q: np.ndarray, table: int, sets: list[tuple[int, ...]]) -> np.ndarray:
        """Bucket numbers (query, probe) in the order in which to visit them."""
        at = self.steps(q, table)
        home = np.floor(at)
        up = at - home
        order = np.argsort(np.hstack([up, 1 - up]), axis=1, kind="stable")
        cells = np.repeat(home[:, None, :], len(sets), axis=1)
        rows = np.arange(len(q))
        for p, crossed in enumerate(sets):
            for j in crossed:
                x = order[:, j]
                cells[rows, p, x % self.k] += np.where(x < self.k, -1, 1)
        return self.codes(cells, table)


def lifted(v: np.ndarray, largest: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(largest**2 - (v**2).sum(axis=1), 0))[:, None]])


def scaled(q: np.ndarray, largest: float) -> np.ndarray:
    norms = np.sqrt((q**2).sum(axis=1))[:, None]
    return np.hstack([q / norms * largest, np.zeros((len(q), 1))])


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row inner products, added from the first component to the last."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * v[:, j]
    return out


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def unpacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)


def best_of(q: np.ndarray, ids: np.ndarray, v: np.ndarray, row: np.ndarray, col: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score): the ``k`` best of the pairs (row, col), exactly scored; ``row`` ascends."""
    if len(row) > 0.05 * len(q) * len(v):  # most pairs: one matrix product is cheaper than gathering
        near = (q @ v.T)[row, col]
    else:
        near = np.einsum("ij,ij->i", q[row], v[col])
    # the quick product is off by no more than this; what may be among the k best by it is scored exactly
    off = 1e-15 * (q.shape[1] + 8) * np.sqrt((q**2).sum(axis=1))[row] * np.sqrt((v**2).sum(axis=1))[col]
    order = np.lexsort((off - near, row))
    row, col, near, off = row[order], col[order], near[order], off[order]
    first = np.searchsorted(row, row)
    last = np.minimum(first + k, np.searchsorted(row, row, "right")) - 1
    keep = ~(near + off < (near - off)[last])
    row, col = row[keep], col[keep]
    score = exact(q[row], v[col])
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[top], ids[col[top]], score[top]


def sampled(index: DataFrame, queries: DataFrame, k: int) -> tuple[np.ndarray, pd.DataFrame]:
    """The sample's queries, and their exact neighbours (query, vec_id, score, v, band), the query being its row."""
    sample = queries.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toPandas()
    if sample.empty:
        return np.zeros((0, 1)), pd.DataFrame({"query": [], "v": [], "band": []})
    q, own = stacked(sample["v"]), sample["vec_id"].to_numpy()

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame({"query": [], "vec_id": [], "score": [], "v": [], "band": []})
        for batch in batches:
            ids, v = batch["vec_id"].to_numpy(), stacked(batch["v"])
            row, col = np.nonzero(ids[None, :] != own[:, None])
            row, place, score = best_of(q, np.arange(len(v)), v, row, col, k)
            new = pd.DataFrame({"query": row, "vec_id": ids[place], "score": score, "v": list(v[place]), "band": batch["band"].to_numpy()[place]})
            kept = pd.concat([kept, new]).sort_values(["query", "score", "vec_id"], ascending=[True, False, True]).groupby("query").head(k)
        yield kept.astype({"query": "int64", "vec_id": "int64", "band": "int64"})

    lists = index.mapInPandas(nearest, f"{FOUND}, v array<double>, band long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return q, lists.withColumn("r", rank).where(F.col("r") <= k).toPandas()  # SAMPLE * k rows


def fitted(q: np.ndarray, true: pd.DataFrame, hashes: Hashes, largest: float, recall: float) -> int | None:
    """How many probes find the neighbours ``true`` of the sample ``q`` with ``recall``; None if MAX_PROBES are too few."""
    if true.empty:
        return 1
    sets = probe_sets(hashes.k, MAX_PROBES)
    x, who = lifted(stacked(true["v"]), largest), true["query"].to_numpy()
    need = np.full(len(true), len(sets))
    for t in range(hashes.tables):
        home = hashes.codes(np.floor(hashes.steps(x, t)), t)
        for at in range(0, len(q), 16):
            probes = hashes.probes(scaled(q[at : at + 16], largest), t, sets)
            for n in np.flatnonzero((who >= at) & (who < at + 16)):
                hit = np.flatnonzero(probes[who[n] - at] == home[n])
                if len(hit):
                    need[n] = min(need[n], hit[0])
    last = int(np.sort(need)[min(len(need) - 1, int(np.ceil(recall * len(need))))])
    return last + 1 if last < len(sets) else None


@dataclass
class Band:
    """The tables of a band of norms: its number (None: all small bands), rows, hashes, probes, and its cells' first number."""

    number: int | None
    rows: int
    largest: float
    hashes: Hashes
    sets: list[tuple[int, ...]]
    cells: int
    first: int

    @property
    def end(self) -> int:
        return self.first + self.hashes.tables * self.cells

    @property
    def visited(self) -> int:
        """Cells' splits that a query visits, at most."""
        return self.hashes.tables * min(len(self.sets), self.cells) if self.hashes.k else -(-self.rows // (2 * CELL)) + 1

    def of(self, bands: np.ndarray, large: list[int]) -> np.ndarray:
        return ~np.isin(bands, large) if self.number is None else bands == self.number


def tables_of(index: DataFrame, q: np.ndarray, true: pd.DataFrame, dim: int, tables: int, recall: float) -> list[Band]:
    """The bands of ``index`` (vec_id, v, band, norm), each with the fewest probes that reach ``recall`` on the sample."""
    out: list[Band] = []
    small, first = 0, 0
    for r in index.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("largest")).orderBy("band").collect():
        if r["n"] < CELL or not 1e-150 < r["largest"] < 1e150:
            small += r["n"]
            continue
        here = true[true["band"] == r["band"]]
        probes, cuts = None, max(3, round(np.log2(r["n"]) / 2)) + 1
        while probes is None:
            cuts -= 1
            # without projections one table holds all
            hashes = Hashes(dim + 1, tables if cuts else 1, cuts, 2 * r["largest"])
            probes = fitted(q, here, hashes, r["largest"], recall)
        out.append(Band(r["band"], r["n"], r["largest"], hashes, probe_sets(cuts, probes), -(-r["n"] // CELL), first))
        first = out[-1].end
    if small:
        out.append(Band(None, small, 1.0, Hashes(dim + 1, 1, 0, 1.0), [()], 1, first))
    return out


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20, tables: int = 8, recall: float = 0.96) -> DataFrame:
    """The ``k`` nearest found of ``vectors`` for each of ``queries``, both (vec_id, v): query_id, rank, vec_id, score."""
    dim = vectors.agg(F.max(F.size("v"))).first()[0] or 1

    def usable(rows: DataFrame) -> DataFrame:
        padded = F.concat("v", F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(dim) - F.size("v"))))
        return rows.where(F.exists("v", lambda x: x != 0)).withColumn("v", F.when(F.size("v") < dim, padded).otherwise(F.col("v")))

    copies = Window.partitionBy("v").orderBy("vec_id")
    index = usable(vectors).select("vec_id", "v").distinct().withColumn("r", F.row_number().over(copies)).where(F.col("r") <= k + 1).drop("r")
    # borders of bands at odd powers of the square root of two: unit vectors are one band
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    index = materialise(index.withColumn("norm", norm).withColumn("band", F.floor(F.log2("norm") + 0.5).cast("long")).na.fill(-(1 << 20), ["band"]), "vectors")
    asked = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    alike = materialise(asked.groupBy("v").agg(F.min("vec_id").alias("query")), "queries")
    q, true = sampled(index, alike.select(F.col("query").alias("vec_id"), "v"), k)
    bands = tables_of(index, q, true, dim, tables, recall)
    large = [b.number for b in bands if b.number is not None]

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                for band in bands:
                    piece = batch.iloc[at : at + 2048]
                    piece = piece[band.of(piece["band"].to_numpy(), large)]
                    if not len(piece):
                        continue
                    v = stacked(piece["v"])
                    raw, x = [r.tobytes() for r in v.astype("<f8")], lifted(v, band.largest) if band.hashes.k else np.zeros((len(v), dim + 1))
                    for t in range(band.hashes.tables):
                        code = band.hashes.codes(np.floor(band.hashes.steps(x, t)), t)
                        cell = band.first + t * band.cells + (code % U(band.cells)).astype(np.int64)
                        yield pd.DataFrame({"cell": cell, "code": code.view(np.int64), "vec_id": piece["vec_id"].to_numpy(), "v": raw})

    def probing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, (1 << 20) // max([1, *(len(b.sets) * b.hashes.k for b in bands)]))
        for batch in batches:
            for at in range(0, len(batch), step):
                piece = batch.iloc[at : at + step]
                q = stacked(piece["v"])
                raw, ids = [r.tobytes() for r in q.astype("<f8")], piece["query"].to_numpy()
                for band in bands:
                    x = scaled(q, band.largest)
                    for t in range(band.hashes.tables):
                        codes = band.hashes.probes(x, t, band.sets)
                        where = band.first + t * band.cells + (codes % U(band.cells)).astype(np.int64)
                        rows = []
                        for i in range(len(q)):
                            order = np.argsort(where[i], kind="stable")
                            edges = np.flatnonzero(np.diff(where[i][order], prepend=-1))
                            for some in np.split(order, edges[1:]):
                                rows.append((where[i][some[0]], ids[i], raw[i], codes[i][some].tobytes()))
                        yield pd.DataFrame(rows, columns=["in_cell", "query", "q", "codes"])

    placed = materialise(index.mapInPandas(indexed, "cell long, code long, vec_id long, v binary"), "index")
    visits = materialise(alike.mapInPandas(probing, "in_cell long, query long, q binary, codes binary"), "visits")
    placed, visits = dealt(placed, visits)

    def search_cell(visitors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(visitors):
            rows = rows.sort_values(["code", "vec_id"], kind="stable")
            code, ids, v = rows["code"].to_numpy(), rows["vec_id"].to_numpy(), unpacked(rows["v"])
            block = 128
            for at in range(0, len(visitors), block):
                piece = visitors.iloc[at : at + block]
                q, codes = unpacked(piece["q"]), [np.frombuffer(c, "<i8") for c in piece["codes"]]
                flat, row = np.concatenate(codes), np.repeat(np.arange(len(piece)), [len(c) for c in codes])
                lo, hi = np.searchsorted(code, flat), np.searchsorted(code, flat, "right")
                many = hi - lo
                col = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - lo, many)
                row, hit, score = best_of(q, ids, v, np.repeat(row, many), col, k + 1)
                edges = np.flatnonzero(np.diff(row, prepend=-1))
                for a, b in zip(edges, [*edges[1:], len(row)]):
                    found.append((piece["query"].iloc[row[a]], hit[a:b].astype("<i8").tobytes(), score[a:b].astype("<f8").tobytes()))
        return pd.DataFrame(found, columns=["query", "ids", "scores"])

    def merge(lists: pd.DataFrame) -> pd.DataFrame:
        row = np.repeat(lists["query"].to_numpy(), lists["ids"].map(len).to_numpy() // 8)
        ids, score = np.frombuffer(b"".join(lists["ids"]), "<i8"), np.frombuffer(b"".join(lists["scores"]), "<f8")
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        # one candidate from several tables has the same score in all
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
        row, ids, score = row[new], ids[new], score[new]
        top = np.arange(len(row)) - np.searchsorted(row, row) <= k
        return pd.DataFrame({"query": row[top], "vec_id": ids[top], "score": score[top]})

    lists = visits.groupBy("in_cell", "in_split", "in_block").cogroup(placed.groupBy("cell", "split", "block")).applyInPandas(search_cell, LISTS)
    # as many groups of queries as keep a group at MERGED lists
    groups = max(1, -(-alike.count() * sum(b.visited for b in bands) // MERGED))
    top = lists.groupBy(F.pmod(F.xxhash64("query"), F.lit(groups))).applyInPandas(merge, FOUND)
    named = asked.join(alike, "v").select(F.col("vec_id").alias("query_id"), "query")
    answers = named.join(top, "query").where(F.col("vec_id") != F.col("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def dealt(placed: DataFrame, visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``placed`` with (split, block) and ``visits`` with (in_split, in_block): a cell's rows are cut into splits and its visitors
    into blocks, and each split meets each block in a group of its own. Cells without visitors go."""
    splits = placed.groupBy("cell").agg(F.ceil(F.count("*") / (2 * CELL)).alias("splits"))
    blocks = visits.groupBy("in_cell").agg(F.ceil(F.count("*") / VISITORS).alias("blocks"))
    sizes = materialise(splits.join(blocks, F.col("cell") == F.col("in_cell")).drop("in_cell"), "cells")

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    rows = placed.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("splits")).alias("split"), each("blocks").alias("block"), "code", "vec_id", "v")
    sizes = sizes.withColumnRenamed("cell", "in_cell")
    visitors = visits.join(sizes, "in_cell").select("in_cell", each("splits").alias("in_split"), F.pmod(F.xxhash64("query"), F.col("blocks")).alias("in_block"), "query", "q", "codes")
    return rows, visitors


def search(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """Every row whose vec_id is divisible by ``every`` against all rows."""
    vectors = finite_vectors(embeddings)
    return nearest(vectors.where(F.col("vec_id") % every == 0), vectors, k)
