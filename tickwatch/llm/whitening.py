"""Whitening of vectors by shifted CholeskyQR.

Entries are made whole numbers, ``floor(scale * c) + offset``. The fit list holds every distinct vector once: one shuffle
on the vector, combined map-side, so a vector that a third of all rows repeat arrives once per task. Sums are exact, and
rows are centred in whole numbers (``n * x - S``) before anything is multiplied.

The centred rows A = Q R are orthogonalised by passes over the list: each adds up Q'Q (one small matrix a task, added
row by row of the matrix), factors it on the driver, and composes the triangles; the next pass solves the triangular
system for its rows again. A pass whose Q'Q is not yet near the identity adds a shift, which keeps the factorisation
possible for ill-conditioned rows; passes go on until Q'Q is the identity to rounding. The singular values and vectors of
the d x d matrix R are those of A, so the components are found without squaring A's condition. Only matrices of d x d
come to the driver, for d the length of a vector.

Defined results: rows whose vector is null or has a null or non-finite entry are left out; all others stay, also those
without an id or with an id seen before. A vector shorter than the longest is read as if zeros followed. Entries that no
long can hold end at plus or minus 2**61. Components whose variance is zero, or lost in rounding, have a null ``whitened`` and an
``explained`` of 0; if no vector differs from another, ``explained`` is null. A ``deviation`` that no long can hold is
null. Each component's entry of largest size is positive, the first of them on ties. No rows, or only empty vectors, give no
rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwatch.llm.common import materialise
from tickwatch.llm.vectors import finite

FAR = 1 << 61
PASSES = 12
BLOCK = 4096
OUTPUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: number of fitted vectors, exact sums, components as columns, variances, total variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float | None = None
    passes: int = 0

    def scaled(self) -> np.ndarray:
        """Components over the square roots of their variances; no variance gives NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.variances > 0, self.components / np.sqrt(self.variances), np.nan)


def whole(rows: DataFrame, vec: str = "embedding", key: str = "vec_id", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, x) of the rows whose vector has only finite entries."""
    v = F.col(f"`{vec}`").cast("array<double>")
    rows = rows.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & F.forall("v", finite))

    def entry(c):
        scaled = c * F.lit(float(scale))
        return F.when(scaled >= float(FAR), F.lit(FAR)).when(scaled <= float(-FAR), F.lit(-FAR)).otherwise(F.floor(scaled) + F.lit(offset))

    return rows.select("vec_id", F.transform("v", entry).alias("x"))


def matrices(column: pa.Array, d: int, empty: int) -> Iterator[np.ndarray]:
    """The vectors as matrices of whole numbers, ``BLOCK`` rows at a time; short vectors are filled up with ``empty``."""
    for at in range(0, len(column), BLOCK):
        part = column.slice(at, BLOCK)
        ends = part.offsets.to_numpy()
        flat = part.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
        lengths = np.diff(ends)
        if (lengths == d).all():
            yield flat.reshape(-1, d)
        else:
            out = np.full((len(part), d), empty, np.int64)
            row = np.repeat(np.arange(len(part)), lengths)
            out[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], lengths)] = flat
            yield out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact: 64-bit numbers where these suffice, else Python's."""
    mid = [s // n for s in sums]
    near = np.array(mid, np.int64)
    rest = [s - n * m for s, m in zip(sums, mid)]
    # differences of numbers up to 2**61 fit
    far = np.abs(x - near).max(initial=0)
    if (int(far) + 1) * n < 1 << 62:
        return n * (x - near) - np.array(rest, np.int64)
    return n * (x.astype(object) - np.array(mid, object)) - np.array(rest, object)


def deviations(y: np.ndarray) -> list[int | None]:
    """Sums of squares of the rows, exact; null if no long can hold it."""
    if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 1 << 63:
        return (y * y).sum(1).tolist()
    sums = [sum(int(v) ** 2 for v in row) for row in y]
    return [s if s < 1 << 63 else None for s in sums]


def exact_sums(points: DataFrame, d: int, empty: int) -> list[int]:
    """Sums per dimension: a row per task and dimension, in two halves that cannot overflow."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            for x in matrices(batch.column("x"), d, empty):
                high += (x >> 32).sum(0)
                low += (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "high": pa.array(high), "low": pa.array(low)})

    found = points.mapInArrow(part, "i int, high bigint, low bigint").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    sums = [0] * d
    for r in found.collect():
        sums[r["i"]] = (r["high"] << 32) + r["low"]
    return sums


def gram(points: DataFrame, d: int, empty: int, rows_of) -> np.ndarray:
    """Q'Q over all rows of the list, for the rows that ``rows_of`` makes of a block; d x d numbers come to the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in matrices(batch.column("x"), d, empty):
                q = rows_of(x)
                total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "row": pa.array(total.tolist(), pa.list_(pa.float64()))})

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table["row"].combine_chunks()
        total = rows.values.to_numpy().reshape(len(rows), -1)
        # in one order, so that a repeated run gives the same digits
        total = np.sort(total, axis=0).sum(0)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([total.tolist()], pa.list_(pa.float64()))})

    rows = points.mapInArrow(part, "i int, row array<double>").groupBy("i").applyInArrow(add, "i int, row array<double>").collect()
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])])


def factor(g: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """An upper triangle R with R'R = g, plus a shift for what rounding may have taken from g."""
    d = len(g)
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps * np.trace(g) if shifted else 0.0
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, np.finfo(float).eps * np.trace(g))


def solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The rows Q of QR = A, for an upper triangle R: a column after the other, for all rows at once."""
    q = np.empty_like(a)
    for j in range(len(r)):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def fit(points: DataFrame, components: int = 16, empty: int = 1_000_000, passes: int = PASSES) -> Whitening | None:
    """Whitening of the distinct vectors ``x``."""
    d = points.agg(F.max(F.size("x"))).first()[0]
    if not d:
        return None
    short = F.size("x") < d
    full = F.when(short, F.concat("x", F.array_repeat(F.lit(empty).cast("long"), d - F.size("x")))).otherwise(F.col("x"))
    points = materialise(points.select(full.alias("x")).distinct(), "whiten-points")
    n = points.count()
    sums = exact_sums(points, d, empty)

    def rows(x: np.ndarray) -> np.ndarray:
        return centred(x, n, sums).astype(float) / n

    # columns without any variance take no part: their triangle would have no inverse
    g = gram(points, d, empty, rows)
    live = np.flatnonzero(np.diag(g) > 0)
    k = min(components, d)
    if not len(live):
        return Whitening(n, sums, np.eye(d)[:, :k], np.zeros(k), 0.0)
    size = np.sqrt(np.diag(g)[live])  # columns of length one: the shift then suits all of them
    r, done, g = np.diag(size), 0, g[np.ix_(live, live)] / np.outer(size, size)
    while done < passes:
        off = np.abs(g - np.eye(len(live))).max()
        if done and off < 100 * len(live) * np.finfo(float).eps:
            break
        r = factor(g, n, off > 0.5) @ r
        done += 1
        triangle = r

        def orthogonal(x: np.ndarray) -> np.ndarray:
            return solved(rows(x)[:, live], triangle)

        g = gram(points, d, empty, orthogonal)
    _, s, vt = np.linalg.svd(r)
    s[s <= s[0] * max(n, len(live)) ** 0.5 * 8 * np.finfo(float).eps] = 0.0
    vectors, variances = np.zeros((d, d)), np.zeros(d)
    vectors[live[:, None], np.arange(len(live))] = vt.T
    vectors[np.setdiff1d(np.arange(d), live), np.arange(len(live), d)] = 1.0
    variances[: len(live)] = s * s / n
    top = vectors[np.abs(vectors).argmax(0), np.arange(d)]
    vectors = vectors * np.where(top < 0, -1.0, 1.0)
    model = Whitening(n, sums, vectors[:, :k], variances[:k], float(variances.sum()), None, done)
    scaled = model.scaled()[:, model.variances > 0]
    if scaled.shape[1]:
        # measured on the whole list, not assumed
        off = np.abs(gram(points, d, empty, lambda x: rows(x) @ scaled) / n - np.eye(scaled.shape[1])).max()
        model = Whitening(n, sums, model.components, model.variances, model.total, float(off), done)
    return model


def transform(points: DataFrame, model: Whitening, empty: int = 1_000_000) -> DataFrame:
    """A row per vector and component, as ``OUTPUT``."""
    scaled, k = model.scaled(), len(model.variances)
    explained = [float(v / model.total) if model.total > 0 else None for v in model.variances]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in matrices(batch.column("x"), len(model.sums), empty):
                y, m = centred(x, model.n, model.sums), len(x)
                white = (y.astype(float) / model.n) @ scaled
                ids = batch.column("vec_id").slice(at, m)
                at += m
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n)), pa.array(deviations(y), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(white.ravel(), from_pandas=True), pa.array(explained * m, pa.float64()), pa.array([model.identity_error] * (m * k), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return points.mapInArrow(part, OUTPUT)


def whiten(rows: DataFrame, components: int = 16, vec: str = "embedding", key: str = "vec_id", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """Fit on the distinct vectors of ``rows`` and whiten all rows."""
    points = whole(rows, vec, key, scale, offset)
    model = fit(points, components, offset)
    if model is None:
        return rows.sparkSession.createDataFrame([], OUTPUT)
    return transform(points, model, offset)
