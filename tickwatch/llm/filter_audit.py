"""What each filter of a chain removes, in every order: sorted posting lists, merged by galloping.

Documents are ordered by (part, doc_id) and cut into ranges of at most ``RANGE`` rows that never cross a part. A range
keeps one sorted posting list per filter, the places of the rows that fail it, beside lists of the good and the toxic
rows. For every filter and every set of filters that may stand before it, the union of the lists before and the
difference to it are galloping merges inside the range; only sizes leave a range, and sizes add up. The 120 orders are
then read off these sums, so that no order costs a pass of its own.

A text that an earlier document has is found by SHA-256. Copies of one text may be a third of all rows: the first id of
a text is a map-side minimum, and the texts that take more than a thousandth of all rows, under a thousand of them by
that very count, are looked up by broadcast, the others by a join whose keys are then all small.

Defined results: a null text is empty and has copies like any other; a null lang is the part ``''``; a row without
doc_id comes first in its part, is nobody's copy and has no copies; rows of one doc_id are rows of their own, and not
copies of each other; a doc_id with several labels is good (toxic) if any of them says so; labels without doc_id count
for nothing; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwatch.llm.common import materialise
from tickwatch.model import local_frame

FILTERS = "ABCDE"
RANGE = 1 << 16
LISTS = (*FILTERS, "good", "toxic")
POSTINGS = "part string, doc_ids array<bigint>, " + ", ".join(f"`{x}` array<int>" for x in LISTS)
SIZES = ("n", "before_size", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
MERGED = "part string, filter int, before int, " + ", ".join(f"{x} bigint" for x in SIZES)
_STRIDE = 64


# --- sorted lists -------------------------------------------------------------


def gallop(keys: np.ndarray, into: np.ndarray) -> np.ndarray:
    """For each of the sorted ``keys`` the number of entries of the sorted ``into`` that are smaller.

    Every 64th key is bisected; each key between goes on from there in doubling steps, all keys at once, and
    bisects its last step only.
    """
    if not len(into):
        return np.zeros(len(keys), np.int64)
    heads = np.searchsorted(into, keys[::_STRIDE])
    low = np.repeat(heads, _STRIDE)[: len(keys)]
    high = np.repeat(np.append(heads[1:], len(into)), _STRIDE)[: len(keys)]
    step, going = 1, np.arange(len(keys))
    while len(going):
        to = np.minimum(low[going] + step, high[going])
        over = (to > low[going]) & (into[to - 1] < keys[going])
        high[going[~over]] = to[~over]
        going = going[over]
        low[going] = to[over]
        step *= 2
    going = np.flatnonzero(low < high)
    while len(going):
        mid = (low[going] + high[going]) // 2
        smaller = into[mid] < keys[going]
        low[going[smaller]] = mid[smaller] + 1
        high[going[~smaller]] = mid[~smaller]
        going = going[low[going] < high[going]]
    return low


def missing(keys: np.ndarray, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of ``keys`` is not in ``into``, and where it stands or would stand there."""
    at = gallop(keys, into)
    if not len(into):
        return np.ones(len(keys), bool), at
    return (at == len(into)) | (into[np.minimum(at, len(into) - 1)] != keys), at


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    short, long_ = (a, b) if len(a) < len(b) else (b, a)
    new, at = missing(short, long_)
    return np.insert(long_, at[new], short[new])


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[missing(a, b)[0]]


def interactions(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray, n: int) -> Iterator[tuple[int, ...]]:
    """(filter, set of filters before it as bits, then ``SIZES``) for every filter and set of others."""
    k = len(lists)
    unions = [np.zeros(0, np.int32)]
    for mask in range(1, 1 << k):
        top = mask.bit_length() - 1
        unions.append(union(unions[mask ^ (1 << top)], lists[top]))
    everything = (1 << k) - 1
    for f, own in enumerate(lists):
        alone = len(difference(own, unions[everything ^ (1 << f)]))
        for before in range(1 << k):
            if not before >> f & 1:
                removed = difference(own, unions[before])
                lost = [len(removed) - len(difference(removed, marked)) for marked in (good, toxic)]
                yield (f, before, n, len(unions[before]), len(removed), len(own) - len(removed), alone, *lost)


# --- failing documents ------------------------------------------------------------


def judged(docs: DataFrame) -> DataFrame:
    """part, doc_id, the text's digest, and whether each filter that looks at one text fails (null text: empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    rows = rows.withColumn("w", F.array_remove(F.split("t", "[\\x20\\x09-\\x0D]+"), ""))
    words, distinct = F.size("w"), F.size(F.array_distinct("w"))
    capitals = F.length(F.regexp_replace("t", "[^A-Z]+", ""))
    return rows.select(
        "part", "doc_id", F.unhex(F.sha2("t", 256)).alias("digest"),
        (words < 100).alias("A"), (100 * distinct < 80 * words).alias("B"), (100 * capitals > 10 * F.length("t")).alias("C"), F.col("t").rlike("[#$%&*|]").alias("D"),
    )


def copies(rows: DataFrame) -> DataFrame:
    """``rows`` with E: whether a smaller doc_id has the same digest."""
    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1 and first_id is not null")
    texts = materialise(texts, "audit-texts")
    often = max(rows.count() // 1000, 1000)
    # each has more than a thousandth of all rows, so there are fewer than a thousand
    hot = F.broadcast(texts.where(F.col("copies") > often).drop("copies"))
    cold = texts.where(F.col("copies") <= often).drop("copies")
    rest = rows.join(hot, "digest", "left_anti").join(cold, "digest", "left")
    both = rows.join(hot, "digest").unionByName(rest)
    return both.withColumn("E", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))).drop("digest", "first_id")


def marked(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with good (quality 1) and toxic (toxic 1) from the labels."""
    says = [F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*says).where("good or toxic")
    return rows.join(known, "doc_id", "left").fillna(False, ["good", "toxic"])


# --- posting lists -----------------------------------------------------------------


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists of the sorted rows of a task, a range at a time."""
    held: list[pa.Table] = []

    def listed(table: pa.Table) -> pa.RecordBatch:
        out = {"part": table["part"][:1].combine_chunks(), "doc_ids": pa.array([table["doc_id"].combine_chunks()], pa.list_(pa.int64()))}
        for x in LISTS:
            out[x] = pa.array([np.flatnonzero(table[x].to_numpy()).astype(np.int32)], pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(out)

    for batch in batches:
        parts = batch.column("part").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)] if len(parts) else [0]
        for low, high in zip(edges, edges[1:]):
            while low < high:
                if held and (held[0]["part"][0].as_py() != parts[low] or sum(map(len, held)) == RANGE):
                    yield listed(pa.concat_tables(held))
                    held = []
                take = min(high - low, RANGE - sum(map(len, held)))
                held.append(pa.Table.from_batches([batch.slice(low, take)]))
                low += take
    if held:
        yield listed(pa.concat_tables(held))


def postings(rows: DataFrame, rows_per_task: int = 1_000_000) -> DataFrame:
    """One row per range: its part, its doc_ids in order, and per filter the places that fail it, from 0."""
    rows = materialise(rows, "audit-rows")
    # rows that are equal in part and doc_id are dealt out too
    rows = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    order = ["part", "doc_id", "tie"]
    tasks = max(1, -(-rows.count() // rows_per_task))
    laid = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("part", "doc_id", *LISTS)
    return laid.mapInArrow(cut, POSTINGS)


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            lists = {x: batch.column(x)[i].values.to_numpy(zero_copy_only=False) for x in LISTS}
            found = list(interactions([lists[x] for x in FILTERS], lists["good"], lists["toxic"], len(batch.column("doc_ids")[i])))
            names = ["filter", "before", *SIZES]
            out = {"part": pa.array([batch.column("part")[i].as_py()] * len(found), pa.string())}
            out |= {x: pa.array([row[at] for row in found], pa.int32() if at < 2 else pa.int64()) for at, x in enumerate(names)}
            yield pa.RecordBatch.from_pydict(out)


def orders() -> list[dict]:
    """Every step of every order: its filter and the set of filters before it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        for step, f in enumerate(order, 1):
            out.append({"filter_order": "".join(FILTERS[x] for x in order), "step": step, "filter": f, "before": sum(1 << x for x in order[: step - 1])})
    return out


def audit(lists: DataFrame) -> DataFrame:
    """One row per part, order and step, from the posting lists."""
    sums = lists.mapInArrow(merged, MERGED).groupBy("part", "filter", "before").agg(*[F.sum(x).alias(x) for x in SIZES])
    # 600 rows, whatever the input
    steps = F.broadcast(local_frame(lists.sparkSession, orders(), "filter_order string, step int, filter int, before int"))
    return sums.join(steps, ["filter", "before"]).select(
        "part", "filter_order", "step",
        (F.col("n") - F.col("before_size") - F.col("removed")).alias("kept"),
        "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        F.sum("removed").over(W.partitionBy("part", "filter")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs``."""
    rows = materialise(judged(docs), "audit-judged")
    lists = materialise(postings(marked(copies(rows), labels)), "audit-lists")
    return audit(lists)
