"""Sharding by histogram sort: near equal bytes per shard, one exchange.

Rows are ordered by (hash of the text, doc_id, a row's own hash), so that equal texts stay together and any
hot text can still be cut. Splitters are found by counting: every round sends a few candidate boundaries
per splitter to all partitions, counts the exact bytes below each, and narrows each splitter's interval,
until the bytes below it are within ``tolerance`` of the wanted share or no finer boundary exists. Only
then rows move, once, each to its place.

Boundaries are 192-bit numbers, one 64-bit part per key column, and the search halves them from the top:
it only cuts inside a group of equal texts when the group is larger than the tolerance.

Defined results: a null text is of its own kind, size 1, crc of no bytes; repeated rows are rows; an empty
table gives no rows; further columns are returned only if asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwatch.llm.common import materialise

SIZE = 1 << 192
HALF = 1 << 63
KEYS = ("k1", "k2", "k3")


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns that sharding needs: doc_id, size, text_crc32 and the three keys, and what is to be carried."""
    text, doc = F.col("text").cast("string"), F.col("doc_id").cast("long")
    raw = F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))
    return docs.select(
        doc.alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.when(text.isNull(), F.lit(-HALF)).otherwise(F.xxhash64(text)).alias("k1"),
        F.coalesce(doc, F.lit(-HALF)).alias("k2"),
        # rows that are equal in all else are told apart, so that they too can be cut
        F.xxhash64(F.monotonically_increasing_id()).alias("k3"),
        *[F.col(f"`{c}`") for c in carry],
    )


def parts(boundary: int) -> tuple[int, int, int]:
    return tuple(((boundary >> s) & ((1 << 64) - 1)) - HALF for s in (128, 64, 0))


def below(boundary: int) -> Column:
    """Whether a row's key lies below the boundary."""
    a, b, c = (F.lit(x) for x in parts(boundary))
    k1, k2, k3 = map(F.col, KEYS)
    return (k1 < a) | ((k1 == a) & ((k2 < b) | ((k2 == b) & (k3 < c))))


def number(key) -> int:
    return sum((key[c] + HALF) << at for c, at in zip(KEYS, (128, 64, 0)))


def between(low: int, high: int, probes: int) -> set[int]:
    """Boundaries that set the keys ``low`` to ``high`` apart from all others, and evenly spaced ones between
    them: at the edges of texts, else of doc_ids, where these differ."""
    out = {low, high + 1}
    for j in range(1, probes + 1):
        x = low + (high - low) * j // probes
        for bits in (128, 64):
            if low >> bits < high >> bits:
                x = max(x >> bits, (low >> bits) + 1) << bits
                break
        out.add(x)
    return out


def splitters(rows: DataFrame, shards: int, tolerance: float, probes: int) -> list[int]:
    """Boundaries between shards. A round is one count over all rows; the driver sees the bytes, rows, and first
    and last key between neighbouring probes, so ``probes`` rows per splitter, whatever the input."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    wanted = [total * i / shards for i in range(1, shards)]
    best = [(w, 0) for w in wanted]  # (bytes off the mark, boundary)
    asked = between(0, SIZE - 1, probes * shards)
    open_ = range(len(wanted)) if total else []
    while open_:
        cuts = sorted(asked)
        spot = sum((F.when(below(x), 0).otherwise(1) for x in cuts), F.lit(0))
        key = F.struct(*KEYS)
        sums = rows.groupBy(spot.alias("i")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        under, asked, still = 0, set(), []
        for b in sorted(sums, key=lambda r: r["i"]):
            low, high = number(b["low"]), number(b["high"])
            for i in open_:
                if under <= wanted[i] < under + b["size"]:
                    best[i] = min(best[i], (wanted[i] - under, low), (under + b["size"] - wanted[i], high + 1))
                    # a finer boundary exists if the stretch holds different keys
                    if best[i][0] > tolerance * total / shards and high > low:
                        asked |= between(low, high, probes)
                        still.append(i)
            under += b["size"]
        open_ = still
    return sorted(x for _, x in best)


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.002, probes: int = 7, rows_per_task: int = 500_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row, and the columns named in ``carry``.

    A shard is one range of keys, laid out by as many tasks as its rows ask for. Each task numbers the rows
    of its range; the first slot of a range is a prefix sum over the ranges before it in its shard.
    """
    rows = materialise(keyed(docs, carry), "sharding")
    cut = splitters(rows, shards, tolerance, probes)
    tasks = max(shards, -(-rows.count() // rows_per_task))
    spot = sum((F.when(below(x), 0).otherwise(1) for x in cut), F.lit(0)).cast("int")
    order = ["shard", *KEYS]
    laid = rows.withColumn("shard", spot).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    laid = laid.withColumns({"task": F.spark_partition_id(), "at": F.monotonically_increasing_id()}).drop(*KEYS)
    laid = materialise(laid, "shards")
    ranges = laid.groupBy("shard", "task").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row per task and shard at most: its size is bounded by the number of tasks
    bases = F.broadcast(ranges.select("shard", "task", (before - F.col("first")).alias("base")))
    return laid.join(bases, ["shard", "task"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("base")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *[f"`{c}`" for c in carry]
    )
