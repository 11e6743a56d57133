"""Shared helpers: the shared folder, written tables, and words of texts as numpy arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
#: Multiplier of sequence fingerprints and its inverse modulo 2**64, one pair per lane.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only a local session may go without both; a folder is then set for its context.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, name: str, rows_per_task: int = 200_000) -> DataFrame:
    """``df`` written and read back in as many tasks as its rows ask for.  What fits one task is then grouped and joined
    there, without a shuffle; iterations over a shrinking table need this, for their rounds cost little else."""
    out = materialise(df, name)
    return out.coalesce(max(1, -(-out.count() // rows_per_task)))


def chunks(texts: pa.Array, max_bytes: int = 2 << 20, max_docs: int = 4096) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) pieces of a string column, each of bounded size; a longer text is its own piece."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(ends, ends[at] + max_bytes, "right")) - 1
        to = min(max(to, at + 1), at + max_docs, len(texts))
        yield at, texts.slice(at, to - at)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def hashed_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts in a row, and the first word of each text.

    The second array has one entry more than there are texts; a null text has no words. ``lower``
    lower-cases A-Z. No separator occurs inside a multi-byte character, so bytes are enough.
    """
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    n = int(off[-1] - off[0])
    raw = np.zeros(n + 9, np.uint8)
    if n:
        raw[:n] = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    body = raw[:n]
    if lower:
        body[(body >= 65) & (body <= 90)] += 32
    sep = (body == 32) | ((body >= 9) & (body <= 13))
    inside = ~sep
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= sep[:-1]
    stops[:-1] &= sep[1:]
    # a text's edge parts words too
    edges = off[:-1][(off[:-1] < n)]
    begins[edges] = inside[edges]
    edges = off[1:][off[1:] > 0] - 1
    stops[edges] = inside[edges]
    starts, size = np.flatnonzero(begins), None
    size = np.flatnonzero(stops) + 1 - starts
    lanes = np.ndarray((n + 1,), "<u8", raw, strides=(1,))
    out = mix(size.astype(U))
    todo = np.arange(len(starts))
    at = 0
    while len(todo):
        left = size[todo] - at
        lane = lanes[starts[todo] + at]
        short = left < 8
        lane[short] &= (U(1) << (left[short].astype(U) * U(8))) - U(1)
        out[todo] = mix(out[todo] * U(BASES[0]) + lane)
        at += 8
        todo = todo[left > 8]
    return out, np.searchsorted(starts, off)


def powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASES[lane] to the powers 0..n, and its inverse."""
    if lane not in _powers or len(_powers[lane][0]) <= n:
        both = []
        for base in (BASES[lane], pow(BASES[lane], -1, 1 << 64)):
            x = np.full(max(n + 1, 1 << 19), base, U)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers[lane] = (both[0], both[1])
    return _powers[lane]


class Sequences:
    """Fingerprints of any stretch of a row of hashes, in constant time each."""

    def __init__(self, hashes: np.ndarray, lane: int = 0) -> None:
        self.up, self.down = powers(lane, len(hashes))
        self.sums = np.zeros(len(hashes) + 1, U)
        np.cumsum(hashes * self.up[: len(hashes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))
