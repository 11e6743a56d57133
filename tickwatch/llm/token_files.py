"""Token-ID files: flat unsigned integers, 64-bit document offsets, memory-mapped reading.

A data set is a folder with three files per part:

* ``part-N.ids``: the ids of all its documents, one after the other, unsigned little-endian, 16 bits
  wide if the vocabulary fits, else 32;
* ``part-N.offsets``: one signed 64-bit integer per document and one more, the first always 0: document
  ``i`` has the ids ``offsets[i]`` to ``offsets[i + 1]``;
* ``part-N.docs``: the documents' integer ids, 64 bits each; a null id is the smallest integer.

Parts hold ascending ranges of doc_id and are themselves in that order. Where a part begins in the whole
is a prefix sum over the parts' sizes; that list, one row per part, is all that reaches the driver.

Defined results: a null text has no ids but the end id; an empty table gives no parts; documents without
an id come first; repeated ids follow each other in the order of their texts; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwatch.llm.common import shared_dir
from tickwatch.llm.encoder import byte_encoder

NO_ID = -(1 << 63)
PART = "part int, n_docs long, n_tokens long, width int"
SPANS = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Documents that wait in memory before they are written.
BATCH = 64


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """A store and a path in it, for a path or any URI that Arrow's file systems know."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, parts: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into ``folder``.

    Returns the manifest: part, n_docs, n_tokens, width, base (ids in all parts before). One exchange by
    ranges of doc_id; each task encodes its range as a stream and writes three files. A task that runs
    again writes the same files under the same names, and each file appears only when it is whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ranged = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()) if parts else rows.repartitionByRange(F.col("doc_id").asc_nulls_first())

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_encoder(vocabulary)
        size = max(encoder.library.get_vocab_size(), end_id + 1)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        store, path = open_folder(folder)
        part = TaskContext.get().partitionId()
        names = [f"{path}/part-{part:05d}.{x}" for x in ("ids", "offsets", "docs")]
        own = [f"{n}.{uuid.uuid4().hex}" for n in names]
        store.create_dir(path, recursive=True)
        n_docs = n_tokens = 0
        out = [store.open_output_stream(n) for n in own]
        out[1].write(np.zeros(1, "<i8").tobytes())
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                piece = batch.iloc[at : at + BATCH]
                ids = [encoder.array(t, end_id) for t in piece["text"]]
                stops = n_tokens + np.cumsum([len(x) for x in ids])
                out[0].write(np.concatenate(ids).astype(kind).tobytes())
                out[1].write(stops.astype("<i8").tobytes())
                out[2].write(piece["doc_id"].to_numpy("<i8").tobytes())
                n_docs, n_tokens = n_docs + len(piece), int(stops[-1])
        for stream, temporary, name in zip(out, own, names):
            stream.close()
            if n_docs:
                store.move(temporary, name)
            else:
                store.delete_file(temporary)
        if n_docs:
            yield pd.DataFrame([(part, n_docs, n_tokens, np.dtype(kind).itemsize)], columns=["part", "n_docs", "n_tokens", "width"])

    ordered = ranged.sortWithinPartitions(*keys).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    made = sorted(map(tuple, ordered.mapInPandas(write, PART).collect()))  # a row per part
    bases = [0, *accumulate(x[2] for x in made)]
    return spark.createDataFrame([(*x, b) for x, b in zip(made, bases)], f"{PART}, base long")


def map_part(store: pafs.FileSystem, name: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped where the store is a mounted folder, else read."""
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(name, kind, "r") if os.path.getsize(name) else np.zeros(0, kind)
    with store.open_input_file(name) as f:
        return np.frombuffer(f.read_buffer(), kind)


def documents_of(folder: str, part: int, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, start in the part, ids) of each document of a part."""
    store, path = open_folder(folder)
    at = f"{path}/part-{part:05d}"
    ids = map_part(store, f"{at}.ids", f"<u{width}")
    offsets, docs = map_part(store, f"{at}.offsets", "<i8"), map_part(store, f"{at}.docs", "<i8")
    for i, doc in enumerate(docs):
        yield int(doc), int(offsets[i]), ids[offsets[i] : offsets[i + 1]]


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per document from the files: doc_id, start (ids before it in the whole), n_tokens, ids_crc32."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in batch.itertuples():
                rows = [
                    (doc, part.base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for doc, start, ids in documents_of(folder, part.part, part.width)
                ]
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.repartition(n).mapInPandas(read, SPANS).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` to a new folder of the shared space and read the files back."""
    folder = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, folder, vocabulary, end_id), folder)
