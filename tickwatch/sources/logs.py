"""Reading log indexes: one path, a pattern, a list, or a registered source."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T


def scan(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """Read one log index; ``path`` may be a glob.  Spark prunes columns and pushes filters."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def scan_index(spark: SparkSession, root: str, index: str, fmt: str = "parquet") -> DataFrame:
    """Read an index expression under ``root``: names joined by commas, each may hold ``*``.

    Parts may differ in columns; a column one part lacks is NULL there.
    """
    parts = [p.strip() for p in index.split(",") if p.strip()]
    frames = [scan(spark, os.path.join(root, p if "." in p else f"{p}.{fmt}"), fmt) for p in parts]
    return union_logs(frames)


def union_logs(frames: list[DataFrame]) -> DataFrame:
    """Several logs as one, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    """The same log as an unbounded table."""
    reader = spark.readStream.format(fmt).schema(schema)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)


def open_source(spark: SparkSession, sources: DataFrame, namespace: str | None, name: str, index: str) -> DataFrame | None:
    """The log index of a registered source, its time column named ``ts``; NULL namespace or
    "" means cluster scope.  None when there is no such source."""
    row = registry(sources).get((namespace or "", name))
    return None if row is None else open_row(spark, row, index)


def registry(sources: DataFrame) -> dict[tuple[str, str], Row]:
    """The registered sources by (namespace, name), read once; of equal keys the first by path."""
    rows = sorted(sources.collect(), key=lambda r: str(r["path"]), reverse=True)
    return {(r["namespace"] or "", r["name"]): r for r in rows}


def open_row(spark: SparkSession, row: Row, index: str) -> DataFrame:
    """A log index of one registered source, its time column named ``ts``."""
    rows = scan_index(spark, row["path"], index, row["format"] or "parquet")
    return rows.withColumnRenamed(row["ts_col"], "ts") if row["ts_col"] else rows
