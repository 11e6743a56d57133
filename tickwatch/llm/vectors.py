"""Vectors as packed tiles, shared by the searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite_vectors(df: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v) of the rows whose id and vector are not null and whose components are all finite."""
    v = F.col(vec).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
