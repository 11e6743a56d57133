"""Table sinks.  All are plain partitioned files; a rerun of a day replaces that day."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def shared_dir(spark: SparkSession) -> str | None:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    A local session that names none (tests) gets one temporary folder, set as its checkpoint folder;
    a cluster that names none has no shared folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tickwatch-"))
        named = context.getCheckpointDir()
    return named


def run_dir(spark: SparkSession, name: str) -> str:
    shared = shared_dir(spark)
    if shared is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return os.path.join(shared, f"{name}-{uuid.uuid4().hex}")


def write_by_day(rows: DataFrame, path: str, ts_col: str = "tick", fmt: str = "parquet") -> None:
    """Write state, sample or outbox rows partitioned by day, replacing the days present."""
    (
        rows.withColumn("day", F.to_date(ts_col))
        .write.format(fmt)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .save(path)
    )


def append(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append rows, for logs of events."""
    rows.write.format(fmt).mode("append").save(path)


def write_batch(rows: DataFrame, path: str, batch_id: int, ts_col: str | None = "tick") -> None:
    """Write one batch of a stream exactly once, for ``foreachBatch``.

    The batch's rows lie in a folder of its own, by day; a commit, written last, publishes all of them at once.  A batch
    that is replayed, because the run ended between its rows and its commit or after both, replaces itself.  Batch numbers
    are those of one query's checkpoint: another query writes to another path.
    """
    rows = rows.withColumn("day", F.to_date(ts_col)) if ts_col else rows
    writer = rows.write.mode("overwrite")
    (writer.partitionBy("day") if ts_col else writer).parquet(f"{path}/rows/batch_id={batch_id}")
    done = rows.sparkSession.range(1).select(F.lit(batch_id).cast("bigint").alias("batch"))
    done.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch_id={batch_id}")


def read_committed(spark: SparkSession, path: str, schema: str, ts_col: str | None = "tick") -> DataFrame:
    """The rows of all committed batches; ``schema`` is that of the rows.  Without any commit there are none."""
    try:
        commits = spark.read.parquet(f"{path}/commits").select("batch").distinct()
    except AnalysisException:
        return spark.createDataFrame([], schema)
    kept = f"{schema}, batch_id bigint" + (", day date" if ts_col else "")
    rows = spark.read.schema(kept).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    # the commits are one small row per batch
    return rows.join(commits, rows["batch_id"] == commits["batch"], "left_semi").drop("batch_id", "day")


def stream_batches(rows: DataFrame, path: str, checkpoint: str, once: bool = False, every: str = "30 seconds", ts_col: str | None = "tick") -> StreamingQuery:
    """Write a stream by :func:`write_batch`."""
    writer = rows.writeStream.foreachBatch(lambda df, batch_id: write_batch(df, path, batch_id, ts_col)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def materialize(rows: DataFrame, name: str) -> DataFrame:
    """Write rows to a table in the shared folder and read them back.

    Used where a small result of a large scan feeds several plans: the scan is not
    repeated when an executor is lost later, and later plans start from a short lineage.
    Without a shared folder the rows stay as they are.
    """
    if shared_dir(rows.sparkSession) is None:
        return rows
    path = run_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
