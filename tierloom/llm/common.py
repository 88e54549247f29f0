"""Shared plumbing of the corpus operators: table access, durable cuts of the lineage, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_BATCH_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark can read."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir, or the checkpoint folder that the caller set.

    Without either it is an error, but in local mode, where every worker reads the same disk.
    """
    bound_batches(spark)
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known is not None:
        return spark.conf.get("spark.checkpoint.dir", None) or known
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tierloom-checkpoint-")
    context.setCheckpointDir(root)
    return root


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's own bound, unless the session sets one: a worker holds several copies of a batch."""
    if spark.conf.get(_BATCH_BOUND, None) in (None, "67108864b"):
        spark.conf.set(_BATCH_BOUND, "8m")


def hot_values(rows_: DataFrame, key: str, share: float = 0.001) -> DataFrame:
    """The values of a key that more than a share of all rows have; at most 1 / share of them, so a broadcast is bounded."""
    total = rows_.count()
    return F.broadcast(rows_.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > max(1, int(total * share))).select(key))


def join_ones(rows_: DataFrame, ones: DataFrame, key: str, share: float = 0.001) -> DataFrame:
    """An inner join with a table that has one row for each key: hot keys meet a broadcast of theirs, the others a shuffle.

    ``rows_`` and ``ones`` are read twice, so they should be cut before.
    """
    hot = hot_values(rows_, key, share)
    near = rows_.join(F.broadcast(ones.join(hot, key, "left_semi")), key)
    return near.unionByName(rows_.join(hot, key, "left_anti").join(ones.join(hot, key, "left_anti"), key))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors do not lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder, for files that an operator writes and reads again."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of ``fresh_path`` through Hadoop's file system API."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The named columns of a batch, row by row."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def batched(schema: pa.Schema, items: Iterator[tuple], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Gather tuples into record batches of at most ``size`` rows."""
    held: list[tuple] = []
    for item in items:
        held.append(item)
        if len(held) >= size:
            yield _batch(schema, held)
            held = []
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, held: list[tuple]) -> pa.RecordBatch:
    columns = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
