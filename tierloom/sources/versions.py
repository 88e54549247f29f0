"""A table kept in versions: the new one is written beside the old, and counts only when a pointer row names it.

    path/v=N        the versions, each written whole by Spark
    path/current    rows (version); the highest is what readers get

A refresh that fails leaves the pointer where it was, so readers keep the old version; what it wrote is passed over and its
number is not used again. The version before stays as a backup.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relations import diff

_POINTER = "version long, attempt long"


@dataclass
class Refresh:
    """What a refresh changes: cells by column, the version that readers have now, and the changed cells themselves."""

    changed: dict[str, int]
    version: int | None
    written: bool
    cells: DataFrame


def _pointer(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_POINTER).parquet(f"{path}/current")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _POINTER)


def current_version(spark: SparkSession, path: str) -> int | None:
    """The version that readers get; None before the first."""
    return _pointer(spark, path).agg(F.max("version")).first()[0]


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The current version, or an earlier one."""
    version = current_version(spark, path) if version is None else version
    if version is None:
        raise ValueError(f"{path} has no version yet")
    return spark.read.parquet(f"{path}/v={version}")


def _write(frame: DataFrame, path: str) -> int:
    """Write the next version and point at it. Attempts are numbered, so that one that failed is never written into."""
    spark = frame.sparkSession
    last = _pointer(spark, path).agg(F.max("attempt")).first()[0]
    number = (last or 0) + 1
    spark.createDataFrame([(None, number)], _POINTER).coalesce(1).write.mode("append").parquet(f"{path}/current")
    frame.write.mode("errorifexists").parquet(f"{path}/v={number}")
    spark.createDataFrame([(number, number)], _POINTER).coalesce(1).write.mode("append").parquet(f"{path}/current")
    return number


def refresh(fresh: DataFrame, path: str, key: str, columns: list[str], write: bool = False) -> Refresh:
    """Compare fresh rows with the current version and, if told to, make them the next one.

    A dry run by default: it tells how many cells of each column change. Nothing is written where nothing changes. Rows that
    only one side has count as a change of ``key``.
    """
    spark = fresh.sparkSession
    now = current_version(spark, path)
    if now is None:
        return Refresh({key: fresh.count()}, _write(fresh, path) if write else None, write, fresh.limit(0))
    old = read_version(spark, path, now)
    cells = diff(old, fresh, key, columns)
    changed = {r["column"]: r["n"] for r in cells.groupBy("column").agg(F.count("*").alias("n")).collect()}  # as many as columns
    ids = old.select(key).withColumn("__old", F.lit(1)).unionByName(fresh.select(key).withColumn("__old", F.lit(-1)))
    moved = ids.groupBy(key).agg(F.sum("__old").alias("n")).agg(F.sum(F.abs("n"))).first()[0] or 0
    changed |= {key: moved} if moved else {}
    wanted = write and bool(changed)
    return Refresh(changed, _write(fresh, path) if wanted else now, wanted, cells)


def undo(spark: SparkSession, path: str) -> int | None:
    """Point at the version before the current one again; returns it, or None where there is none."""
    versions = sorted({r[0] for r in _pointer(spark, path).where("version IS NOT NULL").collect()})
    if len(versions) < 2:
        return None
    frame = read_version(spark, path, versions[-2])
    return _write(frame, path)
