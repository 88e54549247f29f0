"""Resumable runs: only files that an earlier run has not seen are processed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new_files(spark: SparkSession, source: str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], schema: str, format: str = "parquet") -> None:
    """Read what is new in a folder, transform it and append it to the sink as Parquet; ends when all is done.

    The checkpoint remembers finished files, so a second call with nothing new writes nothing, and a lost run
    goes on where it stopped without doubling rows.
    """
    new = spark.readStream.format(format).schema(schema).load(source)
    query = transform(new).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start()
    query.awaitTermination()
