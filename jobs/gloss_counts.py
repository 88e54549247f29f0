"""Job: how often each gloss occurs, kept up to date while recordings keep arriving.

    python -m jobs.gloss_counts jobs/gloss_counts.json [--documents PATH] [--out PATH] [--checkpoint PATH]

A file stream over the documents takes the files that no earlier run has taken. Each micro-batch writes three partial
tables, in a folder of its own number, so that a batch that is run again replaces what it wrote:

    state/documents     ids of the documents counted
    state/counts        region, gloss, occurrences, number of documents
    state/signers       region, gloss, speaker

A document is counted when its id first arrives; rows that bring a known id again, or none, are left out and told in the
log. After the stream two tables are made from the partial tables alone, one folder for each scope (GLOBAL and every region):

    out/glosses         every gloss: occurrences, documents, speakers, share of the scope's tokens
    out/top             the most frequent glosses that speakers enough use, ranked

A run without new files publishes the same rows again. A run that dies goes on with the batch that it was in.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tierloom.operators import corpus
from tierloom.plans.adapters import tokens_of
from tierloom.scratch import fresh_path

log = logging.getLogger("jobs.gloss_counts")

DOCUMENTS = "doc_id long, text string, lang string, source string"
STATE = {
    "documents": "doc_id string, batch long",
    "counts": "region_code string, gloss string, occurrences long, n_files long, batch long",
    "signers": "region_code string, gloss string, speaker_id string, batch long",
}
TOP_N, MIN_SIGNERS = 100, 2
#: Bytes of text that a task cuts into words, about; a task's memory follows them, not the batch.
TASK_BYTES = 8_000_000
GLOSSES = "gloss string, occurrences long, n_files long, n_signers long, percent_of_tokens double, tag string"


def _watched(path: str) -> str:
    """The path as a glob of itself, as a file stream lists a single file only through one."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def state(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A partial table as all batches left it; empty before the first."""
    try:
        return spark.read.schema(STATE[name]).parquet(f"{out}/state/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE[name])


def count_batch(documents: DataFrame, number: int, out: str) -> int:
    """The partial tables of one micro-batch; returns how many rows it read."""
    spark = documents.sparkSession
    known = state(spark, out, "documents").where(F.col("batch") < number).select("doc_id")
    taken = Observation(f"taken-{number}")
    read, size = documents.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # Ids as text, as the library has recordings: documents are dealt by id once, and their words are counted where they are.
    # The number of parts is given, as adaptive execution would join small parts into tasks of some 64 MB of compressed text.
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    named = documents.where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("string")).repartition(parts, "doc_id")
    new = named.dropDuplicates(["doc_id"]).join(known.repartition(parts, "doc_id"), "doc_id", "left_anti")
    folder = lambda name: f"{out}/state/{name}/batch={number}"
    # The words are counted once and written; the two smaller tables are made from what was written. A document is one row by
    # now, with one region and one speaker, so its cells are summed, and counted as documents, without its id.
    cells = f"{out}/state/cells"
    by_file = corpus.gloss_cells(corpus.add_flags(tokens_of(new)))
    by_file.groupBy("region_code", "gloss", "speaker_id").agg(F.sum("occurrences").alias("occurrences"), F.count("*").alias("n_files")).write.mode("overwrite").parquet(cells)
    written = spark.read.schema("region_code string, gloss string, speaker_id string, occurrences long, n_files long").parquet(cells)
    written.groupBy("region_code", "gloss").agg(F.sum("occurrences").alias("occurrences"), F.sum("n_files").alias("n_files")).write.mode("overwrite").parquet(folder("counts"))
    written.select("region_code", "gloss", "speaker_id").write.mode("overwrite").parquet(folder("signers"))
    # Last, so that a batch that stops half way finds its documents unknown when it runs again.
    new.select("doc_id").observe(taken, F.count("*").alias("documents")).write.mode("overwrite").parquet(folder("documents"))
    log.info("batch %d: %d rows, %d new documents", number, read, taken.get["documents"])
    return read


def _publish(frame: DataFrame, path: str) -> int:
    """Write a table by scope; returns its rows, counted on the way."""
    counted = Observation(path.rsplit("/", 1)[-1])
    frame.observe(counted, F.count("*").alias("rows")).write.mode("overwrite").partitionBy("tag").parquet(path)
    log.info("wrote %d rows to %s", counted.get["rows"], path)
    return counted.get["rows"]


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, files_per_batch: int = 64, top_n: int = TOP_N, min_signers: int = MIN_SIGNERS) -> dict[str, int]:
    """Count what is new, publish the whole; returns how many rows were read and how many each table has."""
    new = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(_watched(documents))
    rows: list[int] = []
    query = new.writeStream.foreachBatch(lambda frame, number: rows.append(count_batch(frame, number, out))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d rows of new files below %s", sum(rows), documents)
    written = _publish(corpus.gloss_totals(state(spark, out, "counts"), state(spark, out, "signers")), f"{out}/glosses")
    top = _publish(corpus.top_by_scope(published(spark, out), top_n, min_signers), f"{out}/top")
    return {"read": sum(rows), "written": written, "top": top}


def published(spark: SparkSession, out: str) -> DataFrame:
    """The published table."""
    return spark.read.schema(GLOSSES).parquet(f"{out}/glosses")


def job1_gloss_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over all documents into one new folder; the second finds nothing new. What is published then."""
    out = fresh_path(spark, "job1")
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", out, f"{out}-checkpoint")
    return published(spark, out)


ORACLE_SQL = """WITH tokens AS (
  SELECT doc_id, source, lang, unnest(string_split(lower(coalesce(text, '')), ' ')) AS gloss FROM (SELECT DISTINCT ON (doc_id) * FROM documents WHERE doc_id IS NOT NULL)),
t AS (SELECT * FROM tokens WHERE regexp_matches(gloss, '[^\\s\\p{Z}]') AND NOT regexp_full_match(gloss, '[\\s\\p{Z}]*(nan|none|null|<na>)[\\s\\p{Z}]*')),
g AS (SELECT CASE WHEN grouping(lang) = 1 THEN 'GLOBAL' ELSE lang END AS tag, gloss, count(*) AS occurrences, count(DISTINCT doc_id) AS n_files, count(DISTINCT source) AS n_signers
  FROM t GROUP BY GROUPING SETS ((gloss), (gloss, lang)))
SELECT tag, gloss, occurrences, n_files, n_signers, 100e0 * occurrences / greatest(sum(occurrences) OVER (PARTITION BY tag), 1) AS percent_of_tokens FROM g"""


def main(arguments: list[str] | None = None) -> int:
    """The command line; 0 when all is written."""
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("config")
    for name in ("documents", "out", "checkpoint"):
        parser.add_argument(f"--{name}")
    options = parser.parse_args(arguments)
    with open(options.config, encoding="utf-8") as file:
        config = json.load(file)
    config |= {k: v for k, v in vars(options).items() if v and k != "config"}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("gloss-counts").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, **config)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
