"""The corpus pipeline: each stage applies one operator to all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. The last returns the packed pieces.

Defined cases: a null text is an empty one in every stage and is kept as null; empty and blank texts are near copies of each
other, so one of them stays; rows that repeat an id and a text are one document after the near-dedup stage, rows of one id with
different texts are documents of their own; rows without an id are documents, and of a group of near copies one of them stays only
where none has an id; columns that documents do not have pass through all stages but the last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tierloom.llm.common import cut, table
from tierloom.llm.decontaminate import drop_contaminated
from tierloom.llm.near_copies import drop_near_copies
from tierloom.llm.packing import pack_documents
from tierloom.llm.queries import tokenizer_file
from tierloom.llm.secrets import redact_live_secrets
from tierloom.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier rejects go."""
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; copies share 0.8 of their five-word shingles."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced in the texts; every document stays."""
    return redact_live_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left is packed into sequences of 1024 tokens."""
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scan),
    ("best_fit_packing", packing),
]

#: SQL cannot express a learned classifier; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of a folder, cut between stages."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = cut(docs)
    return docs
