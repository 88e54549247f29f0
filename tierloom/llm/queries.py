"""The thin queries of the corpus operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import ORACLE_SQL as CONTAINED_SQL
from .decontaminate import contained_items
from .jaccard_join import ORACLE_SQL as JACCARD_SQL
from .jaccard_join import jaccard_components
from .lexical_search import ORACLE_SQL as RANKED_SQL
from .lexical_search import ranked
from .packing import pack_documents
from .secrets import find_secrets
from .simhash_bits import near_duplicates
from .simhash_native import fingerprint_report
from .suffix_dedup import repeated_windows
from .toxicity import fit_toxicity, score_toxicity
from .transducer import token_counts
from .warc import ORACLE_SQL as WARC_SQL
from .warc import warc_digest
from .wavelet import wavelet_digest


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by compression distance."""
    documents = table(spark, sf_dir, "documents")
    return score_toxicity(documents, fit_toxicity(documents, table(spark, sf_dir, "labels")), threshold=0.3)


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wavelet-matrix shards of all documents, digested after reading them back."""
    return wavelet_digest(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as segmented WARC records and read back."""
    return warc_digest(table(spark, sf_dir, "pages"), payload="html")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents, told apart by who owns their values."""
    return find_secrets(table(spark, sf_dir, "documents"), owner="source", repository="doc_id")


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and its component of links of at most three bits."""
    return near_duplicates(table(spark, sf_dir, "documents"), radius=3)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native SimHash of all documents, their edited texts and next documents."""
    return fingerprint_report(table(spark, sf_dir, "documents"), radius=3, every=100)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by the compiled tokenizer."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), limit=2048)


def op8_contained_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and its containment."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.8)


def op9_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op10_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without the 50-byte windows of earlier ones."""
    return repeated_windows(table(spark, sf_dir, "documents"), threshold=50)


def op11_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and its component of links at a Jaccard similarity of 0.8 of five-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"), shingle=5, percent=80)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_shards": op2_token_shards,
    "op3_warc_round_trip": op3_warc_round_trip,
    "op4_secrets": op4_secrets,
    "op5_simhash_groups": op5_simhash_groups,
    "op6_fingerprints": op6_fingerprints,
    "op7_token_counts": op7_token_counts,
    "op8_contained_benchmark": op8_contained_benchmark,
    "op9_packed_sequences": op9_packed_sequences,
    "op10_repeated_windows": op10_repeated_windows,
    "op11_jaccard_groups": op11_jaccard_groups,
    "op12_ranked_search": op12_ranked_search,
}

ORACLE_SQL: dict[str, str] = {"op3_warc_round_trip": WARC_SQL, "op8_contained_benchmark": CONTAINED_SQL, "op11_jaccard_groups": JACCARD_SQL, "op12_ranked_search": RANKED_SQL}
