"""Ranked lexical search over document shards.

Every shard is a block of texts with its postings in compressed sparse rows: the terms in order, where each one's
postings begin, the places of the documents that hold it, and an integer impact that already has the term's frequency
and the document's length in it. What depends on the query alone, a term's weight, comes in when a term is added.
Items are answered term at a time: one dense accumulator over the shard's documents, to which a term's impacts are
added by place; the best k are found by partial selection, with all that tie with the last of them, before the order
by score and id cuts them. The winners of the shards meet in one window over at most k rows of each shard and item.

A score is the sum, over an item's terms with repeats, of weight * ((1000000000 * tf) div (1000 * tf + 8 * m)), with
m = 25 + (75 * n * N) div L and weight = floor(1000 * ln((2 * N + 2) / (2 * df + 1))); N counts the documents with a
term, L all their terms, n one document's terms, df the documents with the term, tf its occurrences there.

Items are taken in blocks of `ITEM_BYTES` of text, so what is broadcast is bounded whatever the number of items.

Defined cases: null and blank texts have no terms and are never found; items without terms find nothing; documents that
repeat an id are ranked row by row; null ids come last among equal scores; rows that repeat an item's id and text are
one item, and texts that share an id are ranked apart; empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, cut, rows

#: What lies between terms; A to Z in lower case, every other character is part of a term.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: A shard closes when it has so many documents or postings; one text is never split.
SHARD_DOCUMENTS, SHARD_POSTINGS = 32_768, 2_000_000
#: Bytes of item texts that one pass over the shards answers.
ITEM_BYTES = 4_000_000
_SLICE = 1 << 20  # bytes of a text split into terms at a time

_SHARDS = pa.schema([(name, pa.binary()) for name in ("ids", "nulls", "terms", "starts", "places", "impacts")])
_FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a whole text, some at a time."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(raw):
        stop = raw.find(b" ", at + _SLICE)
        stop = len(raw) if stop < 0 else stop
        yield raw[at:stop].split()
        at = stop


def corpus_size(documents: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""
    schema = pa.schema([("documents", pa.int64()), ("terms", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [sum(map(len, terms_of(text))) for (text,) in rows(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in sizes)]), pa.array([sum(sizes)])], schema=schema)

    got = documents.select("text").mapInArrow(count, "documents long, terms long").agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).first()
    return got["documents"] or 0, got["terms"] or 0


def impacts_of(tf: np.ndarray, length: int, documents: int, terms: int) -> np.ndarray:
    """Integer impacts of the term frequencies of one document."""
    m = 25 + 75 * length * documents // terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class _Shard:
    """Postings of a block of texts, gathered document by document."""

    def __init__(self, documents: int, terms: int):
        self.known: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []
        self.postings, self.size = 0, (documents, terms)

    def add(self, doc_id: int | None, text: str | None) -> None:
        known, numbers = self.known, []
        for some in terms_of(text):
            numbers.append(np.fromiter((known.setdefault(t, len(known)) for t in some), np.int32, len(some)))
        if not numbers or not (length := sum(map(len, numbers))):
            return
        number, tf = np.unique(np.concatenate(numbers), return_counts=True)
        self.ids.append(doc_id)
        self.rows.append((number, impacts_of(tf, length, *self.size).astype(np.uint32)))
        self.postings += len(number)

    def packed(self) -> tuple:
        """The shard's row: terms in order and their postings by place."""
        places = np.repeat(np.arange(len(self.rows), dtype=np.uint32), [len(n) for n, _ in self.rows])
        numbers, impacts = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        terms = sorted(self.known)
        rank = np.empty(len(terms), np.int64)
        rank[[self.known[t] for t in terms]] = np.arange(len(terms))
        order = np.argsort(rank[numbers], kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(rank[numbers], minlength=len(terms)))])
        ids = np.array([i or 0 for i in self.ids], np.int64)
        nulls = np.array([i is None for i in self.ids], bool)
        return tuple(x.tobytes() for x in (ids, nulls)) + (b" ".join(terms),) + tuple(x.tobytes() for x in (starts, places[order], impacts[order]))


def build_shards(documents: DataFrame, shard_documents: int = SHARD_DOCUMENTS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """One row for each shard, its arrays as binary columns; every document with a term is in one of them."""
    size = corpus_size(documents)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[tuple]:
            shard = _Shard(*size)
            for batch in batches:
                for doc_id, text in rows(batch, "doc_id", "text"):
                    shard.add(doc_id, text)
                    if len(shard.ids) >= shard_documents or shard.postings >= shard_postings:
                        yield shard.packed()
                        shard = _Shard(*size)
            if shard.ids:
                yield shard.packed()

        yield from batched(_SHARDS, items(), 1)

    return documents.select("doc_id", "text").mapInArrow(compute, ", ".join(f"{f.name} binary" for f in _SHARDS))


class Postings:
    """A shard's row read back."""

    def __init__(self, ids: bytes, nulls: bytes, terms: bytes, starts: bytes, places: bytes, impacts: bytes):
        self.ids, self.nulls = np.frombuffer(ids, np.int64), np.frombuffer(nulls, bool)
        self.row = {t: i for i, t in enumerate(terms.split(b" "))}
        self.starts = np.frombuffer(starts, np.int64)
        self.places, self.impacts = np.frombuffer(places, np.uint32), np.frombuffer(impacts, np.uint32).astype(np.int64)

    def of(self, term: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places and impacts of a term."""
        i = self.row.get(term)
        at = slice(0, 0) if i is None else slice(self.starts[i], self.starts[i + 1])
        return self.places[at], self.impacts[at]

    def best(self, wanted: list[tuple[bytes, int]], k: int) -> Iterator[tuple[int | None, int]]:
        """(doc_id, score) of the k best for weighted terms; equal scores by id, null ids last."""
        score = np.zeros(len(self.ids), np.int64)
        for term, weight in wanted:
            places, impacts = self.of(term)
            score[places] += weight * impacts
        found = np.flatnonzero(score)
        if len(found) > k:
            last = score[found][np.argpartition(score[found], len(found) - k)[len(found) - k]]
            found = found[score[found] >= last]  # with all that tie with the last
        order = np.lexsort((self.ids[found], self.nulls[found], -score[found]))[:k]
        for i in found[order].tolist():
            yield None if self.nulls[i] else int(self.ids[i]), int(score[i])


def _frequencies(shards: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """In how many documents each of some terms is."""
    known = shards.sparkSession.sparkContext.broadcast(terms)
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[tuple]:
            for batch in batches:
                for names, starts in rows(batch, "terms", "starts"):
                    row, edges = {t: i for i, t in enumerate(names.split(b" "))}, np.frombuffer(starts, np.int64)
                    yield from ((k, int(edges[i + 1] - edges[i])) for k, t in enumerate(known.value) if (i := row.get(t)) is not None)

        yield from batched(schema, items())

    counted = shards.select("terms", "starts").mapInArrow(compute, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {terms[r["term"]]: r["n"] for r in counted.collect()}  # as many rows as the block's items have terms


def _block(shards: DataFrame, items: DataFrame, documents: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best of each shard for one block of items."""
    asked = [(r["item"], Counter(t for some in terms_of(r["text"]) for t in some)) for r in items.collect()]
    held = _frequencies(shards, sorted({t for _, c in asked for t in c}))
    weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in held.items()}
    wanted = shards.sparkSession.sparkContext.broadcast([(item, [(t, weight[t] * n) for t, n in c.items() if weight.get(t)]) for item, c in asked])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for batch in batches:
                for row in rows(batch, *_SHARDS.names):
                    postings = Postings(*row)
                    for item, terms in wanted.value:
                        for doc_id, score in postings.best(terms, k):
                            yield item, doc_id, score

        yield from batched(_FOUND, found())

    return shards.mapInArrow(compute, "item long, doc_id long, score long")


def ranked(documents: DataFrame, items: DataFrame, k: int = 10, item_bytes: int = ITEM_BYTES, shard_documents: int = SHARD_DOCUMENTS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents with a score above 0."""
    shards = cut(build_shards(documents, shard_documents, shard_postings))
    held = shards.agg(F.sum(F.octet_length("nulls"))).first()[0] or 0
    asked = cut(items.select("item_id", "text").where("text IS NOT NULL").distinct().withColumn("item", F.monotonically_increasing_id()))
    blocks = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes)
    dealt = F.pmod(F.xxhash64("item"), F.lit(max(1, blocks)))
    found = None
    for b in range(max(1, blocks)):
        some = _block(shards, asked.where(dealt == b), held, k)
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT r, doc_id, len(terms) AS n FROM words WHERE len(terms) > 0),
total AS (SELECT count(*)::HUGEINT AS docs, sum(n)::HUGEINT AS all_terms FROM sizes),
tf AS (SELECT r, term, count(*)::HUGEINT AS tf FROM (SELECT r, unnest(terms) AS term FROM words) GROUP BY r, term),
df AS (SELECT term, count(*)::HUGEINT AS df FROM tf GROUP BY term),
asked AS (
  SELECT item_id, term, count(*)::HUGEINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, term),
weighted AS (
  SELECT item_id, a.term, times * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::HUGEINT AS w
  FROM asked a JOIN df USING (term) CROSS JOIN total),
scored AS (
  SELECT item_id, doc_id, s.r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // all_terms)))) AS score
  FROM weighted JOIN tf USING (term) JOIN sizes s ON s.r = tf.r CROSS JOIN total GROUP BY item_id, doc_id, s.r)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score::BIGINT AS score
  FROM scored WHERE score > 0) WHERE rank <= 10
"""
