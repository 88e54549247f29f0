"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles, each partition reaching up to twice the size of the one
before. A partition has an index of its own: of every item the `SKETCH` shingles with the smallest hashes under
the partition's permutation, all of a shorter one, and the least number of them that a document shows unless it
misses the threshold (a document at the threshold falls below it with a probability under `MISS`; where the
sketch is the whole item, never). A document's whole shingle set, however long, is looked up in every
partition; an item that shows enough of its sketch is verified by exact shingle containment.

Up to `BLOCK_SHINGLES` sketched shingles the partitions are broadcast to one scan of the documents. Beyond that
the sketches stay distributed: documents send the shingles that a bit map of fixed size lets pass, both sides
meet in an equi-join, and the pairs that it finds are verified on the whole texts. Both ways give the same rows.

Words are runs of letters, digits and underscores in lower case. An item of fewer words than a shingle
is matched as a whole: its one shingle is all its words. Defined cases: null or wordless items match
nothing; null and wordless texts contain nothing; repeated rows report each; null ids are kept; empty
tables give no rows. Only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, cut, rows

_WORD = re.compile(r"\w+")
SHINGLE = 5
THRESHOLD = 0.8
#: Shingles in a sketch.
SKETCH = 32
#: Probability that a document at the threshold shows fewer of a sketch than asked.
MISS = 1e-9
#: Sketched shingles up to which the partitions are broadcast.
BLOCK_SHINGLES = 1_000_000
#: Bits of the map of sketched shingles that the scan of a larger benchmark uses: 32 MB.
MAP_BITS = 28
#: Parts that a shingle's documents are dealt into, so that no common shingle meets in one task.
SALTS = 16


def words(text: str | None) -> list[str]:
    """Words of a text in lower case."""
    return _WORD.findall((text or "").lower())


def shingles(tokens: list[str], n: int) -> set[str]:
    """All runs of n words."""
    return {" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1)}


def _hash(shingle: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(shingle.encode("utf-8", "surrogatepass"), seed)


def partition_of(size: int) -> int:
    """The partition of items of a size: 0 for one shingle, then up to 2, 4, 8 and so on."""
    return (size - 1).bit_length()


@lru_cache(maxsize=4096)
def least_shown(size: int, threshold: float) -> int:
    """Sketched shingles that a document shows which holds the threshold's share of an item of a size."""
    if size <= SKETCH:
        return max(1, math.ceil(threshold * size - 1e-9))
    # A sketch is a sample without replacement, whose tails the binomial ones bound.
    below, least = 0.0, 0
    for shown in range(SKETCH + 1):
        below += math.comb(SKETCH, shown) * threshold**shown * (1 - threshold) ** (SKETCH - shown)
        if below > MISS:
            break
        least = shown + 1
    return max(1, least)


def sketch_of(own: set[str]) -> set[str]:
    """The shingles of an item that its partition's index keeps."""
    if len(own) <= SKETCH:
        return own
    seed = partition_of(len(own))
    return set(sorted(own, key=lambda s: (_hash(s, seed), s))[:SKETCH])


@dataclass
class Item:
    item_id: int | None
    n: int  # words of a shingle
    own: set[str]
    least: int


def item_of(item_id: int | None, text: str | None, threshold: float) -> Item | None:
    """An item with its shingles; none without words."""
    tokens = words(text)
    if not tokens:
        return None
    n = min(SHINGLE, len(tokens))
    own = shingles(tokens, n)
    return Item(item_id, n, own, least_shown(len(own), threshold))


@dataclass
class Partition:
    """The index of items of similar sizes with shingles of one length: sketched shingle -> items."""

    n: int
    items: list[Item] = field(default_factory=list)
    sketch: dict[str, list[int]] = field(default_factory=dict)
    firsts: set[str] = field(default_factory=set)

    def add(self, item: Item) -> int:
        """Index one item; returns the shingles of its sketch."""
        chosen = sketch_of(item.own)
        for s in chosen:
            self.sketch.setdefault(s, []).append(len(self.items))
            self.firsts.add(s.partition(" ")[0])
        self.items.append(item)
        return len(chosen)

    def candidates(self, tokens: list[str]) -> list[Item]:
        """Items that show enough of their sketch among a document's shingles."""
        shown: Counter = Counter()
        seen: set[str] = set()
        n, firsts, sketch = self.n, self.firsts, self.sketch
        stop = len(tokens) - n + 1
        for i, w in enumerate(tokens):
            if w in firsts and i < stop:
                s = " ".join(tokens[i : i + n])
                if s in sketch and s not in seen:
                    seen.add(s)
                    shown.update(sketch[s])
        return [item for number, times in shown.items() if times >= (item := self.items[number]).least]


def contained(tokens: list[str], candidates: list[Item], threshold: float) -> list[tuple[int | None, float, int, int]]:
    """(item_id, containment, shared shingles, item's shingles) of the candidates that a document does contain."""
    have = {n: shingles(tokens, n) for n in {c.n for c in candidates}}
    counted = ((c, len(c.own & have[c.n])) for c in candidates)
    return [(c.item_id, both / len(c.own), both, len(c.own)) for c, both in counted if both >= threshold * len(c.own) - 1e-9]


@dataclass
class Index:
    """All partitions of a benchmark that is small enough to broadcast."""

    threshold: float
    partitions: dict[tuple[int, int], Partition] = field(default_factory=dict)

    def add(self, item: Item) -> int:
        key = (partition_of(len(item.own)), item.n)
        return self.partitions.setdefault(key, Partition(item.n)).add(item)

    def hits(self, text: str | None) -> list[tuple[int | None, float, int, int]]:
        """Every item that a text contains."""
        tokens = words(text)
        found = [item for p in self.partitions.values() for item in p.candidates(tokens)]
        return contained(tokens, found, self.threshold) if found else []


def small_index(benchmark: DataFrame, threshold: float, block_shingles: int) -> Index | None:
    """The index of a benchmark up to the size that is broadcast; None beyond it, after reading that much."""
    index, held = Index(threshold), 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        if (item := item_of(r["item_id"], r["text"], threshold)) is not None:
            held += index.add(item)
            if held > block_shingles:
                return None
    return index


_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("containment", pa.float64()), ("n_shared", pa.int64()), ("n_shingles", pa.int64())])
_HITS_DDL = "doc_id long, item_id long, containment double, n_shared long, n_shingles long"
_SKETCHES = pa.schema([("item", pa.int64()), ("n", pa.int32()), ("least", pa.int32()), ("hash", pa.int64())])
_SHOWN = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("hash", pa.int64())])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _bit_map(sketches: DataFrame) -> np.ndarray:
    """The sketched shingles as a bit map of 2**MAP_BITS bits, gathered as at most 2**(MAP_BITS - 6) words."""
    bit = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    words_ = sketches.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - MAP_BITS}) & 63 AS int))")).alias("bits"))
    out = np.zeros(1 << MAP_BITS - 6, dtype=np.uint64)
    table = words_.toArrow()
    out[table["w"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return out


def _joined_candidates(documents: DataFrame, benchmark: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(items, pairs): the numbered items, and (doc_id, key, item) that show enough of a sketch; key is the text's hash."""
    items = cut(benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for number, text in rows(batch, "item", "text"):
                    if (item := item_of(None, text, threshold)) is not None:
                        for s in sketch_of(item.own):
                            yield number, item.n, item.least, _signed(_hash(s))

        yield from batched(_SKETCHES, each())

    sketches = cut(items.select("item", "text").mapInArrow(sketch, "item long, n int, least int, hash long"))
    sc = documents.sparkSession.sparkContext
    shared = sc.broadcast((_bit_map(sketches), sorted(r["n"] for r in sketches.select("n").distinct().collect())))  # at most SHINGLE lengths

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lengths = shared.value

        def each() -> Iterator[tuple]:
            for batch in batches:
                for doc, key, text in rows(batch, "doc_id", "key", "text"):
                    tokens = words(text)
                    for n in lengths:
                        hashes = np.fromiter(map(_hash, shingles(tokens, n)), np.uint64)
                        at = hashes >> np.uint64(64 - MAP_BITS)
                        for h in hashes[(bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)].view(np.int64).tolist():
                            yield doc, key, n, h

        yield from batched(_SHOWN, each())

    keyed = documents.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(show, "doc_id long, key long, n int, hash long")
    dealt = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int"))
    spread = sketches.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = dealt.distinct().join(spread, ["salt", "n", "hash"])
    return items, met.groupBy("doc_id", "key", "item").agg(F.count("*").alias("shown"), F.min("least").alias("least")).where("shown >= least").select("doc_id", "key", "item")


def _candidates_with_texts(documents: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """Every row of documents with candidates: doc_id, key, text, and the candidates' ids and texts."""
    items, pairs = _joined_candidates(documents, benchmark, threshold)
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int"))
    spread = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = dealt.join(spread, ["salt", "item"]).groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    keyed = documents.select("doc_id", "text", F.xxhash64("text").alias("key"))
    return keyed.join(named, keyed["doc_id"].eqNullSafe(named["d"]) & (keyed["key"] == named["k"])).select("doc_id", "key", "text", "items")


def _verified_hits(candidates: DataFrame, threshold: float) -> DataFrame:
    """The hits among candidates, by exact containment in the whole texts."""
    schema = pa.schema([_HITS.field(0), ("key", pa.int64()), *list(_HITS)[1:]])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for doc, key, text, items in rows(batch, "doc_id", "key", "text", "items"):
                    for hit in contained(words(text), [item_of(x["item_id"], x["text"], threshold) for x in items], threshold):
                        yield doc, key, *hit

        yield from batched(schema, each())

    return candidates.mapInArrow(verify, _HITS_DDL.replace("doc_id long,", "doc_id long, key long,"))


def contained_items(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document and item of which it holds at least the threshold's share of shingles."""
    index = small_index(benchmark, threshold, block_shingles)
    if index is None:
        return _verified_hits(_candidates_with_texts(documents, benchmark, threshold), threshold).drop("key")
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = shared.value.hits
        yield from batched(_HITS, ((doc, *hit) for batch in batches for doc, text in rows(batch, "doc_id", "text") for hit in hits(text)))

    return documents.select("doc_id", "text").mapInArrow(search, _HITS_DDL)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The documents that contain no item; all columns kept."""
    index = small_index(benchmark, threshold, block_shingles)
    if index is None:
        found = _verified_hits(_candidates_with_texts(documents, benchmark, threshold), threshold).select(F.col("doc_id").alias("__d"), F.col("key").alias("__k")).distinct()
        return documents.join(found, documents["doc_id"].eqNullSafe(found["__d"]) & (F.xxhash64(documents["text"]) == found["__k"]), "left_anti")
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = shared.value.hits
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([not hits(t) for t in texts], pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)


#: The same rows in DuckDB: all five-word shingles, none sketched.
ORACLE_SQL = """
WITH docs AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM benchmark
), item_shingles AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), doc_shingles AS (
  SELECT DISTINCT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM item_shingles) WHERE len(w) >= n)
), sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id)
SELECT d.doc_id, i.item_id, count(*) / max(z.n_shingles) AS containment, count(*) AS n_shared, max(z.n_shingles) AS n_shingles
FROM doc_shingles d JOIN item_shingles i ON d.s = i.s AND d.n = i.n JOIN sizes z ON z.item_id = i.item_id
GROUP BY d.doc_id, i.item_id
HAVING count(*) >= 0.8 * max(z.n_shingles) - 1e-9
"""
