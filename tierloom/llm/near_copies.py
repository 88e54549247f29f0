"""Near copies by SimHash, verified exactly: the bit-sliced comparison at a radius wide enough for word shingles.

A text is the set of its five-word shingles and has a SimHash of them. Texts that share 0.8 of their shingles
differ in 10 of its 64 bits on average, and in more than `RADIUS` with a probability near 1e-6; no block tables
reach so far. The blocks that the comparison runs over are therefore texts that agree on a whole band of
MinHash values; at a similarity of 0.8 a pair shares no band, and is missed, with probability 6e-5, and less
above. Within a block the fingerprints stand as bit planes, and what they leave is verified on the whole sets,
so that no link stands on an estimate. Texts that share a band are first compared with the most central of
them; only bands that this leaves in several components are compared whole, in pairs of cells of bounded size.

Defined cases: null and blank texts are one text without shingles; a text of fewer words is one shingle;
repeated rows of an id and its text are one document; of a component without ids one row stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, cut, hot_values, rows
from .components import connected_components
from .simhash_bits import BITS, BitSlices, keep_one, majority, rows_at, words_of

SHINGLE = 5
SIMILARITY = 0.8
#: Bits in which the fingerprints of two texts may differ; texts of fewer shingles are all verified.
RADIUS, FEW = 24, 16
#: Bands of so many MinHash values each.
BANDS, BAND_ROWS = 32, 6
#: Texts of one cell; a comparison holds two cells at most.
LANES = 256
#: Parts of a crowded band.
SALTS = 16
_CHUNK = 2048  # shingles hashed anew at a time

_RANDOM = np.random.default_rng(42)
_SHIFTS = _RANDOM.integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint32)[:, None]
_FACTORS = _RANDOM.integers(0, 1 << 31, BANDS * BAND_ROWS, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the runs of ``size`` words."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words_of(text)]
    if not raw:
        return np.empty(0, np.uint64)
    joined = b" ".join(raw)
    if len(raw) <= size:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1
    starts = [0, *(ends[: len(raw) - size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64))


def band_keys(found: np.ndarray) -> list[int]:
    """One signed key for each band of a set that is not empty."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full((BANDS * BAND_ROWS, 1), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), _CHUNK):
        least = np.minimum(least, ((low[None, at : at + _CHUNK] ^ _SHIFTS) * _FACTORS).min(axis=1, keepdims=True))
    bands = least.reshape(BANDS, BAND_ROWS)
    return [_signed(xxhash.xxh64_intdigest(bands[b].tobytes(), b)) for b in range(BANDS)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _node(found: np.ndarray) -> int:
    """Equal sets are one node; the empty set is node 0."""
    return _signed(xxhash.xxh64_intdigest(found.tobytes())) if len(found) else 0


_PRINTS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("node", pa.int64()), ("fp", pa.int64()), ("found", pa.binary())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _prints(keyed: DataFrame) -> DataFrame:
    """doc_id, key, node and band keys of every whole text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[tuple]:
            for batch in batches:
                for doc, key, text in rows(batch, "doc_id", "key", "text"):
                    found = shingles(text)
                    yield doc, key, _node(found), band_keys(found) if len(found) else []

        yield from batched(_PRINTS, items(), 2000)

    return keyed.mapInArrow(compute, "doc_id long, key long, node long, bands array<long>")


def _sets(keyed: DataFrame, prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, found): the whole sets of some nodes, made again from one text of each."""
    one = prints.groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("s")).join(nodes, "node", "left_semi").select("s.doc_id", "s.key")
    texts = rows_at(keyed, one)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from batched(_SETS, ((_node(found), _signed(majority(found)), found.tobytes()) for (text,) in rows(batch, "text") for found in [shingles(text)]), 100)

    return texts.select("text").mapInArrow(compute, "node long, fp long, found binary")


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sorted sets share enough of their members."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared * (1 + similarity) >= similarity * (len(a) + len(b)) - 1e-9


def verified_links(nodes: list[int], prints: list[int], sets: list[np.ndarray], labels: list[int], similarity: float = SIMILARITY) -> Iterator[tuple[int, int]]:
    """Links among nodes at the similarity or above, thinned to what joins components; equal labels are joined already."""
    first: dict[int, int] = {}
    parent = [first.setdefault(label, i) for i, label in enumerate(labels)]
    parts = len(first)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    slices, order = BitSlices(prints), list(range(BITS))
    few = sum(1 << i for i, s in enumerate(sets) if len(s) < FEW)
    apart = max((i for i, label in enumerate(labels) if label != labels[-1]), default=-1)
    for i in range(apart + 1):  # those behind are joined with each other
        if parts == 1:
            return
        after = slices.all >> (i + 1) << (i + 1)
        near = after if few >> i & 1 else slices.within(prints[i], RADIUS, after, order) | after & few
        while near:
            j = (near & -near).bit_length() - 1
            near &= near - 1
            a, b = root(i), root(j)
            if a != b and similar(sets[i], sets[j], similarity):
                parent[a] = b
                parts -= 1
                yield nodes[i], nodes[j]


def _compared(units: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified links of units of work; units has unit, node, label and rank (what is compared first)."""
    dealt = units.join(sets, "node").select("unit", "rank", "node", "label", "fp", "found").repartition("unit").sortWithinPartitions("unit", "rank")
    mask = (1 << BITS) - 1

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[tuple]:
            every = (row for batch in batches for at in range(0, batch.num_rows, 256) for row in rows(batch.slice(at, 256), "unit", "node", "label", "fp", "found"))
            for _, held in groupby(every, key=lambda row: row[0]):
                _, nodes, labels, prints, found = zip(*held, strict=True)
                yield from verified_links(nodes, [x & mask for x in prints], [np.frombuffer(x, np.uint64) for x in found], labels)

        yield from batched(_LINKS, items())

    return dealt.mapInArrow(compare, "a long, b long")


def similar_links(keyed: DataFrame, prints: DataFrame, lanes: int = LANES) -> DataFrame:
    """Links (a, b) of nodes whose components are those of all candidate pairs at the similarity."""
    bands = prints.select("node", "bands").dropDuplicates(["node"]).select("node", F.explode("bands").alias("band"))
    sizes = bands.groupBy("band").agg(F.count("*").alias("n"), *[F.sum(F.xxhash64("node", F.lit(k)).bitwiseAND(F.lit((1 << 40) - 1))).alias(f"members{k}") for k in range(2)]).where("n > 1")
    # Bands with the same nodes are compared once.
    sizes = sizes.groupBy("n", "members0", "members1").agg(F.min("band").alias("band"), F.count("*").alias("times"))
    met = cut(bands.join(sizes.select("band", "n", "times"), "band"))
    # A crowded band or hub is dealt into SALTS parts; the side with one row for it goes to all of them.
    salt = lambda n: F.when(F.col(n) > lanes, F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("salt")
    salts = lambda n: F.explode(F.when(F.col(n) > lanes, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    # The hub of a band is the node that meets the most others over all bands.
    weight = met.groupBy("node").agg(F.sum(F.col("n") * F.col("times")).alias("weight"))
    hubs = met.join(weight, "node").groupBy("band").agg(F.max(F.struct("weight", "node")).alias("h"), F.first("n").alias("n")).select("band", F.col("h.node").alias("hub"), salts("n"))
    starred = met.withColumn("salt", salt("n")).join(hubs, ["band", "salt"]).where("node <> hub")
    stars = cut(starred.groupBy("hub", "node").agg(F.max("n").alias("n")))  # a hub with many leaves has a crowded band or many
    chunks = stars.groupBy("hub").agg(F.ceil(F.count("*") / lanes).cast("int").alias("chunks"))
    hot = hot_values(stars, "hub")
    few, many = chunks.join(hot, "hub", "left_anti"), chunks.join(hot, "hub", "left_semi")
    chunked = stars.join(hot, "hub", "left_anti").join(few, "hub").unionByName(stars.join(F.broadcast(many), "hub"))
    leaves = chunked.select(F.xxhash64("hub", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).alias("unit"), "node", F.lit(1).alias("rank"))
    heads = chunks.select("hub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).select(F.xxhash64("hub", "chunk").alias("unit"), F.col("hub").alias("node"), F.lit(0).alias("rank"))
    sets = cut(_sets(keyed, prints, met.select("node").distinct()))
    links = cut(_compared(leaves.unionByName(heads).withColumn("label", F.col("node")), sets))

    labels = connected_components(links)
    labelled = met.where("n > 2").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    open_ = labelled.groupBy("band").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("band")
    # What is outside the largest component of a band meets all of it; inside, there is nothing left to join.
    counts = labelled.join(open_, "band", "left_semi").groupBy("band", "label").agg(F.count("*").alias("c"))
    top = counts.groupBy("band").agg(F.max(F.struct("c", "label")).alias("t"), F.sum("c").alias("all"))
    top = top.select("band", F.col("t.label").alias("top"), F.ceil(F.col("t.c") / lanes).cast("int").alias("inner"), F.ceil((F.col("all") - F.col("t.c")) / lanes).cast("int").alias("outer"))
    left = labelled.join(top, "band").withColumn("inside", F.col("label") == F.col("top")).withColumn("cell", F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    upto = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1)).alias("with")
    row = ["node", "label", (F.col("inside").cast("int")).alias("rank")]
    within = left.where("inside").select("band", "cell", upto("outer"), *row).select(F.xxhash64("band", F.lit(0), "cell", "with").alias("unit"), "node", "label", "rank")
    across = left.where("NOT inside").select("band", "cell", upto("inner"), *row).select(F.xxhash64("band", F.lit(0), "with", "cell").alias("unit"), "node", "label", "rank")
    among = left.where("NOT inside AND outer > 1").select("band", "cell", upto("outer"), *row).select(F.xxhash64("band", F.lit(1), F.least("cell", "with"), F.greatest("cell", "with")).alias("unit"), "node", "label", "rank")
    units = within.unionByName(across).unionByName(among)
    return links.unionByName(_compared(units, sets))


def drop_near_copies(documents: DataFrame, lanes: int = LANES) -> DataFrame:
    """One document of each component of near copies: the one with the smallest doc_id; all columns kept."""
    keyed = documents.select("doc_id", "text", F.xxhash64("text").alias("key"))
    prints = cut(_prints(keyed))
    groups = connected_components(similar_links(keyed, prints, lanes))
    named = prints.select("doc_id", "key", "node").join(groups, "node", "left").select("doc_id", "key", F.coalesce("component", "node").alias("component"))
    return keep_one(documents, named)
