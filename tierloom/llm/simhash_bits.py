"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints come from the shingle hashes of whole texts. Equal fingerprints are one node; nodes meet
in the buckets of block tables that any two within the radius must share once at least. Inside a
bucket the fingerprints stand vertically, one integer per bit plane. A query adds its mismatches plane
by plane into carry-save counters, all lanes at once, and leaves the bucket as soon as every lane has
passed the radius. Crowded buckets are dealt out as pairs of lanes of bounded size, so that no task
holds a bucket that grows with the data.

Defined cases: a null or blank text has fingerprint zero, linked like any other; repeated rows and
null doc_ids keep their rows, and a component whose ids are all null has none; an empty table gives no
rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, cut, join_ones, rows
from .components import connected_components

_BLANK = re.compile(r"[\x20\x09-\x0d]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
BITS = 64
#: The bits are cut into so many blocks; two fingerprints within radius r share all but r of them.
BLOCKS = 5
#: Lanes of one comparison; larger buckets are split into pairs of such lanes.
LANES = 2048
_HASHES = 4096  # hashes voted on at a time


def words_of(text: str | None) -> list[str]:
    """Words between ASCII white space, A to Z in lower case."""
    return [w for w in _BLANK.split((text or "").translate(_UPPER)) if w]


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Majority of each bit over the shingles' XXH64; ties and no shingles give 0."""
    low = (text or "").lower() if (text or "").isascii() else (text or "").translate(_UPPER)
    # str.split cuts at more than the six characters meant, so only texts without the others use it.
    words = low.split() if low.isascii() and not _CONTROL.search(low) else [w for w in _BLANK.split(low) if w]
    if not words:
        return 0
    raw = [w.encode() for w in words]
    if len(raw) <= shingle:
        return majority([xxhash.xxh64_intdigest(b" ".join(raw), seed)])
    joined = b" ".join(raw)
    lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends + 1 - lengths)[: len(raw) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return majority([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)])


_CONTROL = re.compile(r"[\x1c-\x1f]")


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _HASHES):
        block = np.array(hashes[at : at + _HASHES], dtype=">u8")
        votes += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> BITS - 1 else value


def fingerprints(documents: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, fp) of every whole text, and other long columns; fp holds the 64 bits as a signed long."""
    names = ["doc_id", *carried]
    schema = pa.schema([*((c, pa.int64()) for c in names), ("fp", pa.int64())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(schema, ((*own, _signed(fingerprint(text))) for batch in batches for *own, text in rows(batch, *names, "text")))

    return documents.select(*names, "text").mapInArrow(compute, ", ".join(f"{c} long" for c in [*names, "fp"]))


def masks(radius: int, blocks: int = BLOCKS) -> list[int]:
    """Bit masks of the tables: two fingerprints within the radius agree on one mask at least."""
    blocks = max(blocks, radius + 1)
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(block[i] for i in kept) for kept in combinations(range(blocks), blocks - radius)]


class BitSlices:
    """A block of fingerprints stored as bit planes; planes are made when first needed."""

    def __init__(self, values: list[int]):
        self.values, self.all = values, (1 << len(values)) - 1
        self.planes: dict[int, int] = {}

    def _plane(self, bit: int) -> int:
        plane = self.planes.get(bit)
        if plane is None:
            if len(self.values) < 64:
                plane = sum((v >> bit & 1) << i for i, v in enumerate(self.values))
            else:
                column = (np.array(self.values, dtype=np.uint64) >> np.uint64(bit)).astype(np.uint8) & 1
                plane = int.from_bytes(np.packbits(column, bitorder="little").tobytes(), "little")
            self.planes[bit] = plane
        return plane

    def within(self, query: int, radius: int, lanes: int, order: list[int]) -> int:
        """Lanes (among ``lanes``) at most ``radius`` bits from the query, as a bit set."""
        width = (radius + 1).bit_length()
        counters = [0] * width  # carry-save: bit k of every lane's distance
        over = self.all & ~lanes
        for bit in order:
            carry = self._plane(bit) ^ (self.all if query >> bit & 1 else 0)
            for k in range(width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
                if not carry:
                    break
            over |= carry | self._above(counters, radius)
            if over == self.all:
                return 0
        return self.all & ~over

    def _above(self, counters: list[int], radius: int) -> int:
        """Lanes whose counter exceeds the radius, by comparison from the highest bit."""
        greater, equal = 0, self.all
        for k in range(len(counters) - 1, -1, -1):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                greater |= equal & counters[k]
                equal &= ~counters[k]
        return greater


def spanning_links(left: list[int], right: list[int] | None, radius: int, mask: int) -> Iterator[tuple[int, int]]:
    """Links among ``left``, or between it and ``right``, thinned to what joins its components.

    Bits under the mask agree already and are skipped.
    """
    order = [b for b in range(BITS) if not mask >> b & 1]
    block = BitSlices(right if right is not None else left)
    parent = list(range(len(left) + (len(right) if right is not None else 0)))
    shift = len(left) if right is not None else 0

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, query in enumerate(left):
        lanes = block.all if right is not None else block.all >> (i + 1) << (i + 1)
        near = block.within(query, radius, lanes, order) if lanes else 0
        while near:
            j = (near & -near).bit_length() - 1
            near &= near - 1
            a, b = root(i), root(j + shift)
            if a != b:
                parent[a] = b
                yield query, block.values[j]


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def near_links(prints: DataFrame, radius: int = 3, lanes: int = LANES) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fp within the radius.

    A bucket's rows are numbered by a hash into cells of about ``lanes`` rows (one cell for nearly all
    buckets) and each pair of cells of a bucket becomes one unit of work; a row joins as many units as
    its bucket has cells.
    """
    tables = masks(radius)
    signed = [_signed(m) for m in tables]
    rows_ = prints.select("fp").distinct()
    keyed = rows_.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("cells", F.ceil(F.col("n") / lanes).cast("int"))
    met = keyed.join(sizes, ["t", "key"]).withColumn("cell", F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    units = met.select("t", "key", "fp", "cell", other.alias("with")).select("t", "key", "fp", F.least("cell", "with").alias("i"), F.greatest("cell", "with").alias("j"), (F.col("cell") <= F.col("with")).alias("first"))
    mask64 = (1 << BITS) - 1
    # Units are gathered with bounded rows each; a task reads them one after another.
    unit = F.xxhash64("t", "key", "i", "j")
    gathered = units.groupBy("t", "key", "i", "j", unit.alias("u")).agg(
        F.collect_list(F.when(F.col("first"), F.col("fp"))).alias("left"), F.collect_list(F.when(~F.col("first"), F.col("fp"))).alias("right")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[tuple]:
            for batch in batches:
                for t, i, j, left, right in rows(batch, "t", "i", "j", "left", "right"):
                    a = sorted(x & mask64 for x in left)
                    b = sorted(x & mask64 for x in right) if i != j else None
                    for x, y in spanning_links(a, b, radius, tables[t]):
                        yield _signed(x), _signed(y)

        yield from batched(_LINKS, items())

    return gathered.select("t", "i", "j", "left", "right").mapInArrow(compare, "a long, b long")


def near_duplicates(documents: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint and component_id: the smallest doc_id reachable over links."""
    prints = cut(fingerprints(documents))
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    groups = connected_components(near_links(prints, radius)).withColumnRenamed("node", "fp")
    named = firsts.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = cut(named.select("fp", "component").join(least, "component").select("fp", "component_id"))
    # Copies share a fingerprint, and all empty texts one.
    return join_ones(prints, ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, named: DataFrame) -> DataFrame:
    """One row of each component, the one with the smallest doc_id, or without an id where all are.

    named has doc_id, key (xxhash64 of the text) and component.
    """
    least = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("s"))
    return rows_at(documents.withColumn("__key", F.xxhash64("text")), least.select("s.doc_id", "s.key"), "__key").drop("__key")


def rows_at(documents: DataFrame, places: DataFrame, key: str = "key") -> DataFrame:
    """The rows of some (doc_id, key), one of each; nulls are equal.

    The join and the removal of repeated rows share one exchange of the texts.
    """
    place = lambda k: [F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__none"), F.col(k).alias("__at")]
    names = ["__id", "__none", "__at"]
    return documents.select("*", *place(key)).join(places.select(*place("key")), names, "left_semi").dropDuplicates(names).drop(*names)


def drop_near_duplicates(documents: DataFrame, radius: int = 3) -> DataFrame:
    """One document of each component: the one with the smallest doc_id; all columns kept.

    Rows are known by their id and their text. Rows that repeat both are one document; a row without an id stays
    only where its whole component has none.
    """
    keyed = documents.select("doc_id", "text", F.xxhash64("text").alias("key"))
    prints = cut(fingerprints(keyed, "key"))
    groups = connected_components(near_links(prints, radius)).withColumnRenamed("node", "fp")
    named = prints.join(groups, "fp", "left").select("doc_id", "key", F.coalesce("component", "fp").alias("component"))
    return keep_one(documents, named)
