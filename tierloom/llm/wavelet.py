"""Token-ID output: one wavelet matrix per shard.

A shard holds the ids of consecutive documents as bit planes, most significant bit first. Each plane
stably moves the zeros of its bit before the ones, so a token is read by following one bit per plane
(`access`), its occurrences before a position are counted by two ranks per plane (`rank`), and its
n-th occurrence is found by walking the planes upwards (`select`). A shard is one file of one cell, whose
parts are compressed one by one: documents, planes, and for each plane a directory of the ones before every
512th bit, so that a query touches a few words of a plane. Reading back, all ids of a shard are accessed at
once; the directories then place every document's end and count its end ids.

Defined cases: a null text is an empty document; an empty document holds the end id alone; an empty
table gives no shard and no rows; repeated doc_ids stay separate documents, ordered by text; null
doc_ids come first. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, cut, delete_path, fresh_path, rows
from .token_cache import encoder

MAGIC = b"WVMX2\0\0\0"
#: Ids of a shard; a longer document makes a longer shard.
SHARD_TOKENS = 2_000_000
_RANK_STEP = 512  # bits between entries of the rank directory
_AT_ONCE = 10_000  # positions whose ranks are taken at once


class WaveletMatrix:
    """Bit planes of a sequence of ids, with rank and select."""

    def __init__(self, planes: list[np.ndarray], n: int, zeros: list[int], ranks: list[np.ndarray] | None = None):
        self.planes, self.n, self.zeros = planes, n, zeros
        self.ranks = ranks if ranks is not None else [self.directory(p) for p in planes]

    @staticmethod
    def directory(plane: np.ndarray) -> np.ndarray:
        """Ones before every _RANK_STEP-th bit of a plane."""
        counts = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), _RANK_STEP // 8), dtype=np.uint32) if len(plane) else np.empty(0, np.uint32)
        return np.concatenate([[0], np.cumsum(counts)]).astype("<u4")

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        """Stable partition by each bit, from the highest."""
        planes, zeros = [], []
        for k in range(bits - 1, -1, -1):
            mask = (ids & ids.dtype.type(1 << k)) != 0
            planes.append(np.packbits(mask))
            z = len(ids) - int(np.count_nonzero(mask))
            zeros.append(z)
            moved = np.empty_like(ids)
            np.take(ids, np.flatnonzero(~mask), out=moved[:z])
            np.take(ids, np.flatnonzero(mask), out=moved[z:])
            ids = moved
        return cls(planes, len(ids), zeros)

    def all_ids(self, dtype: str = "<u4") -> np.ndarray:
        """Every token, by undoing the partitions from the lowest plane."""
        values = np.zeros(self.n, dtype=dtype)
        for k, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            mask = np.unpackbits(plane, count=self.n).view(bool)
            above = np.empty_like(values)
            values[z:] |= values.dtype.type(1 << k)
            above[np.flatnonzero(~mask)] = values[:z]  # positions scatter faster than masks
            above[np.flatnonzero(mask)] = values[z:]
            values = above
        return values

    def _ones(self, level: int, position: int) -> int:
        """Ones of a plane before a position: directory entry plus a short popcount."""
        plane = self.planes[level]
        block, byte, bit = position // _RANK_STEP, position // 8, position % 8
        total = int(self.ranks[level][block]) + int(np.bitwise_count(plane[block * _RANK_STEP // 8 : byte]).sum())
        return total + (int(plane[byte] >> (8 - bit)).bit_count() if bit else 0)

    def _ones_at(self, level: int, positions: np.ndarray) -> np.ndarray:
        """The same for many positions."""
        plane = np.concatenate([self.planes[level], np.zeros(1, np.uint8)])  # a position may be the end
        block, byte = positions // _RANK_STEP, positions // 8
        at = (block * (_RANK_STEP // 8))[:, None] + np.arange(_RANK_STEP // 8)
        before = np.bitwise_count(plane[np.minimum(at, len(plane) - 1)]) * (at < byte[:, None])
        return self.ranks[level][block].astype(np.int64) + before.sum(axis=1, dtype=np.int64) + np.bitwise_count(plane[byte] >> (8 - positions % 8).astype(np.uint8))

    def access_at(self, positions: np.ndarray) -> np.ndarray:
        """The tokens at many positions."""
        values = np.zeros(len(positions), np.int64)
        for level, z in enumerate(self.zeros):
            bits = self.planes[level][positions // 8] >> (7 - positions % 8).astype(np.uint8) & 1
            ones = self._ones_at(level, positions)
            positions = np.where(bits, z + ones, positions - ones)
            values = values << 1 | bits
        return values

    def rank_at(self, token: int, positions: np.ndarray) -> np.ndarray:
        """Occurrences of a token before many positions."""
        start = np.zeros(1, np.int64)
        for level, z in enumerate(self.zeros):
            a, b = self._ones_at(level, start), self._ones_at(level, positions)
            start, positions = (z + a, z + b) if token >> (len(self.zeros) - 1 - level) & 1 else (start - a, positions - b)
        return positions - start

    def access(self, position: int) -> int:
        """The token at a position."""
        if not 0 <= position < self.n:
            raise IndexError(position)
        value = 0
        for level, z in enumerate(self.zeros):
            bit = int(self.planes[level][position // 8] >> (7 - position % 8)) & 1
            ones = self._ones(level, position)
            position = z + ones if bit else position - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        start = 0
        for level, z in enumerate(self.zeros):
            a, b = self._ones(level, start), self._ones(level, end)
            start, end = (z + a, z + b) if token >> (len(self.zeros) - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def rank(self, token: int, position: int) -> int:
        """Occurrences of a token before a position."""
        if token >> len(self.zeros):
            return 0
        start, end = self._range(token, min(position, self.n))
        return end - start

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0), or -1."""
        if k < 0 or token >> len(self.zeros):
            return -1
        start, end = self._range(token, self.n)
        if k >= end - start:
            return -1
        position = start + k
        for level in range(len(self.zeros) - 1, -1, -1):
            one = token >> (len(self.zeros) - 1 - level) & 1
            position = self._nth(level, position - self.zeros[level] if one else position, one)
        return position

    def _nth(self, level: int, k: int, bit: int) -> int:
        """Position of the k-th one or zero of a plane, by bisection over ranks."""
        low, high = 0, self.n - 1
        while low < high:
            mid = (low + high) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    """One shard file: header, document table, planes, rank directories; every part is compressed by itself."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    matrix = WaveletMatrix.build(ids, bits)
    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    parts = [squeeze(np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes()), squeeze(known.tobytes()), squeeze(np.array(lengths, dtype="<u8").tobytes())]
    parts += [squeeze(p.tobytes()) for p in (*matrix.planes, *matrix.ranks)]
    head = struct.pack("<QQQ", len(doc_ids), len(ids), bits) + np.array(matrix.zeros, dtype="<u8").tobytes()
    return MAGIC + head + np.array([len(p) for p in parts], dtype="<u8").tobytes() + b"".join(parts)


def open_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, their lengths and the wavelet matrix of a shard file."""
    if data[:8] != MAGIC:
        raise ValueError("not a shard of this format")
    docs, n, bits = struct.unpack_from("<QQQ", data, 8)
    zeros = np.frombuffer(data, "<u8", bits, 32).tolist()
    sizes = np.frombuffer(data, "<u8", 2 * bits + 3, 32 + 8 * bits).tolist()
    at, parts = 32 + 8 * bits + 8 * (2 * bits + 3), []
    for s in sizes:
        parts.append(zstandard.ZstdDecompressor().decompress(data[at : at + s], max_output_size=1 << 40) if s else b"")
        at += s
    known = np.frombuffer(parts[1], np.uint8)
    ids = [i if k else None for i, k in zip(np.frombuffer(parts[0], "<i8").tolist(), known.tolist(), strict=True)]
    if len(ids) != docs:
        raise ValueError("document table is cut short")
    return ids, np.frombuffer(parts[2], "<u8"), WaveletMatrix([np.frombuffer(p, np.uint8) for p in parts[3 : 3 + bits]], n, zeros, [np.frombuffer(p, "<u4") for p in parts[3 + bits :]])


_SHARDS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("n_end_ids", pa.int64()), ("part", pa.int32()), ("shard", pa.int32())])


def write_shards(documents: DataFrame, path: str, tokenizer_path: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode all texts and write their shards, in ascending doc_id order over the parts and within them.

    Texts are range-partitioned once; each task streams its documents into shards of bounded size, so
    no task holds more than a shard and a batch.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        bits = max(1, (max(enc.size - 1, end_id)).bit_length())
        kind = "<u2" if bits <= 16 else "<u4"
        end = np.array([end_id], dtype=kind)
        docs: list[int | None] = []
        lengths: list[int] = []
        ids: list[np.ndarray] = []
        held = shard = 0

        def emit() -> pa.RecordBatch:
            data = pack_shard(docs, lengths, np.concatenate(ids), bits)
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "n_docs": len(docs), "n_ids": held, "data": data}], schema=_SHARDS)

        for batch in batches:
            pairs = list(rows(batch, "doc_id", "text"))
            for at in range(0, len(pairs), 2000):
                some = pairs[at : at + 2000]
                for (doc, _), got in zip(some, enc.batch([t for _, t in some]), strict=True):
                    docs.append(doc)
                    lengths.append(len(got) + 1)
                    ids += [got.astype(kind, copy=False), end]
                    held += len(got) + 1
                    if held >= shard_tokens:
                        yield emit()
                        docs, lengths, ids, held, shard = [], [], [], 0, shard + 1
        if docs:
            yield emit()

    spark = documents.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = documents.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, "part int, shard int, n_docs long, n_ids long, data binary").write.option("maxRecordsPerFile", 1).option("compression", "uncompressed").parquet(path)


def read_shards(shards: DataFrame, end_id: int) -> DataFrame:
    """Each document's place, digest and number of end ids, read back out of the shard files.

    A document that does not end in the end id raises ValueError.

    A shard's first position follows from the totals of the parts before it (one row per part) and of
    the shards before it in its own part.
    """
    sizes = shards.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "shard", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("shard_start")).join(parts, "part")
    starts = cut(starts.select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("first")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[tuple]:
            for batch in batches:
                for part, shard, data in rows(batch, "part", "shard", "data"):
                    docs, lengths, matrix = open_shard(data)
                    kind = "<u2" if len(matrix.planes) <= 16 else "<u4"
                    raw = memoryview(matrix.all_ids(kind).astype("<u4").tobytes())
                    edges = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
                    if (matrix.access_at(edges[1:] - 1) != end_id).any():
                        raise ValueError("a document does not end where its table says")
                    ends = np.diff(np.concatenate([matrix.rank_at(end_id, edges[i : i + _AT_ONCE]) for i in range(0, len(edges), _AT_ONCE)]))
                    for doc, at, n, found in zip(docs, edges.tolist(), lengths.tolist(), ends.tolist(), strict=False):
                        yield doc, at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), found, part, shard

        yield from batched(_DIGESTS, items())

    found = shards.select("part", "shard", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, n_end_ids long, part int, shard int")
    placed = found.join(starts, ["part", "shard"])
    return placed.select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "n_end_ids")


def wavelet_digest(documents: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the shards below the shared folder and return the digests read back from them."""
    spark = documents.sparkSession
    path = fresh_path(spark, "wavelet")
    write_shards(documents, path, tokenizer_path, end_id)
    out = cut(read_shards(spark.read.schema("part int, shard int, n_docs long, n_ids long, data binary").parquet(path), end_id))
    delete_path(spark, path)
    return out
