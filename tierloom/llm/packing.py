"""Best-fit packing by linear grouping.

The histogram of piece lengths (at most ``capacity`` rows, whatever the corpus) is packed on the
driver; documents are never collected. Large lengths are split into groups of equal cardinality and
rounded up to the largest of their group, the configurations of the few rounded sizes are optimised by
a linear programme, the actual lengths are then substituted for the rounded ones, and the small lengths
go best-fit into what is left. Every step works on runs of equal sequences, so a plan's size depends on the number of
distinct lengths alone. Documents find their place by their rank among pieces of the same length.

Defined cases: a null text is an empty document and holds the end id alone; an empty table gives no
rows; repeated rows are packed as separate pieces; null doc_ids are kept. Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import dense
from .common import batched, cut, rows
from .token_cache import encoder

#: Lengths above this share of the capacity are large: a configuration holds three of them at most.
LARGE_OVER = 1 / 4
#: Groups of equal cardinality that the large lengths are rounded up within.
GROUPS = 256
#: Columns that the optimisation of configurations may generate per group; fewer only make a less full plan.
_COLUMNS = 60


@dataclass
class Run:
    """``count`` sequences that hold pieces of the same lengths."""

    count: int
    lengths: list[int]
    left: int = field(default=0)


def linear_groups(histogram: dict[int, int], large_over: int, groups: int, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Large lengths, longest first, in groups of equal cardinality: (rounded size, [(length, count)]).

    Lengths of the whole capacity fill a sequence alone and stand outside the groups.
    """
    large = [(n, histogram[n]) for n in sorted(histogram, reverse=True) if large_over < n < capacity]
    each = max(1, -(-sum(c for _, c in large) // groups))
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length, count in large:
        while count:
            if not room:
                out.append((length, []))  # the first of a group is its longest
                room = each
            take = min(room, count)
            out[-1][1].append((length, take))
            room -= take
            count -= take
    return out


def _best_column(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The set of at most three sizes of the highest worth within the capacity: its worth, and its members.

    Sizes descend and are over a quarter of the capacity, so no more than three fit. Of every pair the best third
    is looked up by the room that is left.
    """
    best = np.zeros(capacity + 1)  # worth of the best single size within a room
    which = np.full(capacity + 1, -1)
    for k in np.argsort(worth, kind="stable").tolist():
        best[sizes[k] :], which[sizes[k] :] = np.maximum(best[sizes[k] :], worth[k]), np.where(worth[k] > best[sizes[k] :], k, which[sizes[k] :])
    room = capacity - sizes[:, None] - sizes[None, :]
    pairs = np.where(room >= 0, worth[:, None] + worth[None, :] + best[np.maximum(room, 0)], -1.0)
    single = worth + best[capacity - sizes]
    i, j = divmod(int(pairs.argmax()), len(sizes))
    if pairs[i, j] >= single.max():
        return float(pairs[i, j]), [i, j, *([t] if (t := int(which[room[i, j]])) >= 0 else [])]
    i = int(single.argmax())
    return float(single[i]), [i, *([t] if (t := int(which[capacity - sizes[i]])) >= 0 else [])]


def _solved(basis: np.ndarray, demand: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverse of a basis, the worth of each size in sequences, and how often each column is used."""
    inverse = dense.inverse(basis)
    return inverse, inverse.sum(axis=0), np.maximum(dense.product(inverse, demand), 0)


def configure(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """Configurations of the rounded sizes with multiplicities, from the linear programme of fewest sequences.

    Columns are generated: each round prices the sizes by the present basis and adds the multiset of the
    highest worth, until none is worth more than the sequence that it takes. Multiplicities are rounded down;
    what this leaves, less than one sequence for each configuration of the basis, is not configured.
    """
    if not sizes:
        return []
    demand, of = np.array(counts, dtype=float), np.array(sizes)
    basis = np.diag([float(capacity // n) for n in sizes])
    inverse, worth, amounts = _solved(basis, demand)
    for number in range(1, _COLUMNS * len(sizes) + 1):
        value, members = _best_column(of, worth, capacity)
        if value <= 1 + 1e-7:
            break
        change = sum(inverse[:, k] for k in members)
        ratio = np.where(change > 1e-9, amounts / np.where(change > 1e-9, change, 1), np.inf)
        leaves = int(ratio.argmin())
        basis[:, leaves] = np.bincount(members, minlength=len(sizes))
        if number % 256:  # one column of the basis changes, and its inverse by a product with one row
            row = inverse[leaves] / change[leaves]
            worth = worth + (1 - worth[members].sum()) * row
            inverse -= np.outer(change, row)
            inverse[leaves] = row
            step = amounts[leaves] / change[leaves]
            amounts = amounts - step * change
            amounts[leaves] = step
            np.maximum(amounts, 0, out=amounts)
        else:  # anew, before errors add up
            inverse, worth, amounts = _solved(basis, demand)
    amounts = _solved(basis, demand)[2]
    out = []
    for j in np.lexsort((np.arange(len(sizes)), -amounts)).tolist():
        if (times := int(amounts[j] + 1e-6)) > 0:
            out.append((times, [k for k, n in enumerate(basis[:, j].astype(int).tolist()) for _ in range(n)]))
    return out


def substitute(configurations: list[tuple[int, list[int]]], groups: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> tuple[list[Run], dict[int, int]]:
    """Actual lengths for rounded ones, cutting runs where a group passes on to its next length; and what is left of the groups."""
    stock = [[list(x) for x in reversed(members)] for _, members in groups]
    out: list[Run] = []
    for times, chosen in configurations:
        while times:
            need: dict[int, int] = {}
            for k in chosen:
                need[k] = need.get(k, 0) + 1
            step = min([times, *(max(1, stock[k][-1][1] // n) for k, n in need.items())])
            lengths = []
            if all(stock[k][-1][1] >= n * step for k, n in need.items()):
                for k, n in need.items():
                    lengths += [stock[k][-1][0]] * n
                    stock[k][-1][1] -= n * step
                    if not stock[k][-1][1]:
                        stock[k].pop()
            else:  # one sequence takes pieces of two lengths of a group
                step = 1
                for k, n in need.items():
                    for _ in range(n):
                        lengths.append(stock[k][-1][0])
                        stock[k][-1][1] -= 1
                        if not stock[k][-1][1]:
                            stock[k].pop()
            out.append(Run(step, lengths, capacity - sum(lengths)))
            times -= step
    left: dict[int, int] = {}
    for length, count in (x for members in stock for x in members):
        left[length] = left.get(length, 0) + count
    return out, left


def best_fit(runs: list[Run], small: dict[int, int], capacity: int) -> list[Run]:
    """Small lengths, longest first, each into the sequence with the least sufficient room."""
    by_room: dict[int, list[Run]] = {}
    for r in runs:
        by_room.setdefault(r.left, []).append(r)
    rooms = sorted(by_room)

    def put(run: Run) -> None:
        if run.left not in by_room:
            by_room[run.left] = []
            insort(rooms, run.left)
        by_room[run.left].append(run)

    for length in sorted(small, reverse=True):
        count = small[length]
        while count:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                put(Run(-(-count // (capacity // length)), [], capacity))
                continue
            room = rooms[at]
            run = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            each = min(room // length, count)
            times = min(run.count, count // each)
            if times < run.count:
                put(Run(run.count - times, run.lengths, run.left))
            put(Run(times, run.lengths + [length] * each, run.left - each * length))
            count -= each * times
    return [r for room in by_room.values() for r in room if r.lengths]


def pack_histogram(histogram: dict[int, int], capacity: int, large_over: float = LARGE_OVER, groups: int = GROUPS) -> list[Run]:
    """Pack lengths given as counts; returns runs of equal sequences that hold every piece once.

    Large lengths are grouped, configured and substituted; the small ones, and the few large ones that whole
    multiplicities leave, go best-fit into what room there is.
    """
    bound = int(capacity * large_over)
    grouped = linear_groups(histogram, bound, groups, capacity)
    configurations = configure([size for size, _ in grouped], [sum(c for _, c in members) for _, members in grouped], capacity)
    runs, left = substitute(configurations, grouped, capacity)
    if histogram.get(capacity):
        runs.append(Run(histogram[capacity], [capacity], 0))
    return best_fit(runs, {n: c for n, c in histogram.items() if 0 < n <= bound} | left, capacity)


def slot_table(runs: list[Run]) -> dict[int, np.ndarray]:
    """For each length the runs of its slots: first rank, first sequence, offset; ranks ascend."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    filled: dict[int, int] = {}
    sequence = 0
    for r in runs:
        offset = 0
        for n in r.lengths:
            slots.setdefault(n, []).append((filled.get(n, 0), sequence, offset))
            filled[n] = filled.get(n, 0) + r.count
            offset += n
        sequence += r.count
    return {n: np.array(x, dtype=np.int64) for n, x in slots.items()}


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("local_rank", pa.int64())])


def cut_pieces(documents: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Encode every text and cut longer documents; the first piece takes the remainder.

    ``local_rank`` numbers the pieces of a length within the task that made them.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4")
        rank = [0] * (capacity + 1)

        def items() -> Iterator[tuple]:
            for batch in batches:
                pairs = list(rows(batch, "doc_id", "text"))
                for at in range(0, len(pairs), 2000):
                    some = pairs[at : at + 2000]
                    for (doc, _), got in zip(some, enc.batch([t for _, t in some]), strict=True):
                        raw = memoryview(np.concatenate([got, end]).astype("<u4").tobytes())
                        n = len(raw) // 4
                        stop = n % capacity or capacity
                        start = piece = 0
                        while start < n:
                            length = stop - start
                            yield doc, piece, start, length, zlib.crc32(raw[4 * start : 4 * stop]), part, rank[length]
                            rank[length] += 1
                            start, stop, piece = stop, stop + capacity, piece + 1

        yield from batched(_PIECES, items())

    return documents.select("doc_id", "text").mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long")


def pack_documents(documents: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """One row per piece with its sequence and its gapless place there.

    The pieces are written to the shared folder once. Their counts by task and length (at most
    ``capacity`` rows a task) give each piece its rank among all of its length; the slots of a length
    are a broadcast of a few thousand rows, bounded by the number of lengths and not by the corpus.
    """
    spark = documents.sparkSession
    made = cut(cut_pieces(documents, tokenizer_path, end_id, capacity))
    counts = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(slot_table(pack_histogram(histogram, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for n in np.unique(length).tolist():
                here, of = length == n, slots.value[n]
                at = np.searchsorted(of[:, 0], rank[here], side="right") - 1
                sequence[here] = of[at, 1] + rank[here] - of[at, 0]
                offset[here] = of[at, 2]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = made.join(first, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
