"""Exact Jaccard join of word n-gram sets by vertical partitioning.

A text is the set of its distinct n-grams. The global order of n-grams is cut into fragments by ranges
of their hashes, so that every set falls into one segment for each fragment.

1. **Counting.** Map tasks pack the segments of many texts into one row for each fragment. All that the corpus holds
   of an n-gram meets in one fragment, which counts it and drops what only one text has. A text with fewer shared
   n-grams than the similarity asks of it, which the sum over its segments tells, is out. Counts make the order within
   the fragments' sum: rarest first, in steps of a twelfth of an octave.
2. **Candidates.** In the global order two sets within the similarity meet in a prefix of each. Texts that meet in
   an n-gram are first compared with one hub; only groups that this leaves in several components are compared whole,
   in pairs of cells of bounded size, by sizes and by `sketch`, which never excludes a true link: first with each text's
   most likely partners, at last with all that it allows.
3. **Verification.** The overlap of a candidate pair is counted in each fragment apart and summed for the pair; the
   decision is made in whole numbers on that sum.

Within its fragment an n-gram is known by 40 bits of its hash. A fragment holds a few million n-grams whatever the size of
the corpus, so two of a pair of texts meet by chance once in 10^9 pairs; in the steps before the last, such a meeting can
only add candidates.

An n-gram that very many texts hold would not fit one fragment. Map tasks note what is frequent among their own texts
(all texts are counted; one batch leaves out less than `LOCAL_SHARE` of its n-grams for any of them) and n-grams with
a high sum are known to be shared: they go last in the order and their segments are dealt by text.

Equal sets are one node (a 128-bit digest), so copies are never expanded into pairs.

Defined cases: null and blank texts have the empty set, which links with nothing; a text of fewer words is one n-gram;
repeated rows of an id keep their rows; null ids take part in links and are never the smallest id, so a component
without ids has none; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, cut, join_ones, rows
from .components import connected_components

SHINGLE = 5
#: Link when 100 * shared >= PERCENT * (size of the union).
PERCENT = 80
#: Fragments of the first step hold so many n-grams about; there are at least LEAST_FRAGMENTS.
FRAGMENT_NGRAMS, LEAST_FRAGMENTS = 4_000_000, 16
#: Fragments that overlaps are counted in.
OVERLAP_FRAGMENTS = 8
#: A batch reports an n-gram that this share of its n-grams are, and at least LOCAL_LEAST.
LOCAL_SHARE, LOCAL_LEAST = 1 / (1 << 17), 8
#: No more n-grams than this are taken for very frequent (8 bytes each in a broadcast).
MOST_FREQUENT = 1_000_000
#: Ranges whose n-grams a sketch counts.
SKETCH = 256
#: A node that more than this share of all candidate pairs name is dealt into parts.
HOT_SHARE = 0.0005
#: Likely partners of a text that a comparison of cells passes on, in rounds before all of them.
ROUNDS = (3,)
#: Texts of one cell; a comparison holds two cells at most.
LANES = 1024

_PACKED = pa.schema([("fragment", pa.int32()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("lengths", pa.binary()), ("grams", pa.binary())])
_PRINTS = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("size", pa.int64()), ("gram", pa.int64()), ("times", pa.int64())])
_SEGMENTS = pa.schema([("node", pa.binary()), ("size", pa.int64()), ("fragment", pa.int64()), ("grams", pa.binary()), ("ranks", pa.binary())])
_NODES = pa.schema([("node", pa.binary()), ("size", pa.int64()), ("alone", pa.int64()), ("sketch", pa.binary()), ("prefix", pa.list_(pa.int64())), ("low", pa.int32()), ("pieces", pa.list_(pa.list_(pa.int64())))])
_PAIRS = pa.schema([("a", pa.binary()), ("b", pa.binary())])

_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_SLICE = 1 << 20  # bytes of a text cut into words at a time
_MEMO_WORDS = 500_000
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd constants of well-known mixers
_WIDTH = 40  # bits of an n-gram within its fragment


class _Words(dict):
    """Hashes of words, remembered while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()


def ngrams(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words of a whole text, of all words where there are fewer."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    hashed, at = [], 0
    while at < len(raw):
        stop = raw.find(b" ", at + _SLICE)
        stop = len(raw) if stop < 0 else stop
        words = raw[at:stop].split()
        hashed.append(np.fromiter(map(_words.__getitem__, words), np.uint64, len(words)))
        at = stop
    word = np.concatenate(hashed) if hashed else np.empty(0, np.uint64)
    if not len(word):
        return word
    run = min(size, len(word))
    total = np.full(len(word) - run + 1, run, np.uint64)
    for k in range(run):
        total += (word[k : len(word) - run + 1 + k] ^ (word[k : len(word) - run + 1 + k] >> np.uint64(31))) * _FACTORS[k % len(_FACTORS)] + np.uint64(k)
    total = (total ^ (total >> np.uint64(32))) * _MIX
    return np.unique((total ^ (total >> np.uint64(29))) * _SPREAD)


def node_of(found: np.ndarray) -> bytes | None:
    """Digest of a set; the empty set has none."""
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def fragment_of(grams: np.ndarray, fragments: int) -> np.ndarray:
    """Number of the hash range of each n-gram."""
    return ((grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int32)


def _short(values: np.ndarray) -> bytes:
    """The low five bytes of each value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _WIDTH // 8].tobytes()


def _long(raw: bytes) -> np.ndarray:
    """Values of ``_short`` again."""
    out = np.zeros((len(raw) // (_WIDTH // 8), 8), np.uint8)
    out[:, : _WIDTH // 8] = np.frombuffer(raw, np.uint8).reshape(-1, _WIDTH // 8)
    return out.view("<u8").ravel()


def prints(documents: DataFrame, shingle: int = SHINGLE, local_least: int = LOCAL_LEAST) -> DataFrame:
    """Rows (doc_id, node, size) of every text, and rows (gram, times) of what is frequent within a batch of texts."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[tuple]:
            for batch in batches:
                held = []
                for doc, text in rows(batch, "doc_id", "text"):
                    held.append(ngrams(text, shingle))
                    yield doc, node_of(held[-1]), len(held[-1]), None, None
                if held:
                    grams, times = np.unique(np.concatenate(held), return_counts=True)
                    often = times >= max(local_least, int(times.sum() * LOCAL_SHARE))
                    for gram, n in zip(grams[often].view(np.int64).tolist(), times[often].tolist(), strict=True):
                        yield None, None, None, gram, n

        yield from batched(_PRINTS, items(), 20_000)

    return documents.select("doc_id", "text").mapInArrow(compute, "doc_id long, node binary, size long, gram long, times long")


def packed_segments(documents: DataFrame, fragments: int, frequent: np.ndarray, shingle: int = SHINGLE) -> DataFrame:
    """One row for each batch of texts and fragment: nodes, sizes, segment lengths and n-grams, end to end.

    Very frequent n-grams are known by their number and go into further fragments that are dealt by text.
    """
    known = documents.sparkSession.sparkContext.broadcast(frequent)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[tuple]:
            for batch in batches:
                sets = {}
                for (text,) in rows(batch, "text"):
                    found = ngrams(text, shingle)
                    if len(found):
                        sets[node_of(found)] = found
                if not sets:
                    continue
                ids, found = list(sets), list(sets.values())
                sizes = np.array([len(x) for x in found], np.uint32)
                owner = np.repeat(np.arange(len(ids)), sizes)
                grams = np.concatenate(found)
                where = fragment_of(grams, fragments)
                if len(known.value):
                    at = np.minimum(np.searchsorted(known.value, grams), len(known.value) - 1)
                    is_known = known.value[at] == grams
                    dealt = np.array([x[0] for x in ids], np.int32) % fragments + fragments
                    where, grams = np.where(is_known, dealt[owner], where), np.where(is_known, at.astype(np.uint64), grams)
                order = np.argsort(where, kind="stable")
                where, owner, grams = where[order], owner[order], grams[order]
                edges = np.flatnonzero(np.diff(where)) + 1
                for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(where)], strict=True):
                    own, lengths = np.unique(owner[start:stop], return_counts=True)
                    yield int(where[start]), b"".join(ids[i] for i in own.tolist()), sizes[own].tobytes(), lengths.astype(np.uint32).tobytes(), _short(grams[start:stop])

        yield from batched(_PACKED, items(), 16)

    return documents.select("text").mapInArrow(compute, "fragment int, nodes binary, sizes binary, lengths binary, grams binary")


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Steps of a twelfth of an octave, 255 at most."""
    return np.minimum(np.floor(12 * np.log2(counts)), 255).astype(np.uint8)


def shared_segments(packed: DataFrame, fragments: int) -> DataFrame:
    """(node, size, fragment, grams, ranks): of every segment the n-grams that other texts hold too, and how frequent they are."""
    columns = [f.name for f in _PACKED]

    def whole(held: list[tuple]) -> Iterator[tuple]:
        fragment = held[0][0]
        raw = b"".join(h[1] for h in held)
        sizes, lengths = (np.concatenate([np.frombuffer(h[k], np.uint32) for h in held]) for k in (2, 3))
        words = np.frombuffer(raw, np.uint64).reshape(-1, 2)
        order = np.lexsort((words[:, 1], words[:, 0]))
        new = np.concatenate([[True], (np.diff(words[order, 0]) != 0) | (np.diff(words[order, 1]) != 0)])
        first = np.zeros(len(words), bool)
        first[order[new]] = True  # copies that other batches packed too
        grams = np.concatenate([_long(h[4]) for h in held])
        owner = np.repeat(np.arange(len(words), dtype=np.uint32), lengths)
        if not first.all():
            once = first[owner]
            grams, owner = grams[once], owner[once]
        if fragment < fragments:
            by = np.argsort(grams, kind="stable")
            edges = np.concatenate([[0], np.flatnonzero(np.diff(grams[by])) + 1, [len(by)]])
            counts = np.empty(len(by), np.int64)
            counts[by] = np.repeat(np.diff(edges), np.diff(edges))
            kept = counts > 1
            grams, owner, ranks = grams[kept], owner[kept], ranks_of(counts[kept])
        else:
            ranks = np.full(len(grams), 255, np.uint8)
        edges = np.searchsorted(owner, np.arange(len(words) + 1))
        base = min(fragment, fragments)
        for i in np.flatnonzero(np.diff(edges)).tolist():
            at = slice(edges[i], edges[i + 1])
            yield raw[16 * i : 16 * i + 16], int(sizes[i]), base, _short(grams[at]), ranks[at].tobytes()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[tuple]:
            held: list[tuple] = []
            for batch in batches:
                for row in rows(batch, *columns):
                    if held and held[0][0] != row[0]:
                        yield from whole(held)
                        held = []
                    held.append(row)
            if held:
                yield from whole(held)

        yield from batched(_SEGMENTS, items(), 5000)

    dealt = packed.repartition("fragment").sortWithinPartitions("fragment")
    return dealt.mapInArrow(compute, "node binary, size long, fragment long, grams binary, ranks binary")


def _bins(grams: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each n-gram; ``bins`` is a power of two."""
    return (grams * _SPREAD >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)


def survivors(segments: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Nodes with enough shared n-grams: (node, size, alone, sketch, prefix, low, pieces).

    ``alone`` counts the n-grams that no other text has; they come first in the order. ``prefix`` holds the shared
    n-grams of the prefix in the order, and the first ``low`` of them are those of which a linked pair needs one.
    ``pieces`` are all shared n-grams in the fragments of the last step.
    """

    def node_row(held: list[tuple]) -> tuple | None:
        node, size = held[0][0], held[0][1]
        parts = [_long(h[3]) for h in held]
        if 100 * (n := sum(map(len, parts))) < percent * size:
            return None
        grams = np.concatenate([p | np.uint64(h[2] << _WIDTH) for h, p in zip(held, parts, strict=True)])
        ranks = np.frombuffer(b"".join(h[4] for h in held), np.uint8)
        ordered = grams[np.lexsort((grams, ranks))].view(np.int64)
        alone, prefix, low = size - n, size - -(-percent * size // 100) + 1, size * (100 - percent) // (100 + percent) + 1
        head = ordered[: max(0, prefix - alone)]
        once = np.concatenate([[True], head[1:] != head[:-1]])[: len(head)]  # chance meetings within a text stand side by side
        sketch = np.minimum(np.bincount(_bins(grams, SKETCH), minlength=SKETCH), 255).astype(np.uint8)
        piece = _bins(grams, OVERLAP_FRAGMENTS)
        pieces = [grams[piece == k].view(np.int64).tolist() for k in range(OVERLAP_FRAGMENTS)]
        return node, size, alone, sketch.tobytes(), head[once].tolist(), int(once[: max(0, low - alone)].sum()), pieces

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[tuple]:
            held: list[tuple] = []
            for batch in batches:
                for row in rows(batch, *_SEGMENTS.names):
                    if held and held[0][0] != row[0]:
                        yield node_row(held)
                        held = []
                    held.append(row)
            if held:
                yield node_row(held)

        yield from batched(_NODES, (found for found in items() if found), 500)

    dealt = segments.repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(compute, "node binary, size long, alone long, sketch binary, prefix array<long>, low int, pieces array<array<long>>")


def least_difference(size: np.ndarray, alone: np.ndarray, sketch: np.ndarray, one: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that sizes and sketches allow to be linked with number ``one``, and by how much they differ from it at least.

    Sets differ at least by what each has alone and by what their counts differ in any range, and may differ by
    (100 - percent) / (100 + percent) of their sizes' sum.
    """
    at = np.flatnonzero(np.minimum(size, size[one]) * 100 >= np.maximum(size, size[one]) * percent)
    apart = np.abs(sketch[at] - sketch[one]).sum(axis=1, dtype=np.int64) + alone[at] + alone[one]
    kept = apart * (100 + percent) <= (100 - percent) * (size[at] + size[one])
    return at[kept], apart[kept]


def verified(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT, lanes: int = LANES) -> DataFrame:
    """The pairs (a, b) at the similarity: overlaps counted in each fragment apart and summed for the pair.

    A node that very many pairs name as ``a`` is dealt into parts.
    """
    hot = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > max(lanes, int(pairs.count() * HOT_SHARE)))
    hot = F.broadcast(hot.select("a", F.ceil(F.col("n") / lanes).cast("int").alias("parts")))  # at most 1 / HOT_SHARE rows
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    pieces = nodes.select("node", "size", F.posexplode("pieces").alias("fragment", "grams")).where(F.size("grams") > 0)
    own = pieces.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi").withColumnRenamed("node", "a").join(hot, "a", "left")
    left = own.select("a", "fragment", F.col("grams").alias("own"), F.col("size").alias("size_a"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    met = dealt.join(left, ["a", "part"]).join(pieces.withColumnRenamed("node", "b"), ["b", "fragment"])
    counted = met.select("a", "b", "size_a", "size", F.size(F.array_intersect("own", "grams")).alias("n"))
    summed = counted.groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("size_a").alias("size_a"), F.first("size").alias("size_b"))
    return summed.where(F.col("n") * (100 + percent) >= percent * (F.col("size_a") + F.col("size_b"))).select("a", "b")


def _cell_pairs(units: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Pairs of a unit that are apart yet, not both high, and allowed by their sketches; of a text the ``most`` likely ones, or all."""

    def whole(held: list[tuple]) -> Iterator[tuple]:
        _, side, nodes, labels, low, size, alone, sketch = zip(*held, strict=True)
        size, alone, low, side = np.array(size), np.array(alone), np.array(low, bool), np.array(side)
        sketch = np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, SKETCH).astype(np.int16)
        _, label = np.unique(np.frombuffer(b"".join(labels), "V16").view("S16"), return_inverse=True)
        two = 0 < side.sum() < len(side)
        for i in np.flatnonzero(side == 1).tolist() if two else range(len(nodes)):
            other = (label != label[i]) & (low | low[i])
            at = np.flatnonzero(other & (side == 0) if two else other & (np.arange(len(nodes)) > i))
            if len(at):
                at = np.concatenate([[i], at])
                near, apart = least_difference(size[at], alone[at], sketch[at], 0, percent)
                near, apart = near[near > 0], apart[near > 0]
                for j in at[near if most is None else near[np.argsort(apart, kind="stable")[:most]]].tolist():
                    yield (nodes[i], nodes[j]) if nodes[i] < nodes[j] else (nodes[j], nodes[i])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[tuple]:
            held: list[tuple] = []
            for batch in batches:
                for row in rows(batch, "unit", "side", "node", "label", "low", "size", "alone", "sketch"):
                    if held and held[0][0] != row[0]:
                        yield from whole(held)
                        held = []
                    held.append(row)
            if held:
                yield from whole(held)

        yield from batched(_PAIRS, items())

    return units.repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(compute, "a binary, b binary").distinct()


def similar_pairs(nodes: DataFrame, percent: int = PERCENT, lanes: int = LANES) -> DataFrame:
    """Links (a, b) between nodes whose components are those of all pairs at the similarity."""
    placed = nodes.select("node", F.posexplode("prefix").alias("at", "gram"), "low").withColumn("low", (F.col("at") < F.col("low")).cast("int"))
    marks = [F.sum(F.xxhash64("node", "low", F.lit(k)).bitwiseAND(F.lit((1 << 40) - 1))).alias(f"mark{k}") for k in range(2)]
    sizes = placed.groupBy("gram").agg(F.count("*").alias("n"), F.sum("low").alias("lows"), *marks).where("n > 1 AND lows > 0")
    # N-grams that the same nodes hold alike are one group.
    groups = sizes.groupBy("n", "mark0", "mark1").agg(F.min("gram").alias("gram"), F.count("*").alias("times"))
    met = cut(placed.join(groups.select("gram", "n", "times"), "gram").select("gram", "node", "low", "n", "times"))
    weight = met.groupBy("node").agg(F.sum(F.col("n") * F.col("times")).alias("weight"))
    hubs = met.join(weight, "node").groupBy("gram").agg(F.max(F.struct("weight", "node")).alias("h"), F.first("n").alias("n")).select("gram", F.col("h.node").alias("a"), "n")
    # The hub's one row goes to every part of a crowded group.
    parts = F.ceil(F.col("n") / (4 * lanes)).cast("int")
    starred = met.withColumn("part", F.pmod(F.xxhash64("node"), parts)).join(hubs.select("gram", "a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")), ["gram", "part"])
    stars = cut(starred.where("node <> a").select("a", F.col("node").alias("b")).distinct())
    links = cut(verified(stars, nodes, percent, lanes))

    # First what is most likely, so that texts with very many partners are joined by a few of them; then all that is left.
    for most in (*ROUNDS, None):
        units = _open_units(met, connected_components(links), lanes).join(nodes.select("node", "size", "alone", "sketch"), "node")
        links = cut(links.unionByName(verified(cut(_cell_pairs(units, percent, most)), nodes, percent, lanes)))
    return links


def _open_units(met: DataFrame, labels: DataFrame, lanes: int) -> DataFrame:
    """Pairs of cells (unit, side, node, label, low) of the groups whose nodes are in several components yet.

    What is outside the largest component of a group meets all of it; inside there is nothing left to join.
    """
    labelled = met.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).where("n > 2").select("gram", "node", "low", "label")
    counts = labelled.groupBy("gram", "label").agg(F.count("*").alias("c"))
    top = counts.groupBy("gram").agg(F.max(F.struct("c", "label")).alias("t"), F.sum("c").alias("all"), F.count("*").alias("labels")).where("labels > 1")
    top = top.select("gram", F.col("t.label").alias("top"), F.ceil(F.col("t.c") / lanes).cast("int").alias("inner"), F.ceil((F.col("all") - F.col("t.c")) / lanes).cast("int").alias("outer"))
    left = labelled.join(top, "gram").withColumn("inside", F.col("label") == F.col("top"))
    left = left.withColumn("cell", F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    upto = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1)).alias("with")
    row = ["node", "label", "low"]
    within = left.where("inside").select("gram", "cell", upto("outer"), *row).select(F.xxhash64("gram", F.lit(0), "cell", "with").alias("unit"), F.lit(0).alias("side"), *row)
    across = left.where("NOT inside").select("gram", "cell", upto("inner"), *row).select(F.xxhash64("gram", F.lit(0), "with", "cell").alias("unit"), F.lit(1).alias("side"), *row)
    among = left.where("NOT inside").select("gram", "cell", upto("outer"), *row).select(F.xxhash64("gram", F.lit(1), F.least("cell", "with"), F.greatest("cell", "with")).alias("unit"), (F.col("cell") > F.col("with")).cast("int").alias("side"), *row)
    return within.unionByName(across).unionByName(among)


def jaccard_components(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, fragment_ngrams: int = FRAGMENT_NGRAMS, local_least: int = LOCAL_LEAST, lanes: int = LANES) -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest doc_id reachable over links, itself included."""
    made = cut(prints(documents, shingle, local_least))
    texts = made.where("size IS NOT NULL").select("doc_id", "node", "size")
    total = int(texts.agg(F.sum("size")).first()[0] or 0)
    fragments = max(LEAST_FRAGMENTS, -(-total // fragment_ngrams))
    bound = max(fragment_ngrams // 8, total // MOST_FREQUENT)
    often = made.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("times").alias("n")).where(F.col("n") >= bound).select("gram")
    frequent = np.sort(np.array([r[0] for r in often.toLocalIterator()], np.int64).view(np.uint64))  # at most MOST_FREQUENT

    nodes = cut(survivors(shared_segments(packed_segments(documents, fragments, frequent, shingle), fragments), percent))
    links = cut(similar_pairs(nodes, percent, lanes))
    groups = connected_components(links)

    firsts = texts.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    named = firsts.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    joined = named.join(groups.select("node"), "node", "left_semi")
    least = joined.groupBy("component").agg(F.min("first").alias("least"))
    ids = cut(named.join(least, "component", "left").select("node", F.coalesce("least", "first").alias("component_id")))
    found = join_ones(texts.where("node IS NOT NULL"), ids, "node").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return found.unionByName(texts.where("node IS NULL").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))


#: The same rows in DuckDB, by all pairs that share an n-gram and a recursive reach; for small tables only.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT r.doc_id, coalesce(n, 0) AS n_shingles, r.component_id FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r LEFT JOIN sizes USING (doc_id)
"""
