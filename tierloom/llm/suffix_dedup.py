"""Removal of repeated byte windows by depth-limited radix sort of suffixes.

Equal groups of suffixes, ordered through THRESHOLD bytes only, are exactly the repeated windows. To
sort only what can repeat, and where it can meet, windows are first dealt out by their smallest 16-byte
hash (two equal windows have the same one): consecutive windows that share it form a run.

A. Every batch of documents sends each distinct smallest hash once, with its number of documents.
   What one document alone has is out; what very many have is hot.
B. Batches send their distinct runs of the rest with the smallest doc_id, dealt by that hash; runs of a
   hot hash are taken apart, and each of their windows is dealt by its own hash. A task joins equal
   runs; where a hash has several, it radix-sorts their windows, most significant digit first, and
   gives every group its smallest doc_id.
C. Batches get back the smallest doc_id of each of their runs' windows and remove what a smaller
   document has as well.

Batches and buckets both grow with the input; what they send each other goes in bundles, so rows grow with the
number of batches and not with its square.

Texts are shuffled once, to the batch that their id, text and input partition name, and all three steps read that
shuffle. A much repeated id, a missing one and a much repeated row are so spread over batches; a hash that rows of
one id have in two batches is then compared in vain, with the same result.

Defined cases: a null text is empty; texts under THRESHOLD bytes lose nothing; rows that repeat an id
are one document and take nothing from each other; rows without an id are one document with an id larger
than any; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bundles import BUNDLE, FAN, balanced, bundle, hand_on, unbundle, widths

THRESHOLD = 50
GRAM = 16
#: Bytes of text in a batch, about, and documents from which on a hash is hot.
BATCH_BYTES = 12_000_000
HOT_DOCS = 20_000
#: Bytes of text whose hashes meet in a bucket, about.
BUCKET_BYTES = 12_000_000
#: Bytes of text whose windows are hashed at once, about, and bytes after which a radix sort looks for groups that are done.
HELD_BYTES = 1 << 18
_LOOKS = (4, 12, 24)
_NO_ID = (1 << 63) - 1
_CODEC = "zstd"
_DEALT = pa.schema([("g", pa.int32()), ("doc_id", pa.int64()), ("n_bytes", pa.int32()), ("body", pa.binary())])
_MIX = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    n, have = len(a) - width + 1, 1
    while 2 * have <= width:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    return np.minimum(a[:n], a[width - have : width - have + n]) if width > have else a


def runs(data: np.ndarray, ends: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, end, 48-bit hash, text) of the maximal runs of windows with the same smallest gram hash.

    ``data`` holds texts one after another, which stop at ``ends``; a window lies in one of them.
    """
    gram = min(GRAM, threshold)
    if len(data) < threshold:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty.astype(np.uint64), empty
    n = len(data) - gram + 1
    if gram == GRAM:
        eight = np.array(np.ndarray(len(data) - 7, "<u8", data, strides=(1,)))
        h = eight[:n] * _MIX[0]
        h ^= h >> np.uint64(29)
        h += eight[8 : 8 + n] * _MIX[1]
    else:
        h = np.zeros(n, dtype=np.uint64)
        for k in range(gram):
            h = h * _MIX[0] + data[k : k + n]
    h ^= h >> np.uint64(32)
    h *= _MIX[2]
    h ^= h >> np.uint64(29)
    least = _sliding_min(h, threshold - gram + 1)
    new = np.concatenate([[True], least[1:] != least[:-1]])
    begins = np.concatenate([[0], ends[:-1]])
    edges = np.concatenate([begins, np.maximum(ends - threshold + 1, begins)])
    new[edges[edges < len(new)]] = True
    first = np.flatnonzero(new)
    end, text = np.append(first[1:], len(least)), np.searchsorted(ends, first, side="right")
    inside = first + threshold <= ends[text]
    first, end, text = first[inside], end[inside], text[inside]
    # A smallest value says little in its high bits; it is mixed again before it is dealt by them.
    mixed = least[first] * _MIX[1]
    mixed ^= mixed >> np.uint64(31)
    return first, end, (mixed * _MIX[0]) >> np.uint64(16), text


def _radix_order(keys: np.ndarray) -> np.ndarray:
    """A stable order of numbers by counting passes over their 16-bit digits, least significant first.

    NumPy sorts 16-bit numbers by radix.
    """
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    shift, top = 16, int(keys.max(initial=0))
    while top >> shift:
        order = order[np.argsort((keys[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def radix_groups(data: np.ndarray, starts: np.ndarray, depth: int) -> list[np.ndarray]:
    """Groups of two or more starts whose next ``depth`` bytes are equal (numbers into ``starts``)."""
    members, heads = _radix_members(data, starts, depth, np.zeros(len(starts), np.int64))
    return np.split(members, heads[1:]) if len(members) else []


def _radix_members(data: np.ndarray, starts: np.ndarray, depth: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups of ``radix_groups`` one after another, and where each begins; only starts of one ``group`` (ascending) meet.

    Most significant digit first: each pass deals what is still together by its next digit of two bytes, by
    radix, and drops what is alone. Now and then a group whose rest is equal throughout is done.
    """
    members = np.arange(len(starts))
    group = np.cumsum(np.diff(group, prepend=-1) != 0) - 1
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    pairs = padded[:-1].astype(np.uint16) << 8 | padded[1:]
    words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, depth, 2):
        if at in _LOOKS and depth - at >= 8 and len(members):
            first = starts[members[np.flatnonzero(np.diff(group, prepend=-1))][group]]
            own, equal = starts[members], np.ones(len(members), bool)
            for k in (*range(at, depth - 8, 8), depth - 8):
                equal &= words[own + k] == words[first + k]
            whole = np.bincount(group[~equal], minlength=int(group[-1]) + 1) == 0
            done.append((members[whole[group]], group[whole[group]]))
            members, group = members[~whole[group]], group[~whole[group]]
        if not len(members):
            break
        digit = pairs[starts[members] + at] if at + 1 < depth else padded[starts[members] + at].astype(np.uint16)
        if len(members) > 256 * (int(group[-1]) + 1):
            order = np.argsort(digit, kind="stable")
            order = order[_radix_order(group[order])]
        else:  # groups are in order already, and digits within small ones are soon put in order
            order = np.argsort(group << 16 | digit, kind="stable")
        members, group, digit = members[order], group[order], digit[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])])
        group = np.cumsum(new) - 1
        together = np.bincount(group)[group] > 1
        members, group = members[together], group[together]
        group = np.cumsum(np.diff(group, prepend=-1) != 0) - 1
    done.append((members, group))
    heads = [np.flatnonzero(np.diff(g, prepend=-1)) for _, g in done]
    before = np.cumsum([0, *(len(m) for m, _ in done)])
    return np.concatenate([m for m, _ in done]), np.concatenate([h + n for h, n in zip(heads, before, strict=False)])


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _texts(batch: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """(ids, ends, texts one after another) of the documents of a batch, some texts at a time."""
    ids, ends, held = [], [], bytearray()
    for part in batch.to_batches():
        for doc, size, data in zip(part.column("doc_id").to_pylist(), part.column("n_bytes").to_pylist(), part.column("body"), strict=True):
            if size:
                held += pa.decompress(data.as_buffer(), size, _CODEC)
            ids.append(_NO_ID if doc is None else doc)
            ends.append(len(held))
            if len(held) >= HELD_BYTES:
                yield np.array(ids), np.array(ends), bytes(held)
                ids, ends, held = [], [], bytearray()
    if ids:
        yield np.array(ids), np.array(ends), bytes(held)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as they are dealt: compressed one by one, as the shuffle keeps them until the end."""
    for batch in batches:
        body = [x.as_buffer() for x in batch.column("body")]
        held = pa.array([pa.compress(x, _CODEC, asbytes=True) if x.size else b"" for x in body], pa.binary())
        yield pa.record_batch([batch.column("g"), batch.column("doc_id"), pa.array([x.size for x in body], pa.int32()), held], schema=_DEALT)


#: What A sends and gets back, what B sends and C gets: rows in bundles. A run is one of a hot hash where content is null.
_A = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("hash", pa.uint64()), ("docs", pa.int32())])
_R = pa.schema([("g", pa.int32()), ("hash", pa.uint64()), ("hot", pa.bool_())])
_B = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("hash", pa.uint64()), ("doc", pa.int64()), ("several", pa.bool_()), ("content", pa.binary())])
_M = pa.schema([("g", pa.int32()), ("hash", pa.uint64()), ("content", pa.uint64()), ("at", pa.int32()), ("windows", pa.int32()), ("doc", pa.int64())])
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def send_hashes(batch: pa.Table, g: int, buckets: int, threshold: int) -> pa.Table:
    """A: the batch's distinct hashes with their number of documents."""
    met = [(hashes, ids[text]) for ids, ends, data in _texts(batch) for _, _, hashes, text in [runs(np.frombuffer(data, np.uint8), ends, threshold)]]
    hashes, ids = (np.concatenate([np.zeros(0, kind), *(x[i] for x in met)]) for i, kind in enumerate((np.uint64, np.int64)))
    order = np.lexsort((ids, hashes))
    hashes, ids = hashes[order], ids[order]
    other = np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)]
    once = other.copy()
    once[1:] |= ids[1:] != ids[:-1]
    docs = np.add.reduceat(once, np.flatnonzero(other), dtype=np.int64) if len(hashes) else np.zeros(0, np.int64)
    hashes = hashes[other]
    return pa.table([_bucket(hashes, buckets).astype(np.int32), np.full(len(hashes), g, np.int32), hashes, docs.astype(np.int32)], schema=_A)


def find_repeated(bucket: pa.Table, hot_docs: int) -> pa.Table:
    """A: for every batch, those of its hashes that two documents have, told whether hot."""
    hashes = _numbers(bucket, "hash")
    _, inverse = np.unique(hashes, return_inverse=True)
    n = np.bincount(inverse, weights=_numbers(bucket, "docs"))[inverse]
    kept = n > 1
    return pa.table([_numbers(bucket, "g")[kept], hashes[kept], n[kept] >= hot_docs], schema=_R)


def _expand(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each of ``n``, one after another."""
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class _Known:
    """Hashes to look for; most others are told by a table of their high bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.table = np.zeros(1 << 22, bool)
        self.table[self.hashes >> np.uint64(26)] = True

    def where(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of those that are known, ascending."""
        maybe = np.flatnonzero(self.table[hashes >> np.uint64(26)])
        if not len(maybe):
            return maybe
        wanted = hashes[maybe]
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return maybe[self.hashes[at] == wanted]


def _candidates(data: bytes, ends: np.ndarray, repeated: _Known, hot: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(key, first window, text, content, digest) of the runs to compare; a hot run gives each window by itself."""
    first, end, keys, text = runs(np.frombuffer(data, np.uint8), ends, threshold)
    kept = repeated.where(keys)
    first, end, keys, text = first[kept], end[kept], keys[kept], text[kept]
    is_hot = np.isin(keys, hot) if len(hot) else np.zeros(len(keys), bool)
    if is_hot.any():
        n = np.where(is_hot, end - first, 1)
        keys, text, burning = (np.repeat(x, n) for x in (keys, text, is_hot))
        first, end = _expand(first, n), np.repeat(end, n)
        end[burning] = first[burning] + 1
    contents = [data[a:b] for a, b in zip(first.tolist(), (end - 1 + threshold).tolist(), strict=True)]
    if is_hot.any():
        keys[burning] = [xxhash.xxh64_intdigest(contents[i], 1) >> 16 for i in np.flatnonzero(burning).tolist()]
    return keys, first, text, contents, np.fromiter(map(xxhash.xxh64_intdigest, contents), np.uint64, len(contents))


def send_runs(batch: pa.Table, found: pa.Table, g: int, buckets: int, threshold: int) -> pa.Table:
    """B: the batch's distinct runs with repeated hashes and their smallest doc_id; its hot hashes, for C."""
    hot = np.sort(_numbers(found, "hash")[_numbers(found, "hot").astype(bool)])
    repeated = _Known(_numbers(found, "hash"))
    keys, docs, digests = ([np.zeros(0, kind)] for kind in (np.uint64, np.int64, np.uint64))
    contents: list[bytes] = []
    for ids, ends, data in _texts(batch):
        key, _, text, content, digest = _candidates(data, ends, repeated, hot, threshold)
        # Of what is equal here the smallest and the largest document tell all.
        order = np.lexsort((ids[text], digest))
        new = np.concatenate([[True], digest[order[1:]] != digest[order[:-1]]])[: len(order)]
        once = order[new | np.append(new[1:], True)[: len(order)]]
        for held, new in ((keys, key), (docs, ids[text]), (digests, digest)):
            held.append(new[once])
        contents += [content[i] for i in once.tolist()]
    keys, docs = np.concatenate(keys), np.concatenate(docs)
    _, first, same = np.unique(np.concatenate(digests), return_index=True, return_inverse=True)
    least, most = np.full(len(first), _NO_ID, np.int64), np.full(len(first), -(1 << 63), np.int64)
    np.minimum.at(least, same, docs)
    np.maximum.at(most, same, docs)
    keys = keys[first]
    where = np.concatenate([_bucket(keys, buckets), np.full(len(hot), g % buckets)]).astype(np.int32)
    hashes, none = np.concatenate([keys, hot]), len(hot)
    order = np.lexsort((hashes, where))
    told = pa.array([*(contents[i] for i in first.tolist()), *[None] * none], pa.binary()), pa.array(least, pa.int64()), pa.array(most != least, pa.bool_())
    doc, several = (pa.concat_arrays([x, pa.nulls(none, x.type)]) for x in told[1:])
    return pa.table([where, np.full(len(where), g, np.int32), hashes, doc, several, told[0]], schema=_B).take(pa.array(order))


def smallest_owners(bucket: pa.Table, threshold: int) -> pa.Table:
    """B: for every batch and run, the smallest doc_id of each stretch of its windows."""
    lone = bucket.filter(pc.is_null(bucket.column("content")))
    bucket = bucket.filter(pc.is_valid(bucket.column("content"))).combine_chunks()
    hot = pa.table([lone.column("g"), lone.column("hash"), *(pa.nulls(len(lone), field.type) for field in list(_M)[2:])], schema=_M)
    if not len(bucket):
        return hot
    coded = pa.concat_arrays(bucket.column("content").chunks).dictionary_encode()
    codes, contents = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    g, keys, docs, several = (_numbers(bucket, name) for name in ("g", "hash", "doc", "several"))
    least = np.full(len(contents), _NO_ID, np.int64)
    np.minimum.at(least, codes, docs)
    key_of = np.zeros(len(contents), np.uint64)
    key_of[codes] = keys
    _, which, times = np.unique(key_of, return_inverse=True, return_counts=True)
    crowd = np.flatnonzero(times[which] > 1)
    crowd = crowd[np.argsort(which[crowd], kind="stable")]
    stretch_of, stretch_windows, stretch_doc, n_stretches = _sorted_owners([contents[i] for i in crowd.tolist()], which[crowd], least[crowd], threshold)
    digests = np.fromiter(map(xxhash.xxh64_intdigest, contents), np.uint64, len(contents))
    windows = np.fromiter(map(len, contents), np.int64, len(contents)) - (threshold - 1)
    place = np.full(len(contents), -1)
    place[crowd] = np.arange(len(crowd))
    # Rows whose run is one stretch, then those of the rest, for which each stretch counts.
    is_mixed, twice = place[codes] >= 0, several.astype(bool)
    row = np.flatnonzero(~is_mixed & (twice | (least[codes] < docs)))
    code = codes[row]
    parts = [pa.table([g[row], keys[row], digests[code], np.zeros(len(row), np.int32), windows[code].astype(np.int32), least[code]], schema=_M), hot]
    if len(crowd):
        smallest = np.minimum.reduceat(stretch_doc, stretch_of)
        row = np.flatnonzero(is_mixed)
        row = row[twice[row] | (smallest[place[codes[row]]] < docs[row])]
        at = place[codes[row]]
        n = n_stretches[at]
        stretch, row = _expand(stretch_of[at], n), np.repeat(row, n)
        parts.append(pa.table([g[row], keys[row], digests[codes[row]], _expand(np.zeros(len(n), np.int64), n).astype(np.int32), stretch_windows[stretch].astype(np.int32), stretch_doc[stretch]], schema=_M))
    return pa.concat_tables(parts)


def _sorted_owners(contents: list[bytes], hashes: np.ndarray, owner: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs, by their hashes in order, that may share only some of their windows: of each its first stretch, then the windows and smallest doc_id
    of all stretches, and how many a run has."""
    none = np.zeros(0, np.int64)
    if not contents:
        return none, none, none, none
    data = np.frombuffer(b"".join(contents), np.uint8)
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    windows = sizes - threshold + 1
    begins = np.cumsum(sizes) - sizes
    first = np.cumsum(windows) - windows
    starts = _expand(begins, windows)
    least = np.repeat(owner, windows)
    members, heads = _radix_members(data, starts, threshold, np.repeat(hashes, windows))
    if len(members):
        least[members] = np.repeat(np.minimum.reduceat(least[members], heads), np.diff(heads, append=len(members)))
    cut = np.concatenate([[True], least[1:] != least[:-1]])
    cut[first] = True
    edges = np.flatnonzero(cut)
    stretch_of = np.searchsorted(edges, first)
    return stretch_of, np.diff(edges, append=len(least)), least[edges], np.diff(stretch_of, append=len(edges))


def remove_repeats(batch: pa.Table, owners: pa.Table, threshold: int) -> pa.Table:
    """C: what is left of each document of a batch."""
    runs_ = owners.filter(owners.column("content").is_valid())
    hot = np.unique(_numbers(owners.filter(owners.column("content").is_null()), "hash"))
    repeated = _Known(np.unique(_numbers(owners, "hash")))
    digest, at, windows, least = (_numbers(runs_, name) for name in ("content", "at", "windows", "doc"))
    order = np.lexsort((at, digest))
    windows, least = windows[order].astype(np.int64), least[order]
    known, first_stretch, n_stretches = np.unique(digest[order], return_index=True, return_counts=True)
    before = np.cumsum(windows) - windows
    parts = []
    for ids, ends, data in _texts(batch):
        size, sizes = len(data), np.diff(ends, prepend=0)
        begins = ends - sizes
        gone = np.zeros(size, bool)
        if len(known):
            _, first, text, _, digest = _candidates(data, ends, repeated, hot, threshold)
            at = np.minimum(np.searchsorted(known, digest), len(known) - 1)
            told = np.flatnonzero(known[at] == digest)
            at = at[told]
            stretch, run = _expand(first_stretch[at], n_stretches[at]), np.repeat(told, n_stretches[at])
            start = first[run] + before[stretch] - np.repeat(before[first_stretch[at]], n_stretches[at])
            taken = least[stretch] < ids[text[run]]
            start, stop = start[taken], start[taken] + windows[stretch[taken]] - 1 + threshold
            gone = np.cumsum(np.bincount(start, minlength=size + 1) - np.bincount(stop, minlength=size + 1))[:size] > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        opens[begins[sizes > 0]] = gone[begins[sizes > 0]]
        removed, spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[ends], prepend=0) for x in (gone, opens))
        left = np.frombuffer(data, np.uint8)
        kept = (data[a:b] if not n else left[a:b][~gone[a:b]].tobytes() for a, b, n in zip(begins.tolist(), ends.tolist(), removed.tolist(), strict=True))
        parts.append(pa.table([pa.array(ids, mask=ids == _NO_ID), sizes, removed, spans, [hashlib.sha256(x).hexdigest() for x in kept]], schema=_RESULT))
    return pa.concat_tables([_RESULT.empty_table(), *parts])


def repeated_windows(documents: DataFrame, threshold: int = THRESHOLD, batch_bytes: int = BATCH_BYTES, hot_docs: int = HOT_DOCS, fan: int = FAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every document."""
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    batches, buckets = max(parts, -(-total // batch_bytes)), max(parts, -(-total // BUCKET_BYTES))
    fan = balanced(max(buckets, batches), fan)
    out, back = widths(buckets, fan), widths(batches, fan)
    g = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(batches)).cast("int").alias("g")
    dealt = documents.select(g, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    dealt = dealt.mapInArrow(_packed, "g int, doc_id long, n_bytes int, body binary")

    def hashes(key: tuple, batch: pa.Table) -> pa.Table:
        g = key[0].as_py()
        return bundle(send_hashes(batch, g, buckets, threshold), "bucket", out[0], g)

    def repeated(key: tuple, held: pa.Table) -> pa.Table:
        return bundle(find_repeated(unbundle(held, _A), hot_docs), "g", back[0], key[0].as_py())

    def compared(key: tuple, batch: pa.Table, held: pa.Table) -> pa.Table:
        g = key[0].as_py()
        return bundle(send_runs(batch, unbundle(held, _R), g, buckets, threshold), "bucket", out[0], g)

    def owners(key: tuple, held: pa.Table) -> pa.Table:
        return bundle(smallest_owners(unbundle(held, _B), threshold), "g", back[0], key[0].as_py())

    def left(key: tuple, batch: pa.Table, held: pa.Table) -> pa.Table:
        return remove_repeats(batch, unbundle(held, _M), threshold)

    met = hand_on(dealt.groupBy("g").applyInArrow(hashes, BUNDLE), "bucket", out, _A, fan)
    found = hand_on(met.groupBy("slot").applyInArrow(repeated, BUNDLE), "g", back, _R, fan)
    sent = hand_on(dealt.groupBy("g").cogroup(found.groupBy("slot")).applyInArrow(compared, BUNDLE), "bucket", out, _B, fan)
    told = hand_on(sent.groupBy("slot").applyInArrow(owners, BUNDLE), "g", back, _M, fan)
    return dealt.groupBy("g").cogroup(told.groupBy("slot")).applyInArrow(left, _OUT)
