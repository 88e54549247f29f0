"""What the labels beside an annotation say, told in the task that meets them.

A partition comes sorted by recording and stretch, in each the labels before the annotations. The labels of one stretch
and one batch of annotations are held; pairs are made some at a time and never leave the task, so what is shuffled grows
with annotations and labels, and only what an annotation lists grows with the density of a recording.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs, or counts of rows by kinds of label, that are held at once; rows and listed ids of a batch that is handed on.
HELD_PAIRS, HELD_COUNTS = 1_000_000, 4_000_000
SENT_ROWS, SENT_IDS = 5_000, 2_000_000


def _codes(*columns: pa.Array) -> tuple[np.ndarray, pa.Table]:
    """Rows numbered by their values, and the values of each number."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for column in columns:
        held = column.dictionary_encode(null_encoding="encode")
        code = code * max(1, len(held.dictionary)) + held.indices.to_numpy()
    _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    return inverse, pa.table(list(columns), names=[f"c{i}" for i in range(len(columns))]).take(first)


def containments(signers: list[str], names: list[str]) -> list[tuple[int, int]]:
    """(signer, name) for every name, not empty, that holds the signer."""
    at = {s: i for i, s in enumerate(signers) if s}
    sizes = sorted({len(s) for s in at})
    found = set()
    for j, name in enumerate(names):
        for size in sizes:
            if size > len(name):
                break
            found.update((at[part], j) for k in range(len(name) - size + 1) if (part := name[k : k + size]) in at)
    return sorted(found)


def expand(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each of ``n``, one after another."""
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class Labels:
    """The labels of a stretch: start, end, signer, tier (as it is and to be searched), category, status, n and ids."""

    def __init__(self, labels: pa.StructArray, min_overlap: float):
        order = np.lexsort((_double(labels.field("start")),))
        length = _double(labels.field("end")) - _double(labels.field("start"))
        # By length in powers of four, so that what may overlap a row is little more than what does.
        size = np.floor(np.log2(np.maximum(length, 1)) / 2)
        order = order[np.argsort(size[order], kind="stable")]
        order = order[length[order] >= min_overlap]
        labels, self.min_overlap = labels.take(order), min_overlap
        self.start, self.end = _double(labels.field("start")), _double(labels.field("end"))
        edges = np.flatnonzero(np.diff(size[order], prepend=-1)) if len(order) else order
        self.classes = [(a, b, 4.0 ** (size[order[a]] + 1)) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=False)]
        self.n = labels.field("n").to_numpy(zero_copy_only=False)
        self.kind, self.kinds = _codes(labels.field("tier"), labels.field("category"), labels.field("status"))
        self.who, self.whos = _codes(labels.field("signer"), labels.field("searched"))
        self.no_tier = labels.field("searched").is_null().to_numpy(zero_copy_only=False)
        ids = labels.field("ids")
        self.ids = ids.flatten()
        self.n_ids = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.first_id = np.cumsum(self.n_ids) - self.n_ids
        self.rank = pc.rank(self.ids, tiebreaker="dense").to_numpy().astype(np.int64) if len(self.ids) else np.zeros(0, np.int64)
        self.categories = pc.sort_indices(cats := pc.unique(pc.drop_null(self.kinds.column("c1").combine_chunks())))
        self.categories = cats.take(self.categories)

    def matches(self, signers: list[str]) -> np.ndarray:
        """signer * kinds of whose + whose, ascending, for all that match."""
        named, tiers = (self.whos.column(c).to_pylist() for c in ("c0", "c1"))
        by_name: dict[str, list[int]] = {}
        by_tier: dict[str, list[int]] = {}
        for i, (name, tier) in enumerate(zip(named, tiers, strict=True)):
            by_name.setdefault(name, []).append(i)
            by_tier.setdefault(tier or "", []).append(i)
        names, texts = list(by_name), list(by_tier)
        pairs = [(s, by_name[names[j]]) for s, j in containments(signers, names)]
        pairs += [(s, by_name[names[j]]) for j, s in containments(names, signers)]
        pairs += [(s, by_tier[texts[j]]) for s, j in containments(signers, texts)]
        return np.unique(np.array([s * len(named) + i for s, whose in pairs for i in whose], dtype=np.int64))

    def annotate(self, rows: pa.StructArray, listed: bool, types: pa.Schema) -> pa.Table:
        """mouth_categories, n_mouth_labels, n_mouth_tiers, ids and counts of each row, which has signer, start and end."""
        code, distinct = _codes(rows.field("signer"), rows.field("start"), rows.field("end"))
        names = distinct.column("c0").combine_chunks().dictionary_encode()
        s, e = _double(distinct.column("c1").combine_chunks()), _double(distinct.column("c2").combine_chunks())
        signer, signers = names.indices.to_numpy(), names.dictionary.to_pylist()
        known = ~(np.isnan(s) | np.isnan(e))
        low, high = (np.zeros((len(self.classes), len(s)), dtype=np.int64) for _ in range(2))
        for i, (a, b, longest) in enumerate(self.classes):
            low[i, known] = a + np.searchsorted(self.start[a:b], s[known] - longest)
            high[i, known] = a + np.searchsorted(self.start[a:b], e[known], side="right")
        high = np.maximum(low, high)
        total = np.cumsum((high - low).sum(axis=0))
        # Without any label near, no names are compared.
        keys = self.matches(signers) if len(total) and total[-1] else np.zeros(0, np.int64)
        can_match = np.zeros(len(signers), bool)
        can_match[keys // max(1, len(self.whos))] = True
        blank = np.array([not x for x in signers], bool)
        parts, begin, most = [], 0, max(1, HELD_COUNTS // max(1, len(self.kinds)))
        while begin < len(s):
            stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + HELD_PAIRS, side="right")))
            stop = min(stop, begin + most, len(s))
            own = [np.repeat(np.arange(begin, stop), high[i, begin:stop] - low[i, begin:stop]) for i in range(len(self.classes))]
            label = [expand(low[i, begin:stop], high[i, begin:stop] - low[i, begin:stop]) for i in range(len(self.classes))]
            own, label = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (own, label))
            meet = np.minimum(e[own], self.end[label]) - np.maximum(s[own], self.start[label]) >= self.min_overlap
            own, label = own[meet], label[meet]
            match = np.zeros(len(own), bool)
            tried = np.flatnonzero(can_match[signer[own]])
            wanted = signer[own[tried]] * len(self.whos) + self.who[label[tried]]
            match[tried] = len(keys) and keys[np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))] == wanted
            any_match, told = np.zeros(stop - begin, bool), np.zeros(stop - begin, bool)
            any_match[own[match] - begin] = True
            # As in SQL, whether a label without tier names the signer is unknown, and nothing is said where all are.
            told[own[~self.no_tier[label] | blank[signer[own]]] - begin] = True
            kept = match | (~any_match & told)[own - begin]
            parts.append(self._told(own[kept] - begin, label[kept], stop - begin, listed, types))
            begin = stop
        return pa.concat_tables([types.empty_table(), *parts]).take(code)

    def _told(self, own: np.ndarray, label: np.ndarray, n: int, listed: bool, types: pa.Schema) -> pa.Table:
        kinds = len(self.kinds)
        counts = np.bincount(own * kinds + self.kind[label], weights=self.n[label], minlength=n * kinds).astype(np.int64).reshape(n, kinds)
        category, tier, status = (self.kinds.column(c).combine_chunks() for c in ("c1", "c0", "c2"))
        none = np.bincount(own, minlength=n) == 0
        named = np.flatnonzero(category.is_valid().to_numpy(zero_copy_only=False))
        of_named = counts[:, named]
        cat = pc.index_in(category.take(pa.array(named)), self.categories).to_numpy(zero_copy_only=False)
        by_category = _any_by(of_named, cat, len(self.categories))
        tiers = tier.take(pa.array(named)).dictionary_encode()
        has_tier = np.flatnonzero(tiers.is_valid().to_numpy(zero_copy_only=False))
        by_tier = _any_by(of_named[:, has_tier], tiers.indices.take(pa.array(has_tier)).to_numpy(), len(tiers.dictionary))
        at, which = np.nonzero(by_category)
        columns = {"mouth_categories": _lists(self.categories.take(pa.array(which)), np.bincount(at, minlength=n), none), "n_mouth_labels": pa.array(of_named.sum(axis=1)), "n_mouth_tiers": pa.array(by_tier.sum(axis=1))}
        if listed:
            own, label = np.repeat(own, self.n_ids[label]), expand(self.first_id[label], self.n_ids[label])
            label = label[np.argsort(own * (len(self.ids) + 1) + self.rank[label])]
            columns["mouth_label_ids"] = _lists(self.ids.take(pa.array(label)), np.bincount(own, minlength=n), none)
        if "mouth_label_counts" in types.names:
            at, which = np.nonzero(of_named)
            kind = pa.array(named[which])
            entry = pa.StructArray.from_arrays([category.take(kind), status.take(kind), pa.array(of_named[at, which])], names=["category", "status", "n"])
            columns["mouth_label_counts"] = _lists(entry, np.bincount(at, minlength=n), none)
        return pa.table([columns[c].cast(types.field(c).type) for c in types.names], schema=types)


def _double(values: pa.Array) -> np.ndarray:
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _any_by(counts: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Whether any column of a code has a count, by row and code."""
    out = np.zeros((len(counts), n), bool)
    at, column = np.nonzero(counts)
    out[at, code[column]] = True
    return out


def _lists(values: pa.Array, n: np.ndarray, none: np.ndarray) -> pa.Array:
    """Lists of ``n`` values each, null where there is nothing to tell."""
    ends = np.cumsum(n)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values, mask=pa.array(none))


def beside(batches: Iterator[pa.RecordBatch], min_overlap: float, listed: bool, types: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Annotations with what their labels say; a batch has file, home, is_row, label, place and row, sorted by the first three."""
    key, held, labels, out, rows, ids = None, [], None, [], 0, 0
    for batch in batches:
        number, _ = _codes(batch.column("file"), batch.column("home"), batch.column("is_row"))
        edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        for a, b in zip(edges, edges[1:], strict=False):
            part = batch.slice(a, b - a)
            here = part.column("file")[0].as_py(), part.column("home")[0].as_py()
            if here != key:
                key, held, labels = here, [], None
            if not part.column("is_row")[0].as_py():
                held.append(part.column("label"))
                continue
            if labels is None:
                labels = Labels(pa.concat_arrays([part.column("label").slice(0, 0), *held]), min_overlap)
                held = []
            said = labels.annotate(part.column("place"), listed, types)
            out.append(pa.table([part.column("row"), *said.columns], names=["row", *types.names]))
            rows, ids = rows + b - a, ids + (int(pc.sum(pc.list_value_length(said.column("mouth_label_ids"))).as_py() or 0) if listed else 0)
            if rows >= SENT_ROWS or ids >= SENT_IDS:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out, rows, ids = [], 0, 0
    if out:
        yield from pa.concat_tables(out).combine_chunks().to_batches()
