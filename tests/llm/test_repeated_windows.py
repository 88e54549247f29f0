"""Steps of the repeated windows without a session: texts are hashed many at a time, with the rows of brute force."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tierloom.llm import suffix_dedup as sd

SCHEMA = pa.schema([("g", pa.int32()), ("doc_id", pa.int64()), ("body", pa.binary())])


def dealt(rows, g):
    return pa.Table.from_batches(sd._packed(iter([pa.record_batch([pa.array([g] * len(rows)), [r[0] for r in rows], [r[1] for r in rows]], schema=SCHEMA)])), schema=sd._DEALT)


def removed(rows, batches=3, buckets=2, hot=20_000):
    """What is left of every row, by all steps; copies of a document may lie in several batches."""
    of = lambda tables, name, i: (lambda t: t.filter(pa.array(t.column(name).to_numpy() == i)))(pa.concat_tables(tables))
    held = [dealt(rows[g::batches], g) for g in range(batches)]
    sent = [sd.send_hashes(b, g, buckets, 50) for g, b in enumerate(held)]
    found = [sd.find_repeated(of(sent, "bucket", i), hot) for i in range(buckets)]
    told = [sd.send_runs(b, of(found, "g", g), g, buckets, 50) for g, b in enumerate(held)]
    owners = [sd.smallest_owners(of(told, "bucket", i), 50) for i in range(buckets)]
    return pa.concat_tables([sd.remove_repeats(b, of(owners, "g", g), 50) for g, b in enumerate(held)]).to_pylist()


def brute(rows):
    owner = {}
    number = lambda doc: float("inf") if doc is None else doc
    for doc, text in rows:
        for i in range(len(text) - 49):
            owner[text[i : i + 50]] = min(owner.get(text[i : i + 50], float("inf")), number(doc))
    out = []
    for doc, text in rows:
        gone = np.zeros(len(text) + 1, bool)
        for i in range(len(text) - 49):
            if owner[text[i : i + 50]] < number(doc):
                gone[i : i + 50] = True
        kept = bytes(b for b, x in zip(text, gone, strict=False) if not x)
        out.append({"doc_id": doc, "n_bytes": len(text), "n_removed": int(gone.sum()), "n_spans": int((gone[1:] & ~gone[:-1]).sum() + gone[0]), "kept_sha256": hashlib.sha256(kept).hexdigest()})
    return out


@pytest.mark.parametrize(("seed", "held", "hot"), [(0, 1 << 18, 20_000), (1, 1, 20_000), (2, 300, 4), (3, 1 << 18, 3)])
def test_steps_equal_brute_force(monkeypatch, seed, held, hot):
    r = np.random.default_rng(seed)
    monkeypatch.setattr(sd, "HELD_BYTES", held, raising=False)
    parts = [bytes(r.integers(97, 97 + k, n).astype(np.uint8)) for k, n in [(26, 120), (26, 70), (2, 90), (1, 130), (26, 55), (3, 200)] * 3]
    rows = [(None if i % 17 == 5 else i // 2 if i % 11 == 4 else i, b"".join(parts[int(x)] for x in r.integers(0, len(parts), r.integers(0, 4)))[int(r.integers(0, 30)) :]) for i in range(60)]
    key = lambda x: (x["doc_id"] is None, x["doc_id"] or 0, x["n_bytes"], x["kept_sha256"])
    assert sorted(removed(rows, hot=hot), key=key) == sorted(brute(rows), key=key)


def test_texts_are_hashed_many_at_a_time(monkeypatch):
    """One call for about HELD_BYTES of text; there was one for every document of every step."""
    calls, runs = [], sd.runs
    monkeypatch.setattr(sd, "runs", lambda *x: calls.append(1) or runs(*x))
    rows = [(i, bytes(np.random.default_rng(i % 150).integers(97, 123, 100).astype(np.uint8))) for i in range(300)]
    assert sum(x["n_removed"] for x in removed(rows)) == 15_000 and len(calls) == 9


def test_windows_of_different_hashes_are_not_sorted_together():
    data = np.frombuffer(b"abcabcabc" * 20, np.uint8)
    starts = np.arange(0, 90, 3)
    members, heads = sd._radix_members(data, starts, 50, np.arange(30) // 10)
    assert sorted(map(tuple, map(sorted, (x.tolist() for x in np.split(members, heads[1:]))))) == [tuple(range(i, i + 10)) for i in (0, 10, 20)]
