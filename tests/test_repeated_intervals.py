"""Equal intervals take part once: the work of overlaps grows with distinct intervals, the results with all."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tierloom.operators import beside, best_match, corpus, intervals, space

LABEL = "annotation_id long, file_key string, tier_id string, participant string, category string, start_ms long, end_ms long"
LABELS = [(i, "f", "tu"[i % 2], "ab"[i % 3 % 2], ("Mouthing", "Others")[i % 5 % 2], 100 * (i % 4), 100 * (i % 4) + 150) for i in range(60)]


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_label_status_of_equal_labels(spark):
    labels = spark.createDataFrame(LABELS, LABEL)
    out = intervals.label_status(labels, 200)
    for r in out.collect():
        met = [x for x in LABELS if x[2] != r["tier_id"] and min(x[6], r["end_ms"]) - max(x[5], r["start_ms"]) >= 1]
        assert (r["n_counterparts"], r["n_agreeing"]) == (len(met), sum(x[4] == r["category"] for x in met))
    assert "count(1) AS n" in plan(out)  # equal labels are summed before the sweep


def test_annotations_meet_distinct_labels(spark):
    labels = intervals.label_status(spark.createDataFrame(LABELS, LABEL), 200).localCheckpoint()
    rows = corpus.add_flags(spark.createDataFrame([(n, "f", "ax"[n % 2], str(50 * (n % 3)), str(50 * (n % 3) + 120)) for n in range(12)], "row_id long, file_key string, speaker_id string, time_start string, time_end string"))
    out = intervals.annotate_with_labels(rows, labels, bin_ms=200)
    for r in out.collect():
        met = [x for x in LABELS if min(x[6], int(r["time_end"])) - max(x[5], int(r["time_start"])) >= 1]
        met = [x for x in met if x[3] == r["speaker_id"]] or met
        assert r["mouth_label_ids"] == sorted(x[0] for x in met) and r["n_mouth_labels"] == len(met) and r["n_mouth_tiers"] == len({x[2] for x in met})
    assert "Window" not in plan(out)  # pairs were sorted by annotation before
    table = lambda f: sorted(map(tuple, f.select("unit", "category", "n_unit_rows", "n_labels", "n_labels_agreed", "n_labels_disagreed", "n_rows").collect()))
    assert table(intervals.key_category_counts(out.drop("mouth_label_ids"))) == table(intervals.key_category_table(out, labels))


def test_best_parent_of_equal_rows(spark):
    schema = "key string, start_ms long, end_ms long"
    rows = spark.createDataFrame([(n, "k", 10 * (n % 2), 100) for n in range(40)], "row_id long, " + schema)
    parents = spark.createDataFrame([(n, "k", 10 * (n % 3), 100) for n in range(39, -1, -1)], "parent_id long, " + schema)
    out = intervals.best_parent(rows, parents)
    assert sorted((r["row_id"], r["parent_id"], r["exact"]) for r in out.collect()) == [(n, n % 2, True) for n in range(40)]
    assert "min(parent_id" in plan(out)


def test_bootstrap_holds_few_draws(spark):
    n = 20_000
    sums, counts = np.arange(n, dtype=float), np.ones(n)
    tracemalloc.start()
    found = space.bootstrap_mean(sums, counts, 500, seed=3)
    assert tracemalloc.get_traced_memory()[1] < 130_000_000  # 240 MB before
    tracemalloc.stop()
    means = sums[np.random.default_rng(3).integers(0, n, size=(500, n))].mean(axis=1)
    assert found == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))


def test_bootstrap_ci_of_signers(spark):
    """Every cell has the interval of its signers' sums and counts in id order; one signer has none."""
    rows = [("k", f"s{i:02d}", float(i % 7 + j), True) for i in range(12) for j in range(i % 3 + 1)] + [("k", "s00", 99.0, False), ("lone", "s01", 2.0, True)]
    out = {r["keyword"]: r for r in space.bootstrap_ci(spark.createDataFrame(rows[::-1], "keyword string, signer_id string, regions_used double, hand_present boolean"), ["keyword"]).collect()}
    clips = [[x[2] for x in rows if x[0] == "k" and x[1] == f"s{i:02d}" and x[3]] for i in range(12)]
    want = space.bootstrap_mean(np.array([sum(c) for c in clips]), np.array([float(len(c)) for c in clips]))
    assert (out["k"]["ci_low"], out["k"]["ci_high"]) == pytest.approx(want) and out["k"]["n_signers"] == 12 and out["k"]["ci_quality"] == "solid"
    assert out["lone"]["ci_low"] is None and out["lone"]["n_signers"] == 1


def brute_labels(row, labels):
    """(kept ids, categories, n, tiers) of one annotation, as the SQL has it: a null tier that decides nothing is unknown."""
    file, signer, s, e = row
    if file is None or s is None or e is None:
        return None, [], 0, 0
    e = s + 1 if e <= s else e
    met = []
    for i, f, tier, who, category, a, b in labels:
        if f == file and min(e, b) - max(s, a) >= 1:
            who, named = who or "", bool(signer) and tier is not None and signer in tier.lower()
            ok = bool(signer) and (named or (who != "" and (signer in who or who in signer)))
            met.append((i, tier, category, ok if ok or tier is not None or not signer else None))
    if any(x[3] for x in met):
        met = [x for x in met if x[3]]
    elif all(x[3] is None for x in met):
        met = []
    own = [x for x in met if x[2] is not None]
    return sorted(x[0] for x in met) or None, sorted({x[2] for x in own}), len(own), len({x[1] for x in own if x[1] is not None})


def dense_labels(seed):
    r = np.random.default_rng(seed)
    pick = lambda values: values[int(r.integers(0, len(values)))]
    names = ["a", "ab", "b1", "b", "12", "", None]
    labels = [(i, pick(["f", "f", "g", None]), pick(["x", "ya", "AB", None]), pick(names), pick(["Mouthing", "Others", None]), s := int(r.integers(0, 9000)), s + int(r.integers(-3, pick([30, 900, 9000])))) for i in range(150)]
    rows = [(i, pick(["f", "f", "g", None, "h"]), pick(names), pick([None, s, s, s, s]), s + int(r.integers(-3, pick([30, 900, 9000])))) for i in range(120) for s in [int(r.integers(0, 9000))]]
    return rows, labels


def test_labels_meet_annotations_in_their_task(spark):
    rows, labels = dense_labels(4)
    text = lambda x: None if x is None else str(x)
    left = spark.createDataFrame([(i, f, who, text(s), text(e)) for i, f, who, s, e in rows], "row_id long, file_key string, speaker_id string, time_start string, time_end string")
    right = spark.createDataFrame(labels, LABEL)
    for width in (3, 60, 60_000):
        out = intervals.annotate_with_labels(left, right, bin_ms=width)
        got = {x["row_id"]: (x["mouth_label_ids"], x["mouth_categories"], x["n_mouth_labels"], x["n_mouth_tiers"]) for x in out.collect()}
        assert got == {i: brute_labels((f, who or "", s, e), labels) for i, f, who, s, e in rows}
    # Pairs were joined by bin and their ids gathered by shuffles and sorts on disk before.
    assert "MapInArrow" in plan(out) and "flatten(" not in plan(out)
    assert {x["mouth_agreement"] for x in out.where("time_start IS NULL").collect()} == {"no times"}


def test_labels_of_many_pairs_a_few_at_a_time(monkeypatch):
    r = np.random.default_rng(5)
    n = 400
    a = r.integers(0, 5000, n)
    which = lambda *values: pa.array([values[i] for i in r.integers(0, len(values), n)])
    names = dict(start=pa.array(a), end=pa.array(a + r.integers(1, 2000, n)), signer=which("1", "12", "3"), tier=which("t", "u"), searched=which("t", "u"), category=which("x", "y"), status=which("s", None), n=pa.array(np.ones(n, np.int64)), ids=pa.array([[i] for i in range(n)]))
    held = beside.Labels(pa.StructArray.from_arrays(list(names.values()), names=list(names)), 1)
    place = pa.StructArray.from_arrays([pa.array([str(i % 13) for i in range(n)]), pa.array(a * 1.0), pa.array(a + 300.0)], names=["signer", "start", "end"])
    types = pa.schema([("mouth_categories", pa.list_(pa.string())), ("n_mouth_labels", pa.int64()), ("n_mouth_tiers", pa.int64()), ("mouth_label_ids", pa.list_(pa.int64()))])
    want = held.annotate(place, True, types).to_pylist()
    monkeypatch.setattr(beside, "HELD_PAIRS", 100)
    assert held.annotate(place, True, types).to_pylist() == want and max(x["n_mouth_labels"] for x in want) > 30


def brute_parent(row, parents):
    s, e = row
    found = []
    for a, b, i in parents:
        exact, share = (s, e) == (a, b), max(0, min(e, b) - max(s, a)) / max(1, e - s)
        if exact or share >= 0.5 or (abs(s - a) <= 120 and abs(e - b) <= 120):
            found.append((not exact, 0.0 if exact else -share, abs(s - a) + abs(e - b), a, b, i))
    return min(found)[-1] if found else None


def test_best_parent_of_dense_rows_makes_no_pairs(spark):
    r = np.random.default_rng(8)
    one = lambda n, lowest: [(int(s), int(s + r.integers(lowest, 2500))) for s in r.integers(0, 40_000, n)]
    rows, parents = one(300, -2) + [(500, 500), (9, 8)], one(200, 0) + [(7, 7), (100, 60_000)]
    parents = [(s, e, i) for i, (s, e) in enumerate(parents)]
    left = spark.createDataFrame([(i, "k", *x) for i, x in enumerate(rows)], "row_id long, key string, start_ms long, end_ms long")
    right = spark.createDataFrame([(i, "k", s, e) for s, e, i in parents] + [(999, "other", 500, 500)], "parent_id long, key string, start_ms long, end_ms long")
    want = {i: p for i, x in enumerate(rows) if (p := brute_parent(x, parents)) is not None}
    for width in (20, 700, 60_000):
        out = intervals.best_parent(left, right, width)
        assert {x["row_id"]: x["parent_id"] for x in out.collect()} == want
    # Rows and parents met in a join by bin before, and what came of it was sorted on disk.
    joins = [line for line in plan(out).splitlines() if "Join" in line]
    assert len(joins) == 1 and "FlatMapCoGroupsInArrow" in plan(out)


def test_best_of_dense_intervals():
    """n log^2 n: 100,000 rows and parents over one another, where pairs would be 10^9."""
    r = np.random.default_rng(9)
    s, s2 = np.sort(r.permutation(400_000)[:100_000]), np.sort(r.permutation(400_000)[:100_000])
    e, e2 = s + r.integers(1, 80_000, 100_000), s2 + r.integers(1, 80_000, 100_000)
    found = best_match.best_of(s, e, s2, e2, 0.5, 120)
    for i in range(0, 100_000, 5000):
        share = np.maximum(0, np.minimum(e[i], e2) - np.maximum(s[i], s2))
        assert found[i] == np.lexsort((e2, s2, np.abs(s[i] - s2) + np.abs(e[i] - e2), -share))[0] or e[i] - s[i] < 480
