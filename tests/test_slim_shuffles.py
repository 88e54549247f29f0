"""Distinct counts deal slim cells, and the lines are dealt for one join."""

import pytest

from tierloom.operators import corpus
from tierloom.plans import adapters

SCHEMA = "source_file string, speaker_id string, region_code string, annotation string, lexical_item string, compound string, ambiguous string, d string"
ROWS = [(f"f{n % 7}", None if n % 11 == 0 else f"s{n % 5}", "AB"[n % 2], f"x{n % 13}", "" if n % 6 == 0 else f"w{n % 17}", "1" if n % 8 == 0 else "", "1" if n % 9 == 0 else "", "1" if n % 4 == 0 else "") for n in range(200)] + [("f0", "s1", "A", "once", "once", "", "", "")]


@pytest.fixture
def flagged(spark):
    return corpus.add_flags(spark.createDataFrame(ROWS, SCHEMA))


def distinct(values):
    return len({v for v in values if v is not None})


def test_lines_are_dealt_for_one_join(spark):
    plan = adapters.marked(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "l_orderkey" in joins[0] and "o_custkey" in joins[1]  # the other way round before: lines dealt by order, then by customer


def test_summary_counts_cells(flagged):
    out = corpus.summary(flagged)
    for r in out.collect():
        some = [x for x in ROWS if r["tag"] in ("GLOBAL", x[2])]
        parsed = [x for x in some if not x[5] and not x[6]]
        items = [x[4] for x in parsed if x[4]]
        assert (r["n_files_parsed"], r["n_signers"], r["n_annotations"]) == (distinct(x[0] for x in some), distinct(x[1] for x in some), len(some))
        assert (r["n_parsed"], r["n_ambiguous"], r["n_compound"]) == (len(parsed), sum(x[6] != "" for x in some), sum(x[5] != "" for x in some))
        assert (r["n_unique_annotation_strings"], r["n_with_lexical"], r["n_unique_lexical_items"]) == (distinct(x[3] for x in parsed), len(items), distinct(items))
        assert r["n_lexical_items_occurring_once"] == sum(items.count(x) == 1 for x in set(items))
        assert (r["n_lexical_only"], r["n_key_only"], r["n_lexical_with_key"], r["n_empty"]) == tuple(sum(bool(x[4]) == w and bool(x[7]) == k for x in parsed) for w, k in ((True, False), (False, True), (True, True), (False, False)))
    assert {r["tag"] for r in out.collect()} == {"GLOBAL", "A", "B"}
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()  # every row was copied for each distinct count


def test_recordings_are_dealt_once(flagged):
    out = corpus.per_file(flagged)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # two before
    for r in out.collect():
        some = [x for x in ROWS if x[0] == r["source_file"]]
        parsed = [x for x in some if not x[5] and not x[6]]
        assert (r["region_code"], r["n_signers"], r["n_annotations"], r["n_parsed"]) == (min(x[2] for x in some), distinct(x[1] for x in some), len(some), len(parsed))
        assert (r["n_ambiguous"], r["n_compound"], r["n_unique_lexical_items"]) == (sum(x[6] != "" for x in some), sum(x[5] != "" for x in some), distinct(x[4] for x in parsed if x[4]))
