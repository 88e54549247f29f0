"""Recursion without a fixed depth."""

from pyspark.sql import functions as F

from tierloom.operators import relations


def test_tiers_of_any_depth(spark):
    rows = [("d", f"t{i}", f"t{i - 1}" if i else None) for i in range(12)] + [("d", "x", "y"), ("d", "y", "x"), ("e", "t5", "t4")]
    tiers = spark.createDataFrame(rows, "doc string, tier_id string, parent string")
    got = sorted(map(tuple, relations.tier_closure(tiers, F.col("tier_id").isin("t0", "x")).collect()))
    assert got == sorted([("d", f"t{i}") for i in range(12)] + [("d", "x"), ("d", "y")])


def test_references_of_any_length(spark):
    rows = [("d", f"a{i}", f"a{i - 1}" if i else None, None if i else 5.0, None if i else 9.0) for i in range(50)]
    rows += [("d", "x", "y", None, None), ("d", "y", "x", None, None), ("d", "z", "x", None, None), ("d", "lost", "none", None, None)]
    frame = spark.createDataFrame(rows, "doc string, id string, ref string, start_ms double, end_ms double")
    got = {r["id"]: (r["start_ms"], r["end_ms"]) for r in relations.inherited_times(frame).collect()}
    assert got == {**{f"a{i}": (5.0, 9.0) for i in range(50)}, **dict.fromkeys(("x", "y", "z", "lost"), (None, None))}
