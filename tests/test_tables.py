"""Numbers, names, typed loads, versions and masks against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierloom.operators import geometry, numbering, relations, space
from tierloom.sources import files, typed, versions


def test_dense_numbers_have_no_gap(spark):
    r = random.Random(3)
    values = [(r.randrange(50), f"k{r.randrange(99)}") for _ in range(500)] + [(None, "n"), (None, "m")]
    frame = spark.createDataFrame(values, "a int, b string").repartition(7)
    got = sorted((x["number"], x["a"], x["b"]) for x in numbering.dense_numbers(frame, ["a", "b"], start=5).collect())
    assert [n for n, *_ in got] == list(range(5, 5 + len(values)))
    assert [x[1:] for x in got] == sorted(values, key=lambda v: (v[0] is not None, v[0] or 0, v[1]))
    assert numbering.dense_numbers(frame.where("false"), ["a"]).count() == 0


def test_free_ids_follow_the_highest(spark):
    taken = spark.createDataFrame([("d", "pa7"), ("d", "a99"), ("d", "pa12x"), ("e", None)], "doc string, id string")
    asked = spark.createDataFrame([("d", 2), ("d", 1), ("e", 1), ("f", 9)], "doc string, n int")
    assert sorted((r["doc"], r["n"], r["id"]) for r in numbering.free_ids(asked, taken, "doc", ["n"]).collect()) == [("d", 1, "pa8"), ("d", 2, "pa9"), ("e", 1, "pa1"), ("f", 9, "pa1")]




def test_unique_names(spark):
    r = random.Random(8)
    wishes = ["a", "b", "a_2", "a_3", "b_2", "x_2_2"]
    taken = [("d", "a"), ("d", "a_3"), ("d", "b_x"), ("e", "b")]
    requests = [(s, k, r.choice(wishes)) for k, s in enumerate(r.choices(["d", "e", "f"], k=80))]
    got = numbering.unique_names(spark.createDataFrame(requests, "doc string, k int, name string"), spark.createDataFrame(taken, "doc string, name string"), "doc", "k", "name").collect()
    assert len(got) == len(requests)
    names = [(x["doc"], x["unique_name"]) for x in got]
    assert len(set(names)) == len(names) and not set(names) & set(taken)
    by_key = {x["k"]: x for x in got}
    for scope, key, name in requests:
        made = by_key[key]["unique_name"]
        assert made == name or made.rpartition("_")[0] == name and int(made.rpartition("_")[2]) >= 2
        if made != name:  # no smaller number was left
            lower = [name, *(f"{name}_{i}" for i in range(2, int(made.rpartition("_")[2])))]
            assert all((scope, x) in set(names) | set(taken) for x in lower)
    few = numbering.unique_names(spark.createDataFrame([("d", 1, "a"), ("d", 2, "a"), ("d", 3, "a"), ("d", 4, "b")], "doc string, k int, name string"), spark.createDataFrame([("d", "a"), ("d", "a_3")], "doc string, name string"), "doc", "k", "name")
    assert {x["k"]: x["unique_name"] for x in few.collect()} == {1: "a_2", 2: "a_4", 3: "a_5", 4: "b"}


SCHEMA = "name string, n int, x double, flag boolean, absent string, gone int"


def test_typed_from_text_and_from_parquet(spark, tmp_path):
    text = spark.createDataFrame([("a", " 7 ", "1.5", "TRUE", "e1"), (None, "seven", "", "no", "e2"), ("c", "9" * 30, "nan", "Yes", "e3")], "`﻿Name ` string, n string, X string, flag string, extra string")
    got = typed.typed(text, SCHEMA)
    assert got.columns == ["name", "n", "x", "flag", "absent", "gone", "extra", "misfit"]
    rows = got.orderBy("extra").collect()
    assert [tuple(r)[:2] for r in rows] == [("a", 7), ("", None), ("c", None)] and np.isnan(rows[2]["x"]) and [r["flag"] for r in rows] == [True, False, True]
    assert [r["misfit"] for r in rows] == [{}, {"n": "seven"}, {"n": "9" * 30}] and rows[0]["absent"] == "" and rows[0]["gone"] is None
    got.drop("misfit", "extra").write.parquet(str(tmp_path / "p"))
    got.drop("misfit", "extra").write.option("header", True).csv(str(tmp_path / "t.csv"))
    one, two = (typed.load_typed(spark, str(tmp_path / n), SCHEMA) for n in ("p", "t.csv"))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.schema == two.schema


def test_versions(spark, tmp_path):
    path = str(tmp_path / "index")
    old = spark.createDataFrame([(1, "left", 30), (2, "right", None)], "clip int, hand string, age int")
    with pytest.raises(ValueError, match="no version"):
        versions.read_version(spark, path)
    assert not versions.refresh(old, path, "clip", ["hand", "age"]).written and versions.current_version(spark, path) is None
    assert versions.refresh(old, path, "clip", ["hand", "age"], write=True).version == 1
    new = spark.createDataFrame([(1, "right", 30), (2, "right", 41), (3, "left", 1)], "clip int, hand string, age int")
    dry = versions.refresh(new, path, "clip", ["hand", "age"])
    assert (dry.changed, dry.written, dry.version) == ({"hand": 1, "age": 1, "clip": 1}, False, 1)
    assert sorted(tuple(r) for r in dry.cells.collect()) == [(1, "hand", "left", "right"), (2, "age", None, "41")]

    @F.udf("int")
    def failing(v):
        raise RuntimeError("the refresh dies")

    with pytest.raises(Exception, match="the refresh dies"):
        versions.refresh(new.withColumn("size", failing("age")), path, "clip", ["hand", "age"], write=True)
    assert versions.read_version(spark, path).count() == 2 and versions.current_version(spark, path) == 1
    done = versions.refresh(new, path, "clip", ["hand", "age"], write=True)
    assert done.written and done.version == 3 and versions.read_version(spark, path).count() == 3
    assert not versions.refresh(new, path, "clip", ["hand", "age"], write=True).written
    assert versions.read_version(spark, path, 1).count() == 2  # the backup
    assert versions.undo(spark, path) == 4 and versions.read_version(spark, path).count() == 2
    assert versions.undo(spark, str(tmp_path / "none")) is None


def test_points_on_a_mask(spark):
    r = np.random.default_rng(4)
    masks = {k: (r.random((12, 20)) < 0.5).astype(int) for k in range(6)}
    masks[5][:] = 0
    points = [(k, float(x), float(y), 20, 12) for k in range(7) for x, y in r.uniform(-0.2, 1.2, (9, 2))] + [(0, None, 0.5, 20, 12), (1, float("nan"), 0.5, 20, 12), (2, 0.5, 0.5, 20, 12), (2, 0.5, 0.5, 20, 12)]
    rows = spark.createDataFrame([(k, y, m[y].tolist()) for k, m in masks.items() for y in range(12)], "clip int, row int, mask array<int>")
    runs = rows.select("clip", "row", F.explode(geometry.mask_runs(F.col("mask"))).alias("r")).select("clip", "row", "r.*")
    got = geometry.on_target(spark.createDataFrame(points, "clip int, x double, y double, width int, height int"), runs, ["clip"])
    want = {}
    for k in range(7):
        own = [(x, y) for c, x, y, _, _ in points if c == k]
        hits = [masks[k][int(np.clip(np.round(y * 12), 0, 11)), int(np.clip(np.round(x * 20), 0, 19))] if k in masks and x is not None and x == x else 0 for x, y in own]
        want[k] = (len(own), round(float(np.mean(hits)), 9), float(np.mean(hits)) >= 0.6)
    assert {x["clip"]: (x["n_points"], round(x["inside"], 9), x["on_target"]) for x in got.collect()} == want
    wide = {x["clip"]: x["inside"] for x in geometry.on_target(spark.createDataFrame(points, "clip int, x double, y double, width int, height int"), runs, ["clip"], dilate=20).collect()}
    assert wide[3] == 1.0 and wide[5] == 0.0
    odd = spark.createDataFrame([([],), ([0, 0],), ([1],), ([1, 1, 0, 1],)], "m array<int>").select(geometry.mask_runs(F.col("m")).alias("r")).collect()
    assert [[tuple(x) for x in r["r"]] for r in odd] == [[], [], [(0, 0)], [(0, 1), (3, 3)]]


def test_signers_are_joined_on_whole_entries(spark):
    names = spark.createDataFrame([(n,) for n in ("FO_12_A", "FO_1", "FO1", "GM-3b", "", "Z", None)], "name string")
    roster = spark.createDataFrame([("FO_1",), ("FO",), ("GM_3",), ("F",), ("",)], "signer_id string")
    found = relations.match_signers(names, roster)
    assert {r["name"]: (r["signer_id"], r["tier"]) for r in found.collect()} == {"FO_12_A": ("FO", 2), "FO_1": ("FO_1", 0), "FO1": ("FO_1", 1), "GM-3b": ("GM_3", 2), "": (None, None), "Z": (None, None), None: (None, None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "(part#" in plan and "substring" not in plan.split("Join Inner")[1].split("\n")[0]


def test_sides_and_seconds(spark):
    rows = spark.createDataFrame([("FO_01_KT_70F", "1500"), ("FO_02_KT_71F", "1000"), ("x", "12.5"), (None, "x"), ("NR_13", None)], "signer string, t string")
    got = rows.select(space.infer_side(F.col("signer")).alias("a"), space.infer_side(F.col("signer"), overrides={"": "left", "FO": "left", "KT": "right"}).alias("b"), space.infer_side(F.col("signer"), "left").alias("c"), space.to_seconds(F.col("t")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("right", "left", "left", 1.5), ("left", "left", "left", 1000.0), ("left", "left", "left", 12.5), ("left", "left", "left", None), ("right", "right", "left", None)]


def test_file_list_keeps_its_order(spark, tmp_path):
    (tmp_path / "list.txt").write_text("\ufeff# comment\nFO_02.eaf\n\nFO_01_PARSED.csv\nfo-02\nfo_01\n...\n", encoding="utf-8")
    assert [(r["stem"], r["line"]) for r in files.read_file_list(spark, str(tmp_path / "list.txt")).collect()] == [("FO02", "FO_02.eaf"), ("FO01", "FO_01_PARSED.csv")]
