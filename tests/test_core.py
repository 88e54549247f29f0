"""Reference operators against SQL, NumPy and worked examples."""

import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierloom.functions import gloss_parser as gp
from tierloom.functions import text as tx
from tierloom.operators import corpus, geometry, intervals, relations, series, space
from tierloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER)
    rows = got.collect()
    assert rows or name in ("effect_spread", "disagreement_detail", "bootstrap_difference", "gloss_statistics_for_regions")
    if name not in registry.ORACLE_SQL:
        return
    want = duck.sql(registry.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in rows) == sorted([plain(r[i]) for i in at] for r in want.fetchall())


GOLDEN = [
    ("pt2", {"pt": "2", "lexical_item": "pt2"}),
    ("PT1＝歯", {"pt": "1", "lexical_item": "pt1"}),
    ("PT(アニメ)", {"pt": "0", "lexical_item": "pt"}),
    ("狙う(pt)", {"pt": "0", "lexical_item": "pt"}),
    ("pt3(dw:5種類)", {"pt": "3", "dw": "5種類", "lexical_item": "pt3;5種類"}),
    ("cl:猫の形(fal)", {"fal": "TRUE"}),
    ("両手:pt3", {"lexical_item": "pt3", "pt": "3", "lh": "pt3", "rh": "pt3"}),
    ("L:娘R:娘", {"lh": "娘", "rh": "娘", "lexical_item": "娘"}),
    ("食べる PAST", {"past": "TRUE", "lexical_item": "食べる"}),
    ("そうだ(rep)", {"rep": "そうだ(1;N)", "lexical_item": "そうだ"}),
    ("美味しい(右手ver)", {"rh": "美味しい", "lexical_item": "美味しい"}),
    ("UN(FAL)", {"fal": "TRUE", "un": "TRUE"}),
    ("a/b/c", {"ambiguous": "a/b/c"}),
    ("abc", {"ambiguous": "abc"}),
    ("<家", {"compound": "<家"}),
    ("", {}),
]


@pytest.mark.parametrize(("gloss", "want"), GOLDEN)
def test_parser_examples(gloss, want):
    got = {k: v for k, v in gp.parse_gloss(gloss).items() if v and k != "annotation"}
    assert got == want or (not gloss and not got)


def test_parser_rules_are_arguments(spark):
    rules = gp.Rules(unknown=("zz",), exceptions=frozenset({gp.Rules.key("ABC")}))
    assert gp.parse_gloss("abc", rules)["lexical_item"] == "abc" and gp.parse_gloss("ZZ猫", rules)["ambiguous"] == "ZZ猫"
    rows = spark.createDataFrame([(1, 1, "<家"), (1, 2, "猫"), (1, 3, "裏>"), (1, 4, None), (1, 5, "犬"), (2, 1, "pt")], "doc long, n long, annotation string")
    got = {(r["doc"], r["n"]): (r["lexical_item"], r["compound"]) for r in gp.parse_rows(rows, "doc", ["n"], rules).collect()}
    assert got == {(1, 1): ("", "<家"), (1, 2): ("", "猫"), (1, 3): ("", "裏>"), (1, 5): ("犬", ""), (2, 1): ("pt", "")}


def brute_groups(rows):
    out, inside = [], False
    for opens, closes in rows:
        out.append(inside or opens)
        inside = not closes if inside else opens
    return out


def test_compound_groups_equal_the_automaton(spark):
    r = np.random.default_rng(1)
    rows = [(d, i, bool(r.integers(0, 2)), bool(r.integers(0, 2))) for d in range(30) for i in range(r.integers(1, 25))]
    frame = spark.createDataFrame(rows, "doc long, i long, opens boolean, closes boolean")
    got = {(x["doc"], x["i"]): x["in_compound"] for x in series.compound_groups(frame, "doc", ["i"]).collect()}
    for d in range(30):
        own = [x for x in rows if x[0] == d]
        assert [got[(d, x[1])] for x in own] == brute_groups([(x[2], x[3]) for x in own])


def test_filters_equal_numpy(spark):
    v = np.random.default_rng(2).normal(size=40)
    frame = spark.createDataFrame([(v.tolist(),)], "values array<double>")
    med, avg = frame.select(series.median_filter(F.col("values")), series.moving_average(F.col("values"))).first()
    pad = lambda k: np.lib.stride_tricks.sliding_window_view(np.pad(v, k // 2, mode="edge"), k)
    assert np.allclose(med, np.median(pad(7), axis=1)) and np.allclose(avg, pad(15).mean(axis=1))


def test_gaps(spark):
    values = [None, 1.0, None, None, 4.0, None]
    frame = spark.createDataFrame([(1, i, x) for i, x in enumerate(values)], "clip_id long, frame long, value double")
    got = [(r["filled"], r["source"]) for r in series.fill_gaps(frame, 1, True).orderBy("frame").collect()]
    assert got == [(1.0, "nearest"), (1.0, "observed"), (None, "missing"), (None, "missing"), (4.0, "observed"), (4.0, "nearest")]
    assert [r["filled"] for r in series.fill_gaps(frame, 2).orderBy("frame").collect()] == [None, 1.0, 2.0, 3.0, 4.0, None]


def test_bootstrap_equals_pooled_resampling():
    r = np.random.default_rng(3)
    clips = {s: r.normal(size=r.integers(1, 6)) for s in range(7)}
    sums, counts = np.array([c.sum() for c in clips.values()]), np.array([len(c) for c in clips.values()])
    rng, names = np.random.default_rng(11), np.array(list(clips))
    means = [np.concatenate([clips[s] for s in rng.choice(names, size=7, replace=True)]).mean() for _ in range(300)]
    assert np.allclose(space.bootstrap_mean(sums, counts, 300, seed=11), np.percentile(means, [2.5, 97.5]))
    assert all(math.isnan(x) for x in space.bootstrap_mean(sums[:1], counts[:1]))


def test_points_and_lines(spark):
    pts = spark.createDataFrame([(0.0, 0.0), (0.7, 0.3), (-0.7, 0.3), (9.0, 0.1), (float("nan"), 0.0), (None, 1.0), (0.0, -3.0), (0.5, 0.8)], "x double, y double")
    lines = geometry.reference_lines(F.lit(0.5), F.lit(-0.5), F.lit(None).cast("double"), F.lit(float("nan")))
    got = [r["r"] for r in pts.select(geometry.classify_point(F.col("x"), F.col("y"), lines).alias("r")).collect()]
    assert got == ["upper_torso", "p_left_upper_torso", "p_right_upper_torso", "ep_left_upper_torso", "missing", "missing", "ep_upper_center", "upper_torso"]


def test_overlaps_are_complete(spark):
    r = np.random.default_rng(5)
    rows = [(i, int(r.integers(0, 3)), int(s), int(s + r.integers(0, 900))) for i, s in enumerate(r.integers(0, 5000, 120))]
    left = spark.createDataFrame(rows, "l_id long, l_file long, l_start long, l_end long")
    right = left.toDF("r_id", "r_file", "r_start", "r_end")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and min(a[3], b[3]) - max(a[2], b[2]) >= 1)
    for width in (50, 700, 100_000):
        assert sorted((x["l_id"], x["r_id"]) for x in intervals.overlapping(left, right, bin_ms=width).collect()) == want


def test_prefix_sums_equal_a_sort(spark):
    r = np.random.default_rng(6)
    rows = [(f"k{i:03d}", int(r.integers(1, 5))) for i in range(200)]
    frame = spark.createDataFrame(rows, "k string, n long")
    for down in (True, False):
        order = sorted(rows, key=lambda x: (-x[1] if down else x[1], x[0]))
        got = {x["k"]: (x["rank"], x["before"]) for x in corpus.ordered_prefix(frame, "n", "k", down).collect()}
        total = 0
        for i, (k, n) in enumerate(order, 1):
            assert got[k] == (i, total)
            total += n


def test_flags_on_blank_and_missing_columns(spark):
    frame = spark.createDataFrame([("a", "nan", None), (" ", "1", None), (None, None, "x")], "lexical_item string, pt string, compound string")
    got = [(r["has_lexical"], r["n_keys"], r["is_parsed"], r["lexical_only"], r["key_only"]) for r in corpus.add_flags(frame).collect()]
    assert got == [(True, 0, True, True, False), (False, 1, True, False, True), (False, 0, False, False, False)]
    assert corpus.summary(corpus.add_flags(frame.selectExpr("*", "'f' source_file", "'s' speaker_id", "'r' region_code", "'t' annotation")).limit(0)).count() <= 1


def test_circles_have_no_times(spark):
    rows = [(1, "a", None, 1.0, 2.0), (1, "b", "a", None, None), (1, "c", "b", None, None), (1, "x", "y", None, None), (1, "y", "x", None, None), (1, "z", "none", None, None)]
    got = {r["id"]: r["start_ms"] for r in relations.inherited_times(spark.createDataFrame(rows, "doc long, id string, ref string, start_ms double, end_ms double")).collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 1.0, "x": None, "y": None, "z": None}


def test_signer_matching(spark):
    names = spark.createDataFrame([("FO_12_A",), ("FO_1",), ("fo01",), ("FO_123",), ("",)], "name string")
    roster = spark.createDataFrame([("FO_1",), ("FO_12",)], "signer_id string")
    got = {r["name"]: r["signer_id"] for r in relations.match_signers(names, roster).collect()}
    assert got == {"FO_12_A": "FO_12", "FO_1": "FO_1", "fo01": "FO_1", "FO_123": None, "": None}


def test_bracket_split(spark):
    frame = spark.createDataFrame([("a+(b+c)+d",), ("a)+b",), ("",), ("(a+b",)], "s string")
    assert [r["p"] for r in frame.select(tx.split_outside_brackets(F.col("s"), "+").alias("p")).collect()] == [["a", "(b+c)", "d"], ["a)", "b"], [], ["(a+b"]]
    assert [gp.outside_brackets(s, "+") for s in ("a+(b+c)+d", "a)+b")] == [["a", "(b+c)", "d"], ["a)", "b"]]


def test_entry_works_without_the_corpus_part(tmp_path):
    code = "import sys\nclass Block:\n    def find_spec(self, name, path=None, target=None):\n        if name == 'corpus_pipeline' or name.startswith('tierloom.llm'):\n            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, Block())\nimport __spark_entry__ as e\nq = e.queries()\nassert 'top_glosses' in q and not any(k.startswith('op') or k == 'pipeline' for k in q), q\nassert set(e.oracle_sql()) <= set(q)\n"
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
