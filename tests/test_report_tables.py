"""The report's tables on a few cells."""

from tierloom.operators import report_tables as rt
from tierloom.sources.files import latex_table

CELL = "region_code string, keyword string, hand_role string, avg_regions double, ci_low double, ci_high double, n_annotations long, n_signers long"


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_regions_by_role(spark):
    cells = spark.createDataFrame([("FO", "CL", "dominant", 2.0, 1.5, 2.5, 9, 4), ("FO", "CL", "non_dominant", 1.0, 0.5, 1.5, 3, 2), ("NR", "CL", "dominant", 3.0, None, None, 1, 1), ("NR", "FS", "non_dominant", 1.0, 1.0, 1.0, 1, 1)], CELL)
    got = rt.region_table(cells)
    assert rows(got) == [("FO", "CL", 9, 4, 2.0, 1.5, 2.5, 1.0, 0.5, 1.5), ("NR", "CL", 1, 1, 3.0, None, None, None, None, None)]
    assert latex_table(got.orderBy("region_code"), "Regions").count(r"\\") == 3
    assert rows(rt.region_table(cells.limit(0))) == []


def test_levels_below_each_other(spark):
    one = spark.createDataFrame([("<50", "CL", "dominant", 1.0, 0.0, 2.0, 5, 3), ("<50", "CL", "non_dominant", 9.0, 0.0, 2.0, 5, 3)], CELL.replace("region_code", "age_band"))
    two = spark.createDataFrame([("female", "CL", "dominant", 4.0, 0.0, 2.0, 6, 3)], CELL.replace("region_code", "gender"))
    assert rows(rt.levels_table([("age_band", one), ("gender", two)])) == [(0, "age_band", "<50", "CL", 5, 3, 1.0, 0.0, 2.0), (1, "gender", "female", "CL", 6, 3, 4.0, 0.0, 2.0)]


def test_central_shares_weigh_by_clips(spark):
    cells = spark.createDataFrame([("CL", "dominant", 50.0, 1), ("CL", "dominant", 80.0, 3), ("CL", "dominant", None, 7), ("CL", "non_dominant", 10.0, 0)], "keyword string, hand_role string, central_percent double, n_clips long")
    assert rows(rt.central_table(cells, ["central_percent"])) == [("CL", 72.5, None)]


def test_separation_and_spread(spark):
    schema = "group string, hand_role string, compared_within string, level_a string, level_b string, n_signers_a long, n_signers_b long, difference double, separates boolean"
    many = rt.STABLE_SIGNERS
    pairs = [("gender", "dominant", "CL", "f", "m", many, many, -0.5, True), ("gender", "dominant", "FS", "f", "m", many, many, 0.5, True), ("gender", "dominant", "LEX", "f", "m", many, many, 0.1, False), ("gender", "dominant", "X", "f", "m", 1, many, 9.0, True), ("gender", "non_dominant", "Y", "f", "m", many, many, 8.0, True), ("age_band", "dominant", "CL", "a", "b", many, many, None, None)]
    assert rows(rt.separation_table(spark.createDataFrame(pairs, schema))) == [("gender", 2, 3, 0.5, "f", "m", "CL", True)]
    spread = spark.createDataFrame([("keyword", "dominant", "FO", 1.0), ("keyword", "dominant", "NR", 2.0), ("gender", "dominant", "CL", 0.3), ("gender", "non_dominant", "FS", 0.4)], "group string, hand_role string, compared_within string, spread double")
    assert rows(rt.spread_table(spread, ["CL", "FS"])) == [("gender", None, 0.3, None), ("keyword", 1.5, None, None)]
    groups = spark.createDataFrame([("gender",), ("other",), ("keyword",)], "g string")
    assert [r["g"] for r in groups.orderBy(rt.page_order(groups["g"])).collect()] == ["keyword", "gender", "other"]
