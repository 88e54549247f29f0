"""The audit's rules on cases made for each, and the list that follows from them."""

from tierloom.operators import rules

TIERS = [
    ("FO_01-02_Ani", "/a/FO_01-02_Ani.eaf", "FO_01_KT_40F-Word-jp", "FO_01_KT_40F", 3),
    ("FO_01-02_Ani", "/a/FO_01-02_Ani.eaf", "FO_01-Word-jp", "", 1),
    ("FO_01-02_Ani", "/a/FO_01-02_Ani.eaf", "FO_02_XY_50M-Word-jp", "FO_03", 1),
    ("FO_01-02_Ani", "/a/FO_01-02_Ani.eaf", "FO_02_XY_50M-Word-jp-roman", "someone", 9),
    ("FO_01-02_Ani", "/a/FO_01-02_Ani.eaf", "FO_02_XY_50M-GS-en", "x", 9),
    ("FO_01-02_Ani", "/old/FO_01-02_Ani.eaf", "FO_07_ZZ_30F-Word-jp-2", None, 4),
    ("FO_01-02_Ani", "/old/FO_01-02_Ani.eaf", "FO_07_ZZ_30F-Word-jp", None, 0),
    ("memo", "/m.eaf", "-Word-jp", "NR_1_60M", None),
    ("memo", "/m.eaf", None, None, 1),
    (None, None, "Word-jp", None, 1),
]
SHEET = [("FO_01", "40", "M"), ("FO_02", "60", "M"), ("NR_01", "", "")]
TIER, ROSTER = "recording string, path string, tier_id string, participant string, n long", "signer string, age string, gender string"


def found(spark, tiers=TIERS):
    return sorted((r["problem"], r["path"], r["signer"], r["detail"], r["tiers"]) for r in rules.findings(spark.createDataFrame(tiers, TIER), spark.createDataFrame(SHEET, ROSTER)).collect())


def test_every_rule(spark):
    new, old, memo = "/a/FO_01-02_Ani.eaf", "/old/FO_01-02_Ani.eaf", "/m.eaf"
    assert found(spark) == sorted([
        (rules.SEVERAL_PLACES, new, "", "2 copies", ""), (rules.SEVERAL_PLACES, old, "", "2 copies", ""),
        (rules.VARIANTS, old, "", "-2=4", ""),
        (rules.SEVERAL_LABELS, new, "FO_01", "1 of 2: FO_01", "FO_01-Word-jp"), (rules.SEVERAL_LABELS, new, "FO_01", "2 of 2: FO_01_KT_40F", "FO_01_KT_40F-Word-jp"),
        (rules.SPELLINGS, new, "FO_01", "FO_01 / FO_01_KT_40F", "FO_01-Word-jp FO_01_KT_40F-Word-jp"),
        (rules.OTHER_RECORDING, old, "FO_07", "this recording is FO_01 and FO_02", "FO_07_ZZ_30F-Word-jp FO_07_ZZ_30F-Word-jp-2"),
        (rules.DISAGREE + " (different signer)", new, "FO_02", "name says FO_02_XY_50M, PARTICIPANT says FO_03", "FO_02_XY_50M-Word-jp"),
        (rules.NOT_IN_SHEET, old, "FO_07", "FO_07_ZZ_30F", "FO_07_ZZ_30F-Word-jp FO_07_ZZ_30F-Word-jp-2"),
        (rules.AGE, new, "FO_02", "FO_02_XY_50M says 50, sheet says 60", "FO_02_XY_50M-Word-jp"),
        (rules.GENDER, new, "FO_01", "FO_01_KT_40F says F, sheet says M", "FO_01_KT_40F-Word-jp"),
    ])
    assert not any(path == memo for _, path, *_ in found(spark))


def test_repeated_rows_and_empty_tables(spark):
    doubled = found(spark, TIERS + TIERS)
    assert [x[:3] for x in doubled] == [x[:3] for x in found(spark)] and (rules.VARIANTS, "/old/FO_01-02_Ani.eaf", "", "-2=8", "") in doubled
    assert found(spark, []) == []


def test_to_do_list(spark):
    tiers, roster = spark.createDataFrame(TIERS, TIER), spark.createDataFrame(SHEET, ROSTER)
    unread = rules.unread_files(tiers)
    assert [tuple(r) for r in unread.collect()] == [("FO_01-02_Ani", "/old/FO_01-02_Ani.eaf", "-2", 4)]
    selected = spark.createDataFrame([("FO_01-02_Ani",)], "recording string")
    rows = rules.to_do_order(rules.to_do_list(rules.findings(tiers, roster), unread, roster, selected)).collect()
    got = [(r["rank"], r["signer"], r["tier"], r["problem"], r["spreadsheet"], r["in_selection"]) for r in rows]
    told = "this recording is FO_01 and FO_02"
    assert got == [
        (1, "FO_07", "FO_07_ZZ_30F-Word-jp", told, "not in spreadsheet", "yes"), (1, "FO_07", "FO_07_ZZ_30F-Word-jp-2", told, "not in spreadsheet", "yes"),
        (2, "FO_01 and FO_02", "all Word-jp tiers are empty", "gloss is on -2 instead; 4 annotations unread", "", "yes"),
        (3, "FO_01", "FO_01-Word-jp", "FO_01 / FO_01_KT_40F", "age 40, M", "yes"), (3, "FO_01", "FO_01_KT_40F-Word-jp", "FO_01 / FO_01_KT_40F", "age 40, M", "yes"),
        (5, "FO_01", "1 tier(s): FO_01_KT_40F-Word-jp", "FO_01_KT_40F says F, sheet says M", "age 40, M", "yes"),
        (6, "FO_02", "1 tier(s): FO_02_XY_50M-Word-jp", "FO_02_XY_50M says 50, sheet says 60", "age 60, M", "yes"),
    ]
    assert all(r["action"] == rules.ACTIONS[r["category"]] for r in rows)
    totals = {r["problem"]: (r["n_findings"], r["n_signers"], r["n_documents"]) for r in rules.problem_totals(rules.findings(tiers, roster)).collect()}
    assert totals[rules.SEVERAL_LABELS] == (2, 1, 1) and totals[rules.SEVERAL_PLACES] == (2, 0, 2)


def test_one_scan(spark, tmp_path):
    spark.createDataFrame(TIERS, TIER).write.parquet(str(tmp_path / "t"))
    plan = rules.findings(spark.read.parquet(str(tmp_path / "t")), spark.createDataFrame(SHEET, ROSTER))
    assert "Scan parquet" not in plan._jdf.queryExecution().executedPlan().toString()  # what remains reads the labels alone
    assert plan.count() == 11


def test_long_lists_of_recordings_are_not_carried_through_joins(spark, tmp_path):
    """Whether a signer's recordings are in use is known before they are listed: one list a row, none for each member."""
    people = [("FO_01-02_%d" % i, "/%d.eaf" % i, "FO_02", "FO_02_XY_50M says 50, sheet says 60", "FO_02_XY_50M-Word-jp", rules.AGE) for i in range(30)]
    found = spark.createDataFrame(people, "recording string, path string, signer string, detail string, tiers string, problem string")
    unread, roster = spark.createDataFrame([], "recording string, path string, variants string, unread long"), spark.createDataFrame(SHEET, ROSTER)
    for used, said in (("FO_01-02_29", "yes"), ("FO_01-02_30", "no")):
        rows = rules.to_do_list(found, unread, roster, spark.createDataFrame([(used,)], "recording string"))
        assert [(r["recording"].count(", "), r["in_selection"]) for r in rows.collect()] == [(29, said)]
        assert "explode(split(recording" not in rows._jdf.queryExecution().optimizedPlan().toString()
