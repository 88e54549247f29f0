import numpy as np
from pyspark.sql import functions as F

from tierloom.operators import audit, geometry, space
from tierloom.sources.landmarks import load_signers, read_landmarks


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_rules(spark):
    tiers = spark.createDataFrame([("FO_01-02_Ani", "FO01"), ("FO_01-02_Ani", "FO_3"), ("other", "x")], "recording string, signer string")
    assert rows(audit.outside_pair(tiers)) == [("FO_01-02_Ani", "FO_3", "FO_01", "FO_02")]
    named = spark.createDataFrame([("d", "FO01-Word-jp", "FO_1"), ("d", "FO01-Word-jp", "FO_2"), ("d", "FO01-Word-jp", "FO01"), ("d", "FO01-Word-jp", None)], "doc string, tier_id string, participant string")
    assert [r[3] for r in rows(audit.name_against_attribute(named))] == ["same signer", "different signer"]
    people = spark.createDataFrame([("FO1", 30, "m"), ("FO2", None, "f"), ("FO3", 40, "f"), ("FO9", 1, "f")], "signer string, age int, gender string")
    roster = spark.createDataFrame([("FO_01", 30, "male"), ("FO_02", 20, "f"), ("FO_03", 41, "f")], "signer string, age int, gender string")
    assert {r["signer"]: r["problem"] for r in audit.against_roster(people, roster).collect()} == {"FO2": "missing", "FO3": "contradicts", "FO9": "not in roster"}


def test_todo_tiers_and_videos(spark):
    found = spark.createDataFrame([(2, "s", "t", "b", "late", "x"), (1, "s", "t", "a", "early", "y"), (3, "s", "u", "a", "p", "z")], "rank int, signer string, tier_id string, doc string, problem string, detail string")
    assert rows(audit.to_do(found)) == [("s", "t", 1, "early", "x", "a;b"), ("s", "u", 3, "p", "z", "a")]
    lines = spark.createDataFrame([(1, "d", "t1", "x"), (2, "d", "no", "fo1"), (3, "d", "no", "zz"), (4, "d", "no", None)], "row_id long, doc string, tier_id string, speaker_id string")
    tiers = spark.createDataFrame([("d", "t1", "p"), ("d", "FO1-long-id", "FO1"), ("d", "FO1-a", "FO12")], "doc string, tier_id string, participant string")
    assert rows(audit.resolve_tiers(lines, tiers)) == [(1, "t1", "tier"), (2, "FO1-long-id", "speaker"), (3, None, None), (4, None, None)]
    files = spark.createDataFrame([("/v/FO_01.mov",), ("/v/fo_01_task.MP4",), ("/v/x.txt",)], "path string")
    names = spark.createDataFrame([("FO_01_Task",), ("FO_01_Other",), ("NR_1",)], "name string")
    assert rows(audit.find_video(names, files)) == [("FO_01_Other", "/v/FO_01.mov"), ("FO_01_Task", "/v/fo_01_task.MP4"), ("NR_1", None)]
    sheet = spark.createDataFrame([(1, "Nara", "", None, None), (2, "", "1-2", "a", 30), (3, "", "", "b", None), (4, "", "3-4", "c", None)], "n int, prefecture string, pair string, signer string, age int").withColumn("gender", F.lit(""))
    assert [(r["prefecture"], r["pair"], r["signer"], r["age"]) for r in audit.latest_roster(sheet).orderBy("n").collect()] == [("Nara", "1-2", "a", 30), ("Nara", "1-2", "b", 30), ("Nara", "3-4", "c", None)]


def test_landmarks_to_region_counts(spark, tmp_path):
    pose = np.array([[[0.6, 0.5, 1.0], [0.4, 0.5, 1.0]], [[0.6, 0.5, 0.1], [0.4, 0.5, 1.0]]])
    face = np.array([[[0.5, 0.44], [0.5, 0.3]]] * 2)
    left = np.array([[[0.5, 0.55], [0.5, 0.55]]] * 2)
    right = np.array([[[0.35, 0.55], [np.nan, 0.5]]] * 2)
    np.savez(tmp_path / "clip1.npz", pose_xyv=pose, face_xy=face, left_hand_xy=left, right_hand_xy=right)
    frames = read_landmarks(spark, str(tmp_path)).withColumns({"handedness": F.lit("left"), "yaw": F.lit(0.0)})
    assert frames.count() == 2
    counts = geometry.region_counts(frames)
    unseen = [("clip1", 0, "non_dominant", "missing", 0), ("clip1", 1, "dominant", "missing", 0), ("clip1", 1, "non_dominant", "missing", 0)]
    assert rows(counts) == sorted([("clip1", 0, "dominant", "upper_torso", 2), *unseen])
    clips = space.clip_table(counts.withColumns({"keyword": F.lit("k"), "region_code": F.lit("r"), "signer_id": F.lit("s")}))
    assert sorted((r["hand_role"], r["total_points"], r["regions_used"], r["hand_present"]) for r in clips.collect()) == [("dominant", 2, 1, True), ("non_dominant", 0, 0, False)]
    roster = spark.createDataFrame([("FO_1", "L", "30", "女"), ("#x", "", "", ""), ("FO_2", "", "x", "M")], "Signer string, Handedness string, Age string, Sex string")
    assert rows(load_signers(roster)) == [("FO_1", "left", 30.0, "female"), ("FO_2", "right", None, "male")]


def test_equal_findings_are_told_by_the_first(spark):
    rows = [(n, 1, "A", "t", "d", "100000", str(100 - n)) for n in range(20)]
    for some in (rows, rows[::-1], rows[7:] + rows[:7]):
        findings = spark.createDataFrame(some, "n long, rank long, signer string, tier_id string, doc string, problem string, detail string").repartition(3)
        assert [tuple(r) for r in audit.to_do(findings).collect()] == [("A", "t", 1, "100000", "100", "d")]
