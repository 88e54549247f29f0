import pytest
from pyspark.sql import functions as F

from tierloom.operators import selection
from tierloom.sources import documents as dx
from tierloom.sources import files as fx
from tierloom.streaming.resume import process_new_files

EAF = """<ANNOTATION_DOCUMENT><TIME_ORDER><TIME_SLOT TIME_SLOT_ID="ts1" TIME_VALUE="100"/><TIME_SLOT TIME_SLOT_ID="ts2" TIME_VALUE="900"/><TIME_SLOT TIME_SLOT_ID="ts3"/></TIME_ORDER>
<TIER TIER_ID="FO01-Word-jp" PARTICIPANT="FO01" LINGUISTIC_TYPE_REF="w"><ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a1" TIME_SLOT_REF1="ts1" TIME_SLOT_REF2="ts2"><ANNOTATION_VALUE> 猫 </ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION>
<ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a2" TIME_SLOT_REF1="ts2" TIME_SLOT_REF2="ts3"><ANNOTATION_VALUE>犬</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION></TIER>
<TIER TIER_ID="FO01-Word-jp-T" PARTICIPANT="FO01" LINGUISTIC_TYPE_REF="w"/>
<TIER TIER_ID="FO01-MouthAction" PARTICIPANT="FO01" LINGUISTIC_TYPE_REF="m" PARENT_REF="FO01-Word-jp"><ANNOTATION><REF_ANNOTATION ANNOTATION_ID="a3" ANNOTATION_REF="a1"><ANNOTATION_VALUE>Mouthing</ANNOTATION_VALUE></REF_ANNOTATION></ANNOTATION></TIER>
<TIER TIER_ID="below" LINGUISTIC_TYPE_REF="x" PARENT_REF="FO01-MouthAction"><ANNOTATION><REF_ANNOTATION ANNOTATION_ID="a4" ANNOTATION_REF="a3"><ANNOTATION_VALUE>v</ANNOTATION_VALUE></REF_ANNOTATION></ANNOTATION>
<ANNOTATION><REF_ANNOTATION ANNOTATION_ID="a5" ANNOTATION_REF="a6"><ANNOTATION_VALUE>v</ANNOTATION_VALUE></REF_ANNOTATION></ANNOTATION><ANNOTATION><REF_ANNOTATION ANNOTATION_ID="a6" ANNOTATION_REF="a5"><ANNOTATION_VALUE>v</ANNOTATION_VALUE></REF_ANNOTATION></ANNOTATION></TIER>
<LINGUISTIC_TYPE LINGUISTIC_TYPE_ID="w"/></ANNOTATION_DOCUMENT>"""


def test_documents(spark, tmp_path):
    (tmp_path / "FO_01_Task.eaf").write_text(EAF, encoding="utf-8")
    (tmp_path / "NR_02_Task.eaf").write_text("<ANNOTATION_DOCUMENT><TIER", encoding="utf-8")
    docs = dx.read_documents(spark, str(tmp_path))
    a = {r["id"]: (r["start_ms"], r["end_ms"]) for r in dx.annotations(docs).collect()}
    assert a["a1"] == a["a3"] == a["a4"] == (100.0, 900.0) and a["a2"] == (None, None) and a["a5"] == a["a6"] == (None, None)
    assert [tuple(r) for r in dx.word_annotations(docs).collect()] == [("FO_01_Task", "FO01-Word-jp", "100", "900", "猫"), ("FO_01_Task", "FO01-Word-jp", "900", "", "犬")]
    (row,) = dx.index(docs).where("doc LIKE 'FO%'").collect()
    assert (row["duration_ms"], row["n_tiers"], row["n_mouth_tiers"], row["n_mouth_annotations"], row["n_word_annotations"], row["region_code"], row["file_key"]) == (900.0, 4, 2, 4, 2, "FO", "fo01task")
    cells = spark.createDataFrame([("FO_01_Task.eaf", "a1", "lexical_item", "猫"), ("FO_01_Task.eaf", "a9", "pt", "1")], "doc string, parent string, column string, cell string")
    out = tmp_path / "out"
    out.mkdir()
    for r in dx.enriched(spark, str(tmp_path / "FO*.eaf"), cells).collect():
        (out / r["doc"]).write_text(r["content"], encoding="utf-8")
    again = dx.annotations(dx.read_documents(spark, str(out)))
    assert again.where("tier_id = 'FO01-Word-jp_lexical_item'").select("value", "start_ms").collect() == [("猫", 100.0)]


def test_tier_tests(spark):
    f = spark.createDataFrame([("FO-Word-jp",), ("FO-Word_jp-T",), ("x-ma-1",), ("mama",)], "t string")
    got = f.select(dx.is_word_tier(F.col("t")).alias("w"), dx.is_word_variant(F.col("t")).alias("v"), dx.mentions([F.col("t")], dx.MOUTH_HINTS).alias("m")).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (False, True, False), (False, False, True), (False, False, False)]
    kinds = spark.createDataFrame([("Mouthing",), ("MouthGesture",), ("else",), (" ",), (None,)], "v string").select(dx.classify_mouth(F.col("v")).alias("k")).collect()
    assert [r["k"] for r in kinds] == ["Mouthing", "MouthGesture", "Others", None, None]


def test_lists_and_tables(spark, tmp_path):
    (tmp_path / "list.txt").write_bytes("﻿FO_01\n# no\n\nGM_02 # note\n".encode())
    assert [r["line"] for r in fx.read_text_list(spark, str(tmp_path / "list.txt"), True).collect()] == ["FO_01", "GM_02"]
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "FO_01_parsed.csv").write_bytes("﻿annotation,pt,speaker_id\n\"a\nb\",1,x\n".encode())
    (folder / "NR_02_parsed.csv").write_bytes("annotation,pt\n猫,\n".encode("cp932"))
    (folder / "tab_x.csv").write_text("annotation\nz\n")
    got = {r["source_file"]: r for r in fx.load_parsed(spark, str(folder)).collect()}
    assert set(got) == {"FO_01_parsed.csv", "NR_02_parsed.csv"} and got["FO_01_parsed.csv"]["annotation"] == "a\nb" and got["NR_02_parsed.csv"]["annotation"] == "猫" and got["NR_02_parsed.csv"]["neg"] == ""
    for name in ("a/FO_01.eaf", "b/FO_01.EAF", "b/GM_02.eaf.001", "old1/GM_03.eaf"):
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    tree = str(tmp_path / "tree")
    assert fx.list_files(spark, tree).count() == 3 and fx.list_versions(spark, tree).count() == 3
    wanted = spark.createDataFrame([("FO_01_parsed.csv",), ("ZZ_9",)], "line string")
    chosen = fx.select_documents(fx.list_files(spark, tree), wanted)
    assert [r["stem"] for r in chosen["files"].collect()] == ["FO01"] and [r["stem"] for r in chosen["missing"].collect()] == ["ZZ9"] and chosen["duplicates"].count() == 1
    frame = spark.createDataFrame([("a_b", 1234, 0.5, True)], "s string, n long, x double, b boolean")
    assert r"a\_b & 1,234 & 0.50 & yes \\" in fx.latex_table(frame, "t")
    odd = spark.createDataFrame([("", "v")], "`Speaker ID` string, name string")
    assert odd.select(fx.first_existing(odd, "speaker_id", "name").alias("v")).first()["v"] == "v"


def test_resume(spark, tmp_path):
    src = tmp_path / "in"
    spark.range(3).write.parquet(str(src))
    run = lambda: process_new_files(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"), lambda d: d.where("id > 0"), "id long")
    run()
    run()
    spark.range(5, 7).write.mode("append").parquet(str(src))
    run()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 5, 6]


def test_documents_that_break_references_are_told_and_not_written_on(spark, tmp_path):
    (tmp_path / "FO_01.eaf").write_text(EAF.replace('PARENT_REF="FO01-MouthAction"', 'PARENT_REF="gone"').replace('ANNOTATION_REF="a3"', 'ANNOTATION_REF="a99"'), encoding="utf-8")
    found = {(r["tier_id"], r["id"], r["missing"]) for r in dx.broken(dx.read_documents(spark, str(tmp_path))).collect()}
    assert found == {("below", "a4", "a99"), ("below", None, "gone")}
    with pytest.raises(ValueError):
        dx.add_tiers((tmp_path / "FO_01.eaf").read_bytes(), [])
    twice = dx.add_tiers(dx.add_tiers(EAF.encode(), [{"parent": "a1", "column": "pt", "cell": "1"}]).encode(), [{"parent": "a1", "column": "pt", "cell": "2"}])
    assert 'TIER_ID="FO01-Word-jp_pt"' in twice and 'TIER_ID="FO01-Word-jp_pt_2"' in twice and twice.index("<TIER ") < twice.index("<LINGUISTIC_TYPE ")


def test_only_flagged_documents_are_read(spark, tmp_path):
    for name in ("A_1.eaf", "B_2.eaf"):
        (tmp_path / name).write_text(EAF, encoding="utf-8")
    index = spark.createDataFrame([(f"{tmp_path}/A_1.eaf", "True"), (f"{tmp_path}/B_2.eaf", "no")], "path string, has_mouth_tiers string")
    assert [r["doc"] for r in dx.flagged_documents(spark, index).collect()] == ["A_1.eaf"]
    assert not dx.flagged_documents(spark, index.limit(0)).count()


def test_manifests_reports_and_unreadable_tables(spark, tmp_path):
    files = spark.createDataFrame([("x/01_Fukuoka/anin/FO_01.eaf",), ("x/FO_02.eaf",)], "path string")
    fx.write_manifest(selection.manifest(files), str(tmp_path / "m"))
    (part,) = (tmp_path / "m").glob("*.csv")
    assert part.read_text().splitlines() == ["stem,region_code,path,in_task_folder", "FO_01,FO,x/01_Fukuoka/anin/FO_01.eaf,yes", "FO_02,FO,x/FO_02.eaf,no"]
    entries = fx.read_manifest(spark, str(part))
    found, missing = selection.listed(entries, files.limit(1))
    assert [r["path"] for r in found.collect()] == ["x/01_Fukuoka/anin/FO_01.eaf"] and [r["path"] for r in missing.collect()] == ["x/FO_02.eaf"]
    (tmp_path / "list.txt").write_text("a.eaf # note\n\n# no\nb.eaf\n")
    assert sorted(r["path"] for r in fx.read_manifest(spark, str(tmp_path / "list.txt")).collect()) == ["a.eaf", "b.eaf"]
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "bad.csv").write_bytes(b"annotation\n\x81\x01\n")
    (folder / "good.csv").write_text("annotation\nz\n")
    assert [r["source_file"] for r in fx.unreadable_csv(spark, str(folder)).collect()] == ["bad.csv"] and fx.read_csv(spark, str(folder)).count() == 1
    with pytest.raises(ValueError):
        fx.read_manifest(spark, str(folder / "good.csv"))
    with pytest.raises(ValueError):
        fx.latex_table(spark.range(5), "x", limit=4)
    report = spark.createDataFrame([("d", i, i % 2 == 0, f"a{i}") for i in range(9)], "doc string, n long, matched boolean, annotation string")
    fx.write_tier_report(report, str(tmp_path / "report"), most=3)
    (text,) = (tmp_path / "report" / "doc=d").glob("*.txt")
    assert text.read_text().splitlines() == ["d", "matched: 5", "unmatched: 4", "  a1", "  a3", "  a5"]
    rows = selection.select_rows(spark.createDataFrame([("猫", "1", " "), ("犬", None, None)], "lexical_item string, pt string, cl string"), lexical_only=True)
    assert sorted((r["keyword"], r["lexical_item"]) for r in rows.collect()) == [("lexical_item", "犬"), ("pt", "猫")]
    fx.write_rows_by_keyword(rows, str(tmp_path / "rows"))
    assert {p.name for p in (tmp_path / "rows").glob("keyword=*")} == {"keyword=lexical_item", "keyword=pt"}
