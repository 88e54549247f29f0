"""Sheets, files of their own names and landmark archives: read, written, and what failures leave."""

import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierloom.sources import file_sink, files, landmark_archives, sheets

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def letters(k):
    return chr(65 + k) if k < 26 else chr(64 + k // 26) + chr(65 + k % 26)


def workbook(path, sheets_):
    """A small workbook: strings are shared, numbers plain, booleans marked; None is no cell."""
    strings: list[str] = []
    parts = {}
    for number, rows in enumerate(sheets_.values(), 1):
        body = ""
        for r, row in enumerate(rows, 1):
            cells = ""
            for k, v in enumerate(row):
                if v is None:
                    continue
                if isinstance(v, bool):
                    cells += f'<c r="{letters(k)}{r}" t="b"><v>{int(v)}</v></c>'
                elif isinstance(v, str) and v.startswith("="):
                    cells += f'<c r="{letters(k)}{r}" t="str"><f>x</f><v>{v[1:]}</v></c>'
                elif isinstance(v, str) and v.startswith("'"):
                    cells += f'<c r="{letters(k)}{r}" t="inlineStr"><is><t>{v[1:]}</t></is></c>'
                elif isinstance(v, str):
                    strings.append(v)
                    cells += f'<c r="{letters(k)}{r}" t="s"><v>{len(strings) - 1}</v></c>'
                else:
                    cells += f'<c r="{letters(k)}{r}"><v>{v}</v></c>'
            body += f'<row r="{r}">{cells}</row>'
        parts[f"xl/worksheets/sheet{number}.xml"] = f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>"
    names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets_, 1))
    links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets_) + 1))
    parts["xl/workbook.xml"] = f"<workbook {NS}><sheets>{names}</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = f"<Relationships>{links}</Relationships>"
    parts["xl/sharedStrings.xml"] = f"<sst {NS}>" + "".join(f"<si><t>{s}</t><rPh sb='0' eb='1'><t>よみ</t></rPh></si>" for s in strings) + "</sst>"
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


ROSTER = [
    ["Signers", None, None], ["", "1-2", 1, "R", 30, "m"],  # before any block
    ["福岡県 Fukuoka"], [None, "1-2", 1, "r", 40, "m"], [None, None, 2, "L", None, " F "], [None, "3-4", 3, None, None, "f"], [None, None, 4, "R", 55.0, "M"], [None, None, 5, "R", None, "M"],
    ["notes"], [None, None, "x", "R", 99, "M"], [None, "7-8", 7.0, "R", 20, "F"], [None, None, 2, "R", 61, "F"],
    ["Nara"], [None, None, 8, "R", None, "F"], [None, "9", 109, "R", 33.5, "F"],
]


def test_roster_of_a_workbook(spark, tmp_path):
    workbook(tmp_path / "a.XLSX", {"signers": ROSTER, "other": [["x", True, "'in line", "=told", 1e20, 0.1]]})
    workbook(tmp_path / "b.xlsx", {"empty": []})
    (tmp_path / "bad.xlsx").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "half.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", "<workbook")
    rows = sheets.read_sheets(spark, str(tmp_path))
    assert [r["cells"] for r in rows.where("sheet = 'other'").collect()] == [["x", "True", "in line", "told", "1e+20", "0.1"]]
    assert {r["workbook"].rsplit("/", 1)[-1] for r in sheets.unreadable_sheets(spark, str(tmp_path)).collect()} == {"bad.xlsx", "half.xlsx"}
    roster = sheets.roster_of_sheet(rows.where("position = 0"))
    got = sorted((r["signer"], r["pair"], r["age"], r["gender"], r["dominant_hand"]) for r in roster.collect())
    assert got == [
        ("FO_01", "1-2", "40", "M", "R"), ("FO_02", "", "61", "F", "R"), ("FO_03", "3-4", "", "F", ""), ("FO_04", "", "55", "M", "R"), ("FO_05", "", "55", "M", "R"),
        ("FO_07", "7-8", "20", "F", "R"), ("NR_08", "", "", "F", "R"), ("NR_109", "9", "33.5", "F", "R"),
    ]


def test_carry_down_stays_within_its_workbook(spark):
    cells = spark.createDataFrame([("a", "s", 1, ["Nara"]), ("a", "s", 2, ["", "1", "1", "", "40", ""]), ("b", "s", 3, ["", "", "2", "", "", ""]), ("a", "t", 4, ["", "", "3"]), ("a", "s", 5, None), ("a", "s", 6, [None, None, "2"])], "workbook string, sheet string, row long, cells array<string>")
    assert sorted((r["workbook"], r["signer"], r["age"]) for r in sheets.roster_of_sheet(cells).collect()) == [("a", "NR_01", "40"), ("a", "NR_02", "40")]
    plan = sheets.roster_of_sheet(cells)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    out = str(tmp_path / "out")
    frame = spark.createDataFrame([(f"d{i}.eaf", bytes([i]) * (i + 1)) for i in range(40)], "name string, content binary").repartition(3)
    file_sink.write_files(frame, out)
    read = lambda: sorted((r["name"], bytes(r["content"])) for r in file_sink.read_files(spark, out).collect())
    first = [(f"d{i}.eaf", bytes([i]) * (i + 1)) for i in range(40)]
    assert read() == sorted(first) and "_SUCCESS" in os.listdir(out) and not [n for n in os.listdir(out) if n.startswith("_staged")]

    @F.udf("binary")
    def failing(name, content):
        if name == "d39.eaf":
            raise RuntimeError("this task dies")
        return content

    with pytest.raises(Exception, match="this task dies"):
        file_sink.write_files(frame.withColumn("content", failing("name", "content")), out)
    assert read() == sorted(first)  # what a task that outlives the job stages is under a name that readers pass over
    file_sink.write_files(frame.where("name = 'd7.eaf'"), out)
    assert read() == [first[7]]
    file_sink.write_files(spark.createDataFrame([("e.eaf", None)], "name string, content binary"), out, append=True)
    assert read() == [first[7]] and sum("e.eaf" in names for _, _, names in os.walk(out)) == 1  # empty, so not read
    file_sink.write_files(frame.where("false"), out)
    assert read() == []


@pytest.mark.parametrize("name", [None, "", "a/b", "_hidden", ".x"])
def test_names_that_are_none(spark, tmp_path, name):
    with pytest.raises(Exception, match="no name for a file"):
        file_sink.write_files(spark.createDataFrame([(name, b"x")], "name string, content binary"), str(tmp_path / "o"))


def test_tables_with_a_mark(spark, tmp_path):
    frame = spark.createDataFrame([("ア", 1, None), ('q"x, y', 2, ""), ("a\nb", 3, "z")], "name string, n int, t string")
    files.write_csv(frame, str(tmp_path / "t"))
    (part,) = [p for p in os.listdir(tmp_path / "t") if p.endswith(".csv")]
    raw = (tmp_path / "t" / part).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfname,n,t") and b'""' not in raw.replace(b'"q""x, y"', b"")
    back = files.read_csv(spark, str(tmp_path / "t" / part)).orderBy("row").collect()
    assert [r["cells"] for r in back] == [{"name": "ア", "n": "1", "t": ""}, {"name": 'q"x, y', "n": "2", "t": ""}, {"name": "a\nb", "n": "3", "t": "z"}]


def test_archives_round_trip(spark, tmp_path):
    r = np.random.default_rng(1)
    n = {"pose_xyv": (6, 3), "pose_xyz": (6, 3), "face_xy": (2, 2), "left_hand_xy": (6, 2), "right_hand_xy": (6, 2)}
    source = tmp_path / "in"
    source.mkdir()
    tensors = {}
    for clip, frames in (("FO_01 あ", 12), ("long", 11_000), ("none", 0)):
        t = {k: r.random((frames, *shape), dtype=np.float32) for k, shape in n.items()}
        if frames:
            t["left_hand_xy"][3] = np.nan
        labels = {s: np.asarray(["observed", "missing"] * (frames // 2), dtype="<U16") for s in landmark_archives.SOURCES}
        np.savez_compressed(source / f"{clip}.npz", **t, **labels)
        tensors[clip] = t | labels
    (source / "FO_01 あ.json").write_text(json.dumps({"format_version": 1, "fps": 29.97, "width": 640, "height": 480, "hands_rejected_offtarget": 2, "note": "ü", "ids": [1, 2]}))
    read = landmark_archives.read_archives(spark, str(source))
    assert read.count() == 11_012
    one = read.where("clip_id LIKE 'FO%' AND frame = 3").first()
    assert (one["fps"], one["width"], one["meta"]["note"], one["left_hand_source"]) == (29.97, 640, "ü", "missing") and np.isnan(one["left_hand"][0]["x"])
    out = str(tmp_path / "out")
    landmark_archives.write_archives(read, out)
    for d, _, names in os.walk(out):
        for name in names:
            if name.endswith(".npz"):
                with np.load(os.path.join(d, name)) as z:
                    for k, want in tensors[name[:-4]].items():
                        assert z[k].dtype == want.dtype and np.array_equal(z[k], want, equal_nan=want.dtype.kind == "f")
            elif name.startswith("FO"):
                with open(os.path.join(d, name), encoding="utf-8") as f:
                    meta = json.load(f)
                assert (meta["n_frames"], meta["fps"], meta["note"], meta["ids"]) == (12, 29.97, "ü", "[1,2]")
    again = landmark_archives.read_archives(spark, out)
    points = ["clip_id", "frame", *(c for c, _ in landmark_archives.TENSORS.values()), *landmark_archives.SOURCES]
    text = lambda f: f.select(*points).withColumn("x", F.to_json(F.struct(*points))).select(F.xxhash64("x").alias("h"))
    assert text(read).exceptAll(text(again)).count() == text(again).exceptAll(text(read)).count() == 0


def test_frames_of_other_sizes_and_points(spark, tmp_path):
    p = lambda *xs: [(x, x) for x in xs]
    frames = spark.createDataFrame([("c", 0, p(1.0, 2.0)), ("c", 1, p(3.0)), ("c", 2, None)], "clip_id string, frame long, face array<struct<x:float,y:float>>")
    landmark_archives.write_archives(frames, str(tmp_path / "o"))
    got = [r["face"] for r in landmark_archives.read_archives(spark, str(tmp_path / "o")).orderBy("frame").collect()]
    assert [tuple(x) for x in got[0]] == [(1.0, 1.0), (2.0, 2.0)] and all(np.isnan(v) for f in got[1:] for x in f for v in x)
    with pytest.raises(Exception, match="repeated frames"):
        landmark_archives.write_archives(frames.unionByName(frames), str(tmp_path / "p"))
    lit = lambda v: F.lit(v)
    moved = frames.where("frame = 0").select(landmark_archives.unpadded(F.col("face"), (lit(100), lit(50)), (lit(120), lit(70)), (lit(10), lit(10))).alias("f"), landmark_archives.selected_points(F.col("face"), [1, 5, 0]).alias("s")).first()
    assert np.allclose([tuple(x) for x in moved["f"]], [(1.1, 1.2), (2.3, 2.6)]) and [x and x["x"] for x in moved["s"]] == [2.0, None, 1.0]
