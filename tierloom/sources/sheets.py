"""Workbooks as rows of cells, and the roster of signers that such a sheet holds.

A workbook is a ZIP archive of XML parts. Spark reads the archives by any path that it knows, one task decodes one archive, as
an archive cannot be split, and its rows leave the task in batches. Nothing is written to a local disk.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# How a sheet names prefectures, and the codes of the corpus; names of the XML parts.
PREFECTURES = {
    "群馬": "GM", "Gunma": "GM", "奈良": "NR", "Nara": "NR", "長崎": "NS", "Nagasaki": "NS", "福岡": "FO", "Fukuoka": "FO",
    "石川": "IS", "Ishikawa": "IS", "富山": "TY", "Toyama": "TY", "茨城": "IK", "Ibaraki": "IK",
}
_BOOK, _LINKS, _STRINGS = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml"
_CELLS = pa.schema([("workbook", pa.string()), ("sheet", pa.string()), ("position", pa.int32()), ("row", pa.int64()), ("cells", pa.list_(pa.string())), ("problem", pa.string())])
_BATCH_ROWS = 2000


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(node: ElementTree.Element) -> str:
    """The text of a string item, without its readings (phonetic runs)."""
    return "".join(t.text or "" for part in node if _local(part.tag) != "rPh" for t in part.iter() if _local(t.tag) == "t")


def _number(text: str) -> str:
    """A number as the sheet shows it plainly: whole ones without a point."""
    try:
        value = float(text)
    except ValueError:
        return text
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def _cell(node: ElementTree.Element, shared: list[str]) -> str | None:
    kind, value = node.get("t", "n"), next((c.text or "" for c in node if _local(c.tag) == "v"), None)
    if kind == "inlineStr":
        return next((_text(c) for c in node if _local(c.tag) == "is"), None)
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    return _number(value) if kind == "n" else value


def column_number(reference: str) -> int:
    """Number from 0 of a cell reference's letters: A1 is 0, AA7 is 26."""
    number = 0
    for letter in re.match(r"[A-Za-z]*", reference)[0].upper():
        number = 26 * number + ord(letter) - 64
    return number - 1


def sheet_rows(data: bytes) -> Iterator[tuple[str, int, int, list[str | None]]]:
    """(sheet, its position, row, cells) of every row of a workbook that has cells, sheet by sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = set(archive.namelist())
        shared = [_text(i) for i in ElementTree.fromstring(archive.read(_STRINGS)) if _local(i.tag) == "si"] if _STRINGS in names else []
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(archive.read(_LINKS))}
        book = ElementTree.fromstring(archive.read(_BOOK))
        sheets = [(s.get("name"), next(v for k, v in s.attrib.items() if _local(k) == "id")) for s in book.iter() if _local(s.tag) == "sheet"]
        for position, (name, link) in enumerate(sheets):
            target = targets[link]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            with archive.open(part) as stream:
                last = 0
                for _, node in ElementTree.iterparse(stream):
                    if _local(node.tag) != "row":
                        continue
                    last = int(node.get("r", last + 1))
                    cells: list[str | None] = []
                    for c in node:
                        at = column_number(c.get("r", "")) if c.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        cells[at] = _cell(c, shared)
                    node.clear()  # a row leaves memory once it is told
                    if any(c is not None for c in cells):
                        yield name, position, last, cells


def _decoded(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all workbooks, and one row with a problem for each that cannot be read."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[tuple]:
            for batch in batches:
                for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    try:
                        for sheet, position, row, cells in sheet_rows(content):
                            yield name, sheet, position, row, cells, None
                    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, StopIteration) as e:
                        yield name, None, None, None, None, f"{type(e).__name__}: {e}"

        held: list[tuple] = []
        for item in items():
            held.append(item)
            if len(held) == _BATCH_ROWS:
                yield pa.RecordBatch.from_pylist([dict(zip(_CELLS.names, h, strict=True)) for h in held], _CELLS)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(_CELLS.names, h, strict=True)) for h in held], _CELLS)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path).select("path", "content")
    return files.mapInArrow(decode, "workbook string, sheet string, position int, row long, cells array<string>, problem string")


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all sheets of the workbooks below a path: workbook, sheet, position (from 0), row and cells from column A on.

    Empty cells are null and rows without any are left out; numbers stand as the sheet shows them plainly, formulas by their
    stored value. A workbook that cannot be read has the rows that were read before its fault; ``unreadable_sheets`` names it.
    """
    return _decoded(spark, path).where("problem IS NULL").drop("problem")


def unreadable_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Workbooks that are no workbooks or are broken, with what is wrong."""
    return _decoded(spark, path).where("problem IS NOT NULL").select("workbook", "problem")


def roster_of_sheet(rows: DataFrame, prefectures: Mapping[str, str] = PREFECTURES) -> DataFrame:
    """The signers of sheets: workbook, sheet, signer, prefecture, pair, age, gender and dominant_hand.

    rows are those of ``read_sheets``; the first six cells are heading, pair, number, hand, age and gender. A heading that
    names a prefecture begins its block; others are passed over. An age is written once for a pair that shares it and holds
    until the next pair or block; one of its own takes its place. Of a signer's rows the last counts.

    Defined cases: rows before the first block, without a whole number, or with fewer cells have no signer; nulls are blanks;
    every carry-down stays within one sheet of one workbook.
    """
    cell = lambda k: strip(F.coalesce(F.try_element_at("cells", F.lit(k + 1)), F.lit("")))
    heading: Column = F.col("heading")
    code = F.lit(None).cast("string")
    for name, prefix in reversed(prefectures.items()):
        code = F.when(heading.contains(name), prefix).otherwise(code)
    named = rows.select("workbook", "sheet", "row", *[cell(k).alias(c) for k, c in enumerate(("heading", "pair", "number", "hand", "age", "gender"))])
    order = Window.partitionBy("workbook", "sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    known = named.withColumn("block", F.when(heading != "", code)).withColumn("prefecture", F.last("block", True).over(order))
    listed = (heading == "") & F.col("prefecture").isNotNull() & F.col("number").rlike("^[0-9]+$")
    known = known.withColumn("listed", listed).withColumn("carried", F.sum((F.col("block").isNotNull() | (listed & (F.col("pair") != ""))).cast("int")).over(order))
    within = Window.partitionBy("workbook", "sheet", "carried").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("listed"), F.nullif("age", F.lit(""))), True).over(within)
    plain = F.regexp_replace("number", "^0+(?=[0-9])", "")
    signer = F.concat("prefecture", F.lit("_"), F.lpad(plain, F.greatest(F.lit(2), F.length(plain)), F.lit("0")))
    out = known.select("workbook", "sheet", "row", signer.alias("signer"), "prefecture", "pair", F.coalesce(held, F.lit("")).alias("age"), F.upper("gender").alias("gender"), F.upper("hand").alias("dominant_hand"), "listed").where("listed")
    last = F.max_by(F.struct("prefecture", "pair", "age", "gender", "dominant_hand"), "row")
    return out.groupBy("workbook", "sheet", "signer").agg(last.alias("r")).select("workbook", "sheet", "signer", "r.*")
