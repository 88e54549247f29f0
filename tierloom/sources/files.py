"""Listings, text lists, CSV tables of any encoding, and the selection of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# Fixed values.
ENCODINGS = ("utf-8-sig", "utf-8", "cp932", "shift_jis")
SKIPPED_PREFIXES = ("tab_", "summary_", "top_")
STEM_SUFFIXES = ("PARSED", "WORDANNOTATIONS", "ANNOTATIONS")
PARSED_COLUMNS = ("speaker_id", "tier_id", "time_start", "time_end", "annotation", "lexical_item", "pt", "dw", "fs", "aw", "lh", "rh", "d", "cl", "m", "ges", "nmm", "rep", "stop", "hold", "index", "keep", "fal", "un", "qm", "past", "neg", "compound", "ambiguous")


def list_files(spark: SparkSession, folder: str, suffix: str = ".eaf", recursive: bool = True) -> DataFrame:
    """Paths with a suffix in any case, without reading their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length", "modificationTime")
    return files.where(F.lower("path").endswith(suffix.lower())).orderBy("path")


def list_versions(spark: SparkSession, folder: str, include_old: bool = False) -> DataFrame:
    """Annotation documents and their numbered versions; folders whose name starts with old are left out."""
    files = list_files(spark, folder, "").where(F.col("path").rlike(r"(?i)\.eaf(\.\d+)?$"))
    return files if include_old else files.where(~F.col("path").rlike(r"(?i)/old[^/]*/"))


def stem_key(path: Column) -> Column:
    """Upper-case letters and digits of a file's stem, without stage suffixes."""
    stem = F.upper(F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(\.[A-Za-z0-9]+)+$", ""), r"[^A-Za-z0-9]", ""))
    return F.regexp_replace(stem, rf"({'|'.join(STEM_SUFFIXES)})+$", "")


def read_text_list(spark: SparkSession, path: str, inline_comments: bool = False) -> DataFrame:
    """Lines of a list (line, number), blanks and comments dropped; a byte order mark goes."""
    text = F.regexp_replace("value", "^﻿", "")
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("number"), strip(F.split(text, "#", 2)[0] if inline_comments else text).alias("line"))
    return lines.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """Documents that a list names (stem, line, number): one for each stem, as it is first written, in the list's order."""
    lines = read_text_list(spark, path).select(stem_key(F.col("line")).alias("stem"), "line", "number").where("stem <> ''")
    first = lines.groupBy("stem").agg(F.min(F.struct("number", "line")).alias("f"))
    return first.select("stem", "f.line", "f.number").orderBy("number")


def select_documents(files: DataFrame, wanted: DataFrame | None = None, regions: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The chosen documents, one path to a stem, with what is missing and what is doubled.

    A list of stems beats the listing; regions are filtered before stems are grouped.
    """
    keyed = files.withColumn("stem", stem_key(F.col("path"))).withColumn("region_code", F.upper(F.regexp_extract("path", r"([A-Za-z]+)[^/\\]*$", 1)))
    if regions:
        keyed = keyed.where(F.col("region_code").isin(*[r.upper() for r in regions]))
    asked = None if wanted is None else wanted.select(stem_key(F.col("line")).alias("stem")).distinct()
    if asked is not None:
        keyed = keyed.join(asked, "stem", "left_semi")
    grouped = keyed.groupBy("stem").agg(F.min("path").alias("path"), F.min("region_code").alias("region_code"), F.count("*").alias("n"))
    missing = grouped.limit(0).select("stem") if asked is None else asked.join(grouped, "stem", "left_anti")
    return {"files": grouped.drop("n"), "missing": missing, "duplicates": grouped.where("n > 1").select("stem", "n")}


def read_csv(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """CSV rows as (source_file, row, cells map); each file by the first encoding that fits.

    Files that none fits have no rows here; ``unreadable_csv`` names them.
    """
    return _parsed_csv(spark, path, encodings).select("source_file", F.posexplode("rows").alias("row", "cells"))


def unreadable_csv(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """The files of a folder that no encoding fits."""
    return _parsed_csv(spark, path, encodings).where("rows IS NULL").select("source_file")


def _parsed_csv(spark: SparkSession, path: str, encodings: Sequence[str]) -> DataFrame:
    """(source_file, rows): null rows where no encoding fits.

    Quoted fields may hold line ends, and encodings differ by file, so a file is decoded and cut by one task.
    """

    @F.pandas_udf("array<map<string,string>>")
    def parse(content):
        import csv
        import io

        def rows(data: bytes) -> list[dict[str, str]] | None:
            for encoding in encodings:
                try:
                    text = data.decode(encoding)
                    break
                except UnicodeDecodeError:
                    continue
            else:
                return None
            return [{(k or "").lstrip("﻿").strip(): v or "" for k, v in r.items() if k is not None and not isinstance(v, list)} for r in csv.DictReader(io.StringIO(text))]

        return content.map(rows)

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("source_file"), "content")
    return files.select("source_file", parse("content").alias("rows"))


def load_parsed(spark: SparkSession, path: str) -> DataFrame:
    """All parsed tables of a folder in one frame; missing columns are empty, tables without annotations are left out."""
    from ..functions.text import file_key, region_of

    cells = read_csv(spark, path).where(~F.col("source_file").rlike(f"^({'|'.join(SKIPPED_PREFIXES)})"))
    useful = cells.where(F.map_contains_key("cells", "annotation") | F.map_contains_key("cells", "lexical_item"))
    name = F.col("source_file")
    return useful.select("source_file", file_key(name).alias("file_key"), region_of(name).alias("region_code"), "row", *[F.coalesce(F.try_element_at("cells", F.lit(c)), F.lit("")).alias(c) for c in PARSED_COLUMNS])


def first_existing(frame: DataFrame, *names: str) -> Column:
    """The first non-blank value among columns that exist, whatever the case of their names."""
    found = {c.lower().replace(" ", "_"): c for c in frame.columns}
    values = [F.nullif(strip(F.col(f"`{found[n]}`").cast("string")), F.lit("")) for n in names if n in found]
    return F.coalesce(*values, F.lit("")) if values else F.lit("")


def write_csv(frame: DataFrame, path: str, parts: int = 1, mark: bool = True) -> None:
    """A table as CSV for spreadsheets: a byte order mark, a header and blanks for nulls, in the order of the frame's columns.

    Parquet is the native form; an export is one file, or ``parts`` of them, each with its header and mark. The mark is the
    first character of the header's first name, so that Spark's own writer and its commits do the rest; lists for programs
    go without it.
    """
    first, *rest = frame.columns
    marked = frame.select(F.col(f"`{first}`").alias(("\ufeff" if mark else "") + first), *[F.col(f"`{c}`") for c in rest])
    plain = {"header": True, "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    marked.coalesce(parts).write.mode("overwrite").options(**plain).csv(path)


def write_partitioned(frame: DataFrame, path: str, column: str) -> None:
    """A table split by the values of a column."""
    frame.write.mode("overwrite").partitionBy(column).parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Paths that a manifest lists: the path column of a CSV, or the lines of a text list without comments."""
    if not path.lower().endswith(".csv"):
        return read_text_list(spark, path, inline_comments=True).select(F.col("line").alias("path"))
    cells = read_csv(spark, path)
    if not cells.isEmpty() and cells.where(F.map_contains_key("cells", "path")).isEmpty():
        raise ValueError(f"{path} has no path column")
    return cells.select(strip(F.coalesce(F.try_element_at("cells", F.lit("path")), F.lit(""))).alias("path")).where("path <> ''")


def write_manifest(selection: DataFrame, path: str) -> None:
    """The selection of ``operators.selection.manifest`` as one CSV file, in the order of its paths."""
    write_csv(selection.select("stem", "region_code", "path", "in_task_folder").orderBy("path"), path, mark=False)


def write_tier_report(report: DataFrame, path: str, most: int = 100) -> None:
    """A text file per document: how many rows were matched, and the first unmatched ones in their order.

    report has doc, n, matched and annotation; the number of all unmatched rows is always told.
    """
    w = Window.partitionBy("doc", "matched").orderBy("n")
    some = report.withColumn("__rn", F.row_number().over(w))
    shown = F.when(~F.col("matched") & (F.col("__rn") <= most), F.struct("n", F.concat(F.lit("  "), F.col("annotation")).alias("line")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["line"]), "\n")
    text = F.concat(F.col("doc"), F.lit("\nmatched: "), F.count_if("matched").cast("string"), F.lit("\nunmatched: "), F.count_if(~F.col("matched")).cast("string"), F.lit("\n"), lines)
    some.groupBy("doc").agg(text.alias("value")).write.mode("overwrite").partitionBy("doc").text(path)


def write_rows_by_keyword(selected: DataFrame, path: str) -> None:
    """Selected rows as CSV with a folder for each keyword."""
    selected.write.mode("overwrite").option("header", True).option("escape", '"').partitionBy("keyword").csv(path)


def latex_table(frame: DataFrame, caption: str, limit: int = 200) -> str:
    """A small result as a LaTeX table; a larger one than ``limit`` rows raises ValueError, and none is cut."""
    special = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}

    def cell(v: object) -> str:
        if v is None:
            return "--"
        if isinstance(v, bool):
            return "yes" if v else "no"
        if isinstance(v, int):
            return f"{v:,}"
        return f"{v:.2f}" if isinstance(v, float) else "".join(special.get(c, c) for c in str(v))

    rows = frame.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; choose fewer or raise the limit")
    body = [" & ".join(map(cell, r)) + r" \\" for r in rows]
    head = " & ".join(cell(c) for c in frame.columns) + r" \\"
    return "\n".join([r"\begin{table}", rf"\caption{{{cell(caption)}}}", rf"\begin{{tabular}}{{{'l' * len(frame.columns)}}}", r"\hline", head, r"\hline", *body, r"\hline", r"\end{tabular}", r"\end{table}"])
