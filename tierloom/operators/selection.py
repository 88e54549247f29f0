"""Which documents, rows and clips a run works on, and the orders in which reports list them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gloss_parser import COLUMNS_OF_MARKS
from ..functions.text import clip_key, strip
from .corpus import gloss_statistics, top_glosses
from .relations import excluded

# Folders of tasks, columns of markers, the name of the whole corpus.
TASKS = ("AniN", "Cur", "Pro", "ReS", "Int")
MARKER_COLUMNS = (*COLUMNS_OF_MARKS, "compound", "ambiguous")
KEYWORDS = ("lexical_item", "cl", "fs", "pt")
WHOLE = "GLOBAL"
KIND_ORDER = ("summary", "lexical", "key")


def filled(column: str) -> Column:
    """Not null and not blank."""
    return strip(F.coalesce(F.col(column).cast("string"), F.lit(""))) != ""


def is_canonical(path: Column) -> Column:
    """A document in a task folder of a numbered region folder."""
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike(rf"(?i)(^|/)\d\d_[^/]+/({'|'.join(TASKS)})/[^/]+\.eaf$")


def manifest(files: DataFrame) -> DataFrame:
    """The selection that runs share: stem, region_code, path, in_task_folder; files has path."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return files.select(stem.alias("stem"), F.upper(F.substring_index(stem, "_", 1)).alias("region_code"), "path", F.when(is_canonical(F.col("path")), "yes").otherwise("no").alias("in_task_folder"))


def listed(entries: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing) paths of a manifest; entries and files have path. Blank entries go."""
    wanted = entries.select(strip(F.col("path")).alias("path")).where("path <> ''")
    have = files.select("path").distinct()
    return wanted.join(have, "path", "left_semi"), wanted.join(have, "path", "left_anti")


def select_rows(rows: DataFrame, keywords: Sequence[str] = KEYWORDS, lexical_only: bool = False) -> DataFrame:
    """Rows once for each keyword whose column is filled, as ``keyword``; all keywords in one pass.

    With ``lexical_only``, rows of lexical_item have no marker at all. Keywords without a column give no rows.
    """
    bare = F.lit(True)
    for c in MARKER_COLUMNS:
        if c in rows.columns:
            bare = bare & ~filled(c)
    wanted = [F.when(filled(k) & (bare if lexical_only and k == "lexical_item" else F.lit(True)), F.lit(k)) for k in keywords if k in rows.columns]
    return rows.withColumn("keyword", F.explode(F.array_compact(F.array(*wanted)))) if wanted else rows.withColumn("keyword", F.lit("")).limit(0)


def first_per_keyword(rows: DataFrame, n: int, order: Sequence[str], keyword: str = "keyword") -> DataFrame:
    """The first rows of each keyword in an order; 0 keeps all."""
    if not n:
        return rows
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(keyword).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def load_frames(index: DataFrame, frames: DataFrame, metadata: DataFrame, keywords: Sequence[str] = (), regions: Sequence[str] = (), exclusions: DataFrame | None = None) -> DataFrame:
    """Frames of the chosen clips with the clips' columns, and labels that the metadata gives now.

    index has clip_id, clip (its path), keyword, region_code, signer_id and handedness; frames clip_id and
    counts; metadata signer_id, age_group, age_band and gender. Clips without frames drop out.
    """
    chosen = index
    if keywords:
        chosen = chosen.where(F.upper("keyword").isin(*[k.upper() for k in keywords]))
    if regions:
        chosen = chosen.where(F.upper("region_code").isin(*[r.upper() for r in regions]))
    if exclusions is not None:
        chosen = excluded(chosen, "clip", exclusions).where("number IS NULL").drop("number")
    labels = metadata.select("signer_id", "age_group", "age_band", "gender")
    return frames.join(chosen.select("clip_id", "keyword", "region_code", "signer_id", "handedness"), "clip_id").join(labels, "signer_id", "left")


def merged_exclusions(*lists: DataFrame) -> DataFrame:
    """Several exclusion lists as one, entries that are equal as clip keys once; lists have entry and number.

    Entries keep the order of the lists and, within a list, of their numbers.
    """
    every = None
    for i, x in enumerate(lists):
        part = x.select("entry", clip_key(F.col("entry")).alias("key"), F.lit(i).alias("list"), F.col("number").cast("long").alias("line")).where("key <> ''")
        every = part if every is None else every.unionByName(part)
    at = F.struct("list", "line", "entry")
    firsts = every.groupBy("key").agg(F.min(at).alias("at"))
    return firsts.select("key", F.col("at.entry").alias("entry"), F.col("at.list").alias("list"), F.col("at.line").alias("line"))


def whole_rows(table: DataFrame) -> DataFrame:
    """Rows of the whole corpus in a table that also has regional ones; a table without a whole stays as it is."""
    for c in ("scope", "tag"):
        if c in table.columns:
            any_ = table.select(F.coalesce(F.bool_or(F.col(c) == WHOLE), F.lit(False)).alias("__any"))
            return table.join(F.broadcast(any_)).where(~F.col("__any") | (F.col(c) == WHOLE)).drop("__any")
    return table


def largest_units(table: DataFrame, least: int = 20, most: int = 12) -> DataFrame:
    """Units that a figure shows: the most labels in all, at least so many; baselines are not compared."""
    keys = table.where((F.col("unit") != "any annotation") & ~F.col("unit").startswith("lexical_item"))
    return keys.groupBy("unit").agg(F.sum("n_labels").alias("n_labels")).where(F.col("n_labels") >= least).orderBy(F.desc("n_labels"), "unit").limit(most)


def variety(summary: DataFrame) -> DataFrame:
    """Distinct lexical items per thousand parsed rows, by region; regions without rows drop out."""
    return summary.where(F.col("tag") != WHOLE).select("tag", (F.lit(1000.0) * F.col("n_unique_lexical_items") / F.nullif(F.col("n_parsed"), F.lit(0))).alias("per_1000")).where("per_1000 IS NOT NULL")


def top_glosses_report(flagged: DataFrame, top_n: int = 100, min_signers: int = 2, regions: Sequence[str] = (), min_occurrences: int = 1) -> DataFrame:
    """The most frequent glosses of chosen regions, counted anew for them, with what the list was asked for."""
    top = top_glosses(gloss_statistics(flagged, list(regions) or None), top_n, min_signers, min_occurrences)
    return top.withColumns({"scope": F.lit(";".join(regions) or WHOLE), "min_signers_required": F.lit(min_signers).cast("long")})


def kind_rank(kind: Column) -> Column:
    """Place of a unit's kind in an overlap table: summary, lexical, key."""
    return F.array_position(F.array(*map(F.lit, KIND_ORDER)), kind)


def role_rank(role: Column, roles: Sequence[str]) -> Column:
    """Place of a hand role in the order asked for; others last."""
    at = F.array_position(F.array(*map(F.lit, roles)), role)
    return F.when(at == 0, len(roles) + 1).otherwise(at)


def level_key(level: Column) -> Column:
    """A sort key that puts age bands youngest first and everything else after them by name."""
    text = F.trim(level.cast("string"))
    digits = F.regexp_replace(text, "[^0-9]", "")
    banded = digits != ""
    opens = F.when(text.startswith("<"), 0).otherwise(1)
    return F.struct(F.when(banded, 0).otherwise(1).alias("kind"), F.when(banded, digits.cast("long")).alias("years"), F.when(banded, opens).alias("side"), F.when(~banded, text).alias("name"))


def place(order: Sequence[Column]) -> Column:
    """The row's number in an order, as a column: the order of a report outlives its storage.

    For report tables alone: all rows of one order meet in one task.
    """
    return F.row_number().over(Window.orderBy(*order)).cast("long")
