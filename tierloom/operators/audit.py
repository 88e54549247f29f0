"""Audit rules over tiers and a roster: each gives findings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import participant_of_tier, signer_stem
from .space import normalise_gender


def outside_pair(tiers: DataFrame) -> DataFrame:
    """Signers that the recording's name (XX_NN-NN) does not list; tiers have recording and signer."""
    pattern = r"^([A-Za-z]{2})[_ -]?0*(\d+)-0*(\d+)"
    name, signer = F.col("recording"), signer_stem(F.col("signer"))
    member = lambda k: signer_stem(F.concat(F.regexp_extract(name, pattern, 1), F.lit("_"), F.regexp_extract(name, pattern, k)))
    return tiers.where(name.rlike(pattern)).select("recording", "signer", member(2).alias("first"), member(3).alias("second"), signer.alias("stem")).where(~F.col("stem").isin(F.col("first"), F.col("second"))).drop("stem")


def name_against_attribute(tiers: DataFrame) -> DataFrame:
    """Tiers whose id and participant attribute name different people, or one person differently."""
    by_name, by_attribute = participant_of_tier(F.col("tier_id")), F.trim(F.coalesce("participant", F.lit("")))
    differs = (by_name != "") & (by_attribute != "") & (by_name != by_attribute)
    same = signer_stem(by_name) == signer_stem(by_attribute)
    return tiers.where(differs).select("doc", "tier_id", "participant", F.when(same, "same signer").otherwise("different signer").alias("problem"))


def against_roster(people: DataFrame, roster: DataFrame) -> DataFrame:
    """Signers that lack an age or gender, are not in the roster, or contradict it; both have signer, age and gender."""
    sheet = roster.select(signer_stem(F.col("signer")).alias("__stem"), F.col("age").alias("sheet_age"), normalise_gender(F.col("gender")).alias("sheet_gender"))
    joined = people.withColumn("__stem", signer_stem(F.col("signer"))).join(sheet, "__stem", "left")
    gender = normalise_gender(F.col("gender"))
    problem = (
        F.when(F.col("sheet_gender").isNull(), "not in roster")
        .when(F.col("age").isNull() | (gender == "unknown"), "missing")
        .when((F.col("sheet_age").isNotNull() & (F.col("age") != F.col("sheet_age"))) | ((F.col("sheet_gender") != "unknown") & (gender != F.col("sheet_gender"))), "contradicts")
    )
    return joined.select("signer", "age", "gender", "sheet_age", "sheet_gender", problem.alias("problem")).where("problem IS NOT NULL")


def to_do(findings: DataFrame) -> DataFrame:
    """One line per tier: the first problem by rank and all files; findings have rank, signer, tier_id, doc, problem,
    detail and, where they may be equal in rank, doc and problem, n (their order): the first of equals gives the detail."""
    order = F.struct("rank", "doc", "problem")
    first = [-F.col("n")] if "n" in findings.columns else []
    return findings.groupBy("signer", "tier_id").agg(F.min("rank").alias("rank"), F.min_by("problem", order).alias("problem"), F.max_by("detail", F.struct("rank", "doc", "problem", *first)).alias("detail"), F.array_join(F.array_sort(F.collect_set("doc")), ";").alias("docs"))


def to_do_by_signer(findings: DataFrame) -> DataFrame:
    """One line per signer, category and rank: all recordings and tiers, and the detail of the last finding.

    findings have n (their order), rank, category, signer, recording, tier_id and detail. At most three tiers are
    named, after their number.
    """
    tiers = F.array_sort(F.collect_set("tier_id"))
    shown = F.concat(F.array_join(F.slice("tiers", 1, 3), " "), F.when(F.size("tiers") > 3, " ...").otherwise(""))
    grouped = findings.groupBy("category", "signer", "rank").agg(F.array_join(F.array_sort(F.collect_set("recording")), ", ").alias("recording"), tiers.alias("tiers"), F.max_by("detail", "n").alias("problem"))
    return grouped.select("rank", "category", "recording", F.concat(F.size("tiers").cast("string"), F.lit(" tier(s): "), shown).alias("tier"), "signer", "problem")


def word_variant(tier: Column) -> Column:
    """What follows the word marker in a tier id, empty for the plain tier, null for other tiers."""
    return F.when(tier.rlike("(?i)Word[-_ ]?jp"), F.trim(F.regexp_extract(tier, "(?i)Word[-_ ]?jp(.*)$", 1)))


def tier_variants(tiers: DataFrame) -> DataFrame:
    """Recordings with variants of the word tier: which, how many tiers, and annotations by variant and on plain tiers.

    tiers have recording, tier_id and n (annotations).
    """
    words = tiers.select("recording", word_variant(F.col("tier_id")).alias("variant"), "n").where("variant IS NOT NULL")
    each = words.groupBy("recording", "variant").agg(F.count("*").alias("tiers"), F.sum("n").alias("n"))
    named = F.col("variant") != ""
    listed = F.array_sort(F.collect_list(F.when(named, F.struct("variant", "n"))))
    out = each.groupBy("recording").agg(listed.alias("v"), F.sum(F.when(named, F.col("tiers"))).alias("n_variant_tiers"), F.coalesce(F.sum(F.when(named, F.col("n"))), F.lit(0)).alias("variant_annotations"), F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("plain_word_jp_annotations"))
    by = F.transform("v", lambda x: F.concat(x["variant"], F.lit("="), x["n"].cast("string")))
    return out.where(F.size("v") > 0).select("recording", F.array_join(F.transform("v", lambda x: x["variant"]), " ").alias("variants"), "n_variant_tiers", F.array_join(by, " ").alias("annotations_by_variant"), "variant_annotations", "plain_word_jp_annotations")


def spellings_in_one_file(tiers: DataFrame) -> DataFrame:
    """Signers that one recording spells in several ways; tiers have recording, signer, label and tier_id."""
    named = F.array_sort(F.collect_set("label"))
    return tiers.groupBy("recording", "signer").agg(named.alias("labels"), F.array_join(F.array_sort(F.collect_set("tier_id")), " ").alias("tiers")).where(F.size("labels") > 1).select("recording", "signer", F.array_join("labels", " / ").alias("detail"), "tiers")


def resolve_tiers(rows: DataFrame, tiers: DataFrame) -> DataFrame:
    """Tier of each row: its own id if the document has it, else a tier of its speaker.

    Rows have row_id, doc, tier_id and speaker_id; tiers doc, tier_id and participant. A speaker is found
    by exact participant, then by a participant or id that holds the name; the shortest id wins. Rows that
    find their tier at once do not take part in the search.
    """
    known = tiers.select("doc", "tier_id").distinct().withColumn("found", F.lit(True))
    first = rows.join(known, ["doc", "tier_id"], "left")
    direct = first.where("found").select("row_id", F.col("tier_id").alias("resolved"), F.lit("tier").alias("how"))
    rest = first.where("found IS NULL").select("row_id", "doc", F.lower(F.coalesce("speaker_id", F.lit(""))).alias("who")).where("who <> ''")
    named = tiers.select("doc", F.col("tier_id").alias("candidate"), F.lower(F.coalesce("participant", F.lit(""))).alias("participant"))
    tier = F.when(F.col("participant") == F.col("who"), 0).when(F.col("participant").contains(F.col("who")) | F.lower("candidate").contains(F.col("who")), 1)
    best = rest.join(named, "doc").withColumn("rank", tier).where("rank IS NOT NULL").groupBy("row_id").agg(F.min_by("candidate", F.struct("rank", F.length("candidate"), "candidate")).alias("resolved"))
    return rows.select("row_id").join(direct.unionByName(best.select("row_id", "resolved", F.lit("speaker").alias("how"))), "row_id", "left")


def find_video(recordings: DataFrame, files: DataFrame) -> DataFrame:
    """The video of each recording: names are tried in order (as is, without task, upper case) with each extension.

    recordings has name; files has path. Names are compared as stems, so the probing is one join.
    """
    stem = lambda c: F.lower(F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"\.[^.]*$", ""))
    extension = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    videos = files.select("path", stem(F.col("path")).alias("stem"), F.array_position(F.array(*map(F.lit, ("mp4", "mov", "avi", "mkv"))), extension).alias("kind")).where("kind > 0")
    own = stem(F.concat("name", F.lit(".")))
    variants = F.array_distinct(F.array(own, F.regexp_replace(own, r"_[^_]*$", ""), F.replace(own, F.lit("-"), F.lit("_"))))
    tried = recordings.select("name", F.posexplode(variants).alias("priority", "stem"))
    return recordings.join(tried.join(videos, "stem").groupBy("name").agg(F.min_by("path", F.struct("priority", "kind", "path")).alias("path")), "name", "left")


def latest_roster(sheet: DataFrame) -> DataFrame:
    """A sheet's rows with block headers and pair labels carried down; rows have n, prefecture, pair, signer, age, gender."""
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    filled = sheet.withColumn("prefecture", F.last(F.nullif(F.trim("prefecture"), F.lit("")), True).over(w))
    within = Window.partitionBy("prefecture").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    filled = filled.withColumn("pair", F.last(F.nullif(F.trim("pair"), F.lit("")), True).over(within))
    ages = Window.partitionBy("prefecture", "pair").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumn("age", F.last("age", True).over(ages)).where(F.trim(F.coalesce("signer", F.lit(""))) != "")
