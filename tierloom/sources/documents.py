"""Annotation documents in XML: tiers, annotations, times, indexes, and documents written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import alnum_lower, file_key, participant_of_tier, region_of, strip
from ..operators.relations import broken_parents, broken_references, fullest_tier, inherited_times, tier_closure

# What marks tiers of words and of mouth actions, and the three mouth categories.
WORD_TIER, MOUTH_HINTS, WORD_HINTS = "wordjp", ("mouthaction", "mouthact", "ma"), ("wordjp", "jpword", "wordjapanese")
SCHEMA = """TIME_ORDER STRUCT<TIME_SLOT: ARRAY<STRUCT<_TIME_SLOT_ID: STRING, _TIME_VALUE: STRING>>>,
  TIER ARRAY<STRUCT<_TIER_ID: STRING, _PARTICIPANT: STRING, _LINGUISTIC_TYPE_REF: STRING, _PARENT_REF: STRING, ANNOTATION: ARRAY<STRUCT<
    ALIGNABLE_ANNOTATION: STRUCT<_ANNOTATION_ID: STRING, _TIME_SLOT_REF1: STRING, _TIME_SLOT_REF2: STRING, ANNOTATION_VALUE: STRING>,
    REF_ANNOTATION: STRUCT<_ANNOTATION_ID: STRING, _ANNOTATION_REF: STRING, ANNOTATION_VALUE: STRING>>>>>,
  LINGUISTIC_TYPE ARRAY<STRUCT<_LINGUISTIC_TYPE_ID: STRING, _CONTROLLED_VOCABULARY_REF: STRING, _CONSTRAINTS: STRING>>, _corrupt_record STRING"""


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document; unreadable ones have their text in _corrupt_record. The schema is explicit, as one annotation would else read as a struct."""
    raw = spark.read.format("xml").option("rowTag", "ANNOTATION_DOCUMENT").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").schema(SCHEMA).load(path)
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1).alias("doc"), "*")


def annotations(documents: DataFrame) -> DataFrame:
    """Every annotation with its tier; own times come from the document's slots, in order, and others are inherited.

    Half an interval is none, and the earlier end comes first; start_slot and end_slot keep the slots' times as they are.
    """
    slots = F.map_from_entries(F.transform(F.coalesce("TIME_ORDER.TIME_SLOT", F.array()), lambda s: F.struct(s["_TIME_SLOT_ID"], s["_TIME_VALUE"])))
    tier = documents.select("doc", slots.alias("slots"), F.explode("TIER").alias("t"))
    rows = tier.select("doc", "slots", F.col("t._TIER_ID").alias("tier_id"), F.col("t._PARTICIPANT").alias("participant"), F.posexplode("t.ANNOTATION").alias("position", "a"))
    own, ref = F.col("a.ALIGNABLE_ANNOTATION"), F.col("a.REF_ANNOTATION")
    at = lambda name: F.try_element_at("slots", own[name]).try_cast("double")
    one, two = at("_TIME_SLOT_REF1"), at("_TIME_SLOT_REF2")
    timed = one.isNotNull() & two.isNotNull()  # half an interval is none
    s, e = F.when(timed, F.least(one, two)), F.when(timed, F.greatest(one, two))
    flat = rows.select("doc", "tier_id", "participant", "position", F.coalesce(own["_ANNOTATION_ID"], ref["_ANNOTATION_ID"]).alias("id"), ref["_ANNOTATION_REF"].alias("ref"), s.alias("start_ms"), e.alias("end_ms"), one.alias("start_slot"), two.alias("end_slot"), own.isNotNull().alias("alignable"), F.coalesce(own["ANNOTATION_VALUE"], ref["ANNOTATION_VALUE"], F.lit("")).alias("value"))
    times = inherited_times(flat.select("doc", "id", "ref", "start_ms", "end_ms"))
    return flat.drop("start_ms", "end_ms").join(times, ["doc", "id"])


def is_word_tier(tier: Column) -> Column:
    """A tier of words: its id ends with the marker."""
    return alnum_lower(tier).endswith(WORD_TIER)


def is_word_variant(tier: Column) -> Column:
    """A tier id that holds the marker but goes on."""
    return alnum_lower(tier).contains(WORD_TIER) & ~is_word_tier(tier)


def mentions(values: list[Column], hints: tuple[str, ...]) -> Column:
    """Any of the values holds a hint; hints of two letters must be a whole part."""
    out = F.lit(False)
    for v in values:
        text = F.coalesce(v, F.lit(""))
        for h in hints:
            out = out | (alnum_lower(text).contains(h) if len(h) > 2 else F.array_contains(F.split(F.lower(text), "[^a-z0-9]+"), h))
    return out


def mouth_tiers(documents: DataFrame) -> DataFrame:
    """Mouth tiers and all tiers below them."""
    kinds = F.map_from_entries(F.transform(F.coalesce("LINGUISTIC_TYPE", F.array()), lambda t: F.struct(t["_LINGUISTIC_TYPE_ID"], t["_CONTROLLED_VOCABULARY_REF"])))
    t = documents.select("doc", kinds.alias("kinds"), F.explode("TIER").alias("t")).select("doc", F.col("t._TIER_ID").alias("tier_id"), F.col("t._PARENT_REF").alias("parent"), F.col("t._LINGUISTIC_TYPE_REF").alias("kind"), F.try_element_at("kinds", F.col("t._LINGUISTIC_TYPE_REF")).alias("vocabulary"))
    return tier_closure(t, mentions([F.col(c) for c in ("tier_id", "kind", "parent", "vocabulary")], MOUTH_HINTS))


def classify_mouth(value: Column) -> Column:
    """Mouth category of a label; blanks have none."""
    v = alnum_lower(value)
    return F.when(strip(F.coalesce(value, F.lit(""))) == "", F.lit(None).cast("string")).when(v.contains("mouthgesture") | v.contains("gesture") | (v == "mg"), "MouthGesture").when(v.contains("mouthing") | (v == "m"), "Mouthing").otherwise("Others")


def word_annotations(documents: DataFrame, speakers: list[str] | None = None) -> DataFrame:
    """Non-blank word annotations, one tier per signer: file_id, tier_id, start_ms, end_ms, annotation, as text.

    Times are those of the slots, either of which may be unknown.

    Order for reading: file, tier, start (unknown first), position.
    """
    slots = annotations(documents).withColumns({"start_ms": F.col("start_slot"), "end_ms": F.col("end_slot")})
    rows = slots.where(F.col("alignable") & is_word_tier(F.col("tier_id")) & (strip(F.col("value")) != "")).withColumn("signer", F.upper(participant_of_tier(F.col("tier_id"))))
    if speakers:
        rows = rows.where(F.col("signer").isin(*[s.upper() for s in speakers]))
    kept = fullest_tier(rows.groupBy("doc", "signer", "tier_id").agg(F.count("*").alias("n"))).select("doc", "tier_id")
    ms = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(""))
    out = rows.join(kept, ["doc", "tier_id"], "left_semi").orderBy("doc", "tier_id", F.coalesce("start_ms", F.lit(-1.0)), "position")
    return out.select(F.regexp_replace("doc", r"\.[^.]*$", "").alias("file_id"), "tier_id", ms("start_ms").alias("start_ms"), ms("end_ms").alias("end_ms"), strip(F.col("value")).alias("annotation"))


def index(documents: DataFrame) -> DataFrame:
    """One row per readable document: length, tiers, mouth and word annotations, participants."""
    good = documents.where("_corrupt_record IS NULL AND TIER IS NOT NULL")
    length = F.array_max(F.transform(F.coalesce("TIME_ORDER.TIME_SLOT", F.array()), lambda s: s["_TIME_VALUE"].try_cast("double")))
    base = good.select("doc", F.coalesce(length, F.lit(0.0)).alias("duration_ms"), F.size("TIER").alias("n_tiers"), F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("TIER", lambda t: t["_PARTICIPANT"]), lambda p: p.isNotNull() & (p != "")))), ";").alias("participants"))
    mouth = mouth_tiers(good).withColumn("mouth", F.lit(True))
    rows = annotations(good).join(mouth, ["doc", "tier_id"], "left")
    counts = rows.groupBy("doc").agg(F.count_if("mouth").alias("n_mouth_annotations"), F.count_if(mentions([F.col("tier_id")], WORD_HINTS)).alias("n_word_annotations"))
    tiers = mouth.groupBy("doc").agg(F.count("*").alias("n_mouth_tiers"), F.array_join(F.array_sort(F.collect_list("tier_id")), ";").alias("mouth_tier_ids"))
    out = base.join(counts, "doc", "left").join(tiers, "doc", "left").na.fill(0, ["n_mouth_annotations", "n_word_annotations", "n_mouth_tiers"]).na.fill("", ["mouth_tier_ids"])
    return out.withColumns({"file_key": file_key(F.col("doc")), "region_code": region_of(F.col("doc")), "has_mouth_tiers": F.col("n_mouth_tiers") > 0})


def flagged_documents(spark: SparkSession, index_: DataFrame, flag: str = "has_mouth_tiers") -> DataFrame:
    """Only the documents that an index flags, read from their paths; index_ has path and the flag, of any type.

    The list of files is collected, as a reader needs it; it names files of one corpus and not annotations.
    """
    chosen = index_.where(F.lower(F.col(flag).cast("string")).isin("true", "1", "yes")).select("path").distinct()
    paths = [r["path"] for r in chosen.collect()]
    raw = spark.read.format("xml").option("rowTag", "ANNOTATION_DOCUMENT").option("mode", "PERMISSIVE").schema(SCHEMA)
    if not paths:
        return spark.createDataFrame([], f"doc STRING, {SCHEMA}")
    return raw.load(paths).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1).alias("doc"), "*")


def broken(documents: DataFrame) -> DataFrame:
    """What a document refers to and does not have: doc, tier_id, id (null for tiers) and missing."""
    refs = documents.select("doc", F.explode("TIER").alias("t")).select("doc", F.col("t._TIER_ID").alias("tier_id"), F.col("t._PARENT_REF").alias("parent"), F.explode_outer("t.ANNOTATION").alias("a"))
    rows = refs.select("doc", "tier_id", F.coalesce("a.ALIGNABLE_ANNOTATION._ANNOTATION_ID", "a.REF_ANNOTATION._ANNOTATION_ID").alias("id"), F.nullif(F.col("a.REF_ANNOTATION._ANNOTATION_REF"), F.lit("")).alias("ref"))
    missing = broken_references(rows.where("id IS NOT NULL")).join(rows.select("doc", "id", "tier_id"), ["doc", "id"])
    tiers = refs.select("doc", "tier_id", "parent").distinct()
    return missing.select("doc", "tier_id", "id", F.col("ref").alias("missing")).unionByName(broken_parents(tiers).select("doc", "tier_id", F.lit(None).cast("string").alias("id"), F.col("parent").alias("missing")))


def unreadable(documents: DataFrame) -> DataFrame:
    """Documents that could not be read."""
    return documents.where("_corrupt_record IS NOT NULL OR TIER IS NULL").select("doc")


def enriched(spark: SparkSession, path: str, cells: DataFrame) -> DataFrame:
    """Documents (doc, content) with a child tier for each column of cells (doc, parent, column, cell).

    New annotations refer to their parents and take the next free numbers. A document is small and is
    written by one task with all its cells.
    """
    per_doc = cells.groupBy("doc").agg(F.collect_list(F.struct("parent", "column", "cell")).alias("cells"))
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("doc"), "content")

    @F.pandas_udf("string")
    def add(content, cells):
        return content.combine(cells, lambda data, found: add_tiers(data, list(found) if found is not None else []))

    return files.join(per_doc, "doc", "left").select("doc", add("content", "cells").alias("content"))


def add_tiers(data: bytes, cells: list[dict]) -> str:
    """One document's XML with child tiers for (parent annotation, column, cell).

    Tier ids are unique: where a document has the name already, a number follows it. New tiers stand after the
    others and their type after the types, as the schema orders them. A document that refers to an annotation or
    tier that it lacks raises ValueError: it is not written on.
    """
    import xml.etree.ElementTree as ET

    root = ET.fromstring(data)
    names = {t.get("TIER_ID") for t in root.iter("TIER")}
    tier_of = {a[0].get("ANNOTATION_ID"): t for t in root.iter("TIER") for a in t.iter("ANNOTATION") if len(a)}
    numbers = [int(i[2:]) for i in tier_of if i.startswith("pa") and i[2:].isdigit()]
    lost = [r.get("ANNOTATION_REF") for r in root.iter("REF_ANNOTATION") if r.get("ANNOTATION_REF") and r.get("ANNOTATION_REF") not in tier_of]
    lost += [p for t in root.iter("TIER") if (p := t.get("PARENT_REF")) and p not in names]
    if lost:
        raise ValueError(f"references to what the document lacks: {sorted(set(lost))[:5]}")
    number, made = max(numbers, default=0), {}
    types = {t.get("LINGUISTIC_TYPE_ID") for t in root.iter("LINGUISTIC_TYPE")}
    for c in sorted(cells, key=lambda c: (c["column"], c["parent"])):
        parent = tier_of.get(c["parent"])
        if parent is None or not c["cell"]:
            continue
        key = (parent.get("TIER_ID"), c["column"])
        if key not in made:
            name = f"{key[0]}_{key[1]}"
            name = next(n for n in (name, *(f"{name}_{i}" for i in range(2, len(names) + 3))) if n not in names)
            names.add(name)
            made[key] = ET.Element("TIER", {"TIER_ID": name, "LINGUISTIC_TYPE_REF": "parsed", "PARENT_REF": key[0], **({"PARTICIPANT": p} if (p := parent.get("PARTICIPANT")) else {})})
        number += 1
        node = ET.SubElement(ET.SubElement(made[key], "ANNOTATION"), "REF_ANNOTATION", {"ANNOTATION_ID": f"pa{number}", "ANNOTATION_REF": c["parent"]})
        ET.SubElement(node, "ANNOTATION_VALUE").text = c["cell"]
    last = max((i for i, e in enumerate(root) if e.tag == "TIER"), default=len(root) - 1)
    for offset, tier in enumerate(made.values(), 1):
        root.insert(last + offset, tier)
    if made and "parsed" not in types:
        kinds = [i for i, e in enumerate(root) if e.tag == "LINGUISTIC_TYPE"]
        root.insert(kinds[-1] + 1 if kinds else last + len(made) + 1, ET.Element("LINGUISTIC_TYPE", {"LINGUISTIC_TYPE_ID": "parsed", "TIME_ALIGNABLE": "false", "CONSTRAINTS": "Symbolic_Association"}))
    return ET.tostring(root, encoding="unicode", xml_declaration=True)
