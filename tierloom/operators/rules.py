"""All audit rules over word tiers in one scan, and the list of what to do about their findings.

Tiers have recording, path, tier_id, participant and n (annotations that are filled in); one document is a path. The
scan's rows meet once by document, which leaves one row for each label of a document, cut into the shared folder; every rule is
a condition on that row, an entry of one array that is exploded. What needs the whole corpus (copies of a recording, all labels
of a signer) is aggregated from the same rows.

Defined cases: null ids and attributes count as blank; a romanised tier is no word tier; a tier without a name before its
marker is named by its attribute, and without both is under the blank name, which breaks no rule on names; repeated rows
of a tier are one tier whose annotations add up; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import participant_of_tier, signer_stem, strip
from .audit import to_do_by_signer, word_variant
from .relations import _cut

# The problems' names, their ranks, categories and what to do about them.
SEVERAL_PLACES = "recording in several places"
VARIANTS = "word tier variants"
SEVERAL_LABELS = "signer written several ways"
SPELLINGS = "several spellings in one file"
OTHER_RECORDING = "signer from another recording"
DISAGREE = "tier name and PARTICIPANT disagree"
NO_AGE_GENDER = "no age/gender in the ID"
NOT_IN_SHEET = "not in the spreadsheet"
AGE = "age contradicts the spreadsheet"
GENDER = "gender contradicts the spreadsheet"
PER_TIER = {OTHER_RECORDING: (1, "Identity"), SPELLINGS: (3, "One person, two tiers"), DISAGREE: (4, "Name vs PARTICIPANT")}
PER_SIGNER = {GENDER: (5, "Gender vs sheet"), AGE: (6, "Age vs sheet")}
UNREADABLE = (2, "Unreadable gloss")
ACTIONS = {
    "Identity": "Confirm whose signing this is, then rename or delete the tier",
    "Unreadable gloss": "Move the content into the Word-jp tier, or rename the variant tier",
    "One person, two tiers": "Decide which tier is correct, then merge or delete the other",
    "Name vs PARTICIPANT": "Make the tier name and the PARTICIPANT attribute agree",
    "Gender vs sheet": "Check the person, then correct either the tier names or the spreadsheet",
    "Age vs sheet": "Check the person, then correct either the tier names or the spreadsheet",
}
_PAIR = r"^\d?([A-Za-z]{2})_(\d+)-(\d+)"
_AGE_GENDER = r"(?<!\d)(\d{2})\s*([MFmf])(?![A-Za-z0-9])"


def age_in(name: Column) -> Column:
    """Two digits before a gender letter in a name, null without both."""
    return F.nullif(F.regexp_extract(name, _AGE_GENDER, 1), F.lit(""))


def gender_in(name: Column) -> Column:
    """The gender letter after an age in a name, in upper case, null without both."""
    return F.nullif(F.upper(F.regexp_extract(name, _AGE_GENDER, 2)), F.lit(""))


def word_tiers(tiers: DataFrame) -> DataFrame:
    """Word tiers that are not romanised, with label (whose they are), signer, variant and attribute."""
    tier, attribute = F.coalesce("tier_id", F.lit("")), strip(F.coalesce("participant", F.lit("")))
    named = tiers.select("recording", "path", tier.alias("tier_id"), attribute.alias("attribute"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    words = named.withColumn("variant", word_variant(F.col("tier_id"))).where(F.col("variant").isNotNull() & ~F.lower("tier_id").contains("roman"))
    name = participant_of_tier(F.col("tier_id"))
    return words.withColumn("label", F.when(name != "", name).otherwise(F.col("attribute"))).withColumn("signer", signer_stem(F.col("label")))


def _finding(condition: Column, problem: Column | str, detail: Column, tiers: Column) -> Column:
    """An array with the finding where the condition holds, else empty."""
    row = F.struct((F.lit(problem) if isinstance(problem, str) else problem).alias("problem"), detail.alias("detail"), tiers.alias("tiers"))
    return F.when(condition, F.array(row)).otherwise(F.array().cast("array<struct<problem:string,detail:string,tiers:string>>"))


def _by_label(words: DataFrame) -> DataFrame:
    """One row for each label of a document, with what its signer and its document hold besides."""
    dealt = words.repartition("recording", "path")
    tier = F.struct("tier_id", "attribute", "variant", "n")
    once = dealt.groupBy("recording", "path", "signer", "label", "tier_id", "attribute", "variant").agg(F.sum("n").alias("n"))
    labels = once.groupBy("recording", "path", "signer", "label").agg(F.array_sort(F.collect_list(tier)).alias("held"))
    labels = labels.withColumn("ids", F.array_sort(F.array_distinct(F.transform("held", lambda x: x["tier_id"]))))
    signer, document = Window.partitionBy("recording", "path", "signer"), Window.partitionBy("recording", "path")
    return labels.select(
        "*",
        F.array_sort(F.collect_list("label").over(signer)).alias("spellings"),
        F.array_sort(F.flatten(F.collect_list("ids").over(signer))).alias("signer_ids"),
        (F.row_number().over(signer.orderBy("label")) == 1).alias("first_of_signer"),
        F.flatten(F.collect_list("held").over(document)).alias("all_held"),
        (F.row_number().over(document.orderBy("signer", "label")) == 1).alias("first_of_document"),
    )


def variant_counts(held: Column) -> Column:
    """variant=annotations of each variant among tiers of a document, in order; empty without any."""
    named = F.array_distinct(F.transform(F.filter(held, lambda x: x["variant"] != ""), lambda x: x["variant"]))
    total = lambda v: F.aggregate(F.filter(held, lambda x: x["variant"] == v), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return F.array_join(F.transform(F.array_sort(named), lambda v: F.concat(v, F.lit("="), total(v).cast("string"))), " ")


def findings(tiers: DataFrame, roster: DataFrame) -> DataFrame:
    """Everything wrong with word tiers and whom they name: recording, path, signer, problem, detail and tiers.

    The roster has signer (XX_NN, one row each), age and gender. A finding about a document's signer stands once for the
    signer, one about a spelling once for the spelling, one about a tier once for the tier.
    """
    labels = _cut(_by_label(word_tiers(tiers)))
    copies = labels.where("first_of_document").groupBy("recording").agg(F.count("*").alias("copies"))
    ways = labels.groupBy("signer", "label").agg(F.count("*").alias("n")).groupBy("signer").agg(F.array_sort(F.collect_list("label")).alias("ways"))
    sheet = roster.select(F.col("signer"), F.coalesce(strip(F.col("age").cast("string")), F.lit("")).alias("sheet_age"), F.upper(F.coalesce(strip(F.col("gender")), F.lit(""))).alias("sheet_gender"), F.lit(True).alias("in_sheet"))
    rows = labels.join(copies, "recording", "left").join(ways, "signer", "left").join(sheet, "signer", "left")

    recording, signer, label = F.col("recording"), F.col("signer"), F.col("label")
    ids, signer_ids = F.array_join("ids", " "), F.array_join("signer_ids", " ")
    member = lambda k: signer_stem(F.concat(F.regexp_extract(recording, _PAIR, 1), F.lit("_"), F.regexp_extract(recording, _PAIR, k)))
    pair = F.array_sort(F.array_distinct(F.array(member(2), member(3))))
    elsewhere = recording.rlike(_PAIR) & signer.rlike(r"^[A-Z]{2}_\d+$") & ~F.array_contains(pair, signer)
    known, first = F.coalesce("in_sheet", F.lit(False)), F.col("first_of_signer")
    age, gender = age_in(label), gender_in(label)
    says = lambda field, own: F.concat(label, F.lit(" says "), own, F.lit(", sheet says "), field)
    variants = variant_counts(F.col("all_held"))

    def disagreement(x: Column) -> Column:
        own = participant_of_tier(x["tier_id"])
        problem = F.concat(F.lit(DISAGREE), F.when(signer_stem(own) == signer_stem(x["attribute"]), "").otherwise(" (different signer)"))
        return F.struct(problem.alias("problem"), F.concat(F.lit("name says "), own, F.lit(", PARTICIPANT says "), x["attribute"]).alias("detail"), x["tier_id"].alias("tiers"))

    disagree = F.filter("held", lambda x: (x["attribute"] != "") & (participant_of_tier(x["tier_id"]) != "") & (x["attribute"] != participant_of_tier(x["tier_id"])))
    numbered = F.concat(F.array_position("ways", label).cast("string"), F.lit(" of "), F.size("ways").cast("string"), F.lit(": "), label)
    rules = F.concat(
        _finding(F.col("first_of_document") & (F.col("copies") > 1), SEVERAL_PLACES, F.concat(F.col("copies").cast("string"), F.lit(" copies")), F.lit("")),
        _finding(F.col("first_of_document") & (variants != ""), VARIANTS, variants, F.lit("")),
        _finding((signer != "") & (F.size("ways") > 1), SEVERAL_LABELS, numbered, ids),
        _finding((signer != "") & first & (F.size("spellings") > 1), SPELLINGS, F.array_join("spellings", " / "), signer_ids),
        _finding(first & elsewhere, OTHER_RECORDING, F.concat(F.lit("this recording is "), F.array_join(pair, " and ")), signer_ids),
        F.transform(disagree, disagreement),
        _finding(age.isNull() & known & (label != signer), NO_AGE_GENDER, label, ids),
        _finding(age.isNotNull() & ~known, NOT_IN_SHEET, label, ids),
        _finding(age.isNotNull() & known & (F.col("sheet_age") != "") & (age != F.col("sheet_age")), AGE, says(F.col("sheet_age"), age), ids),
        _finding(age.isNotNull() & known & (F.col("sheet_gender") != "") & (gender != F.col("sheet_gender")), GENDER, says(F.col("sheet_gender"), gender), ids),
    )
    whole = F.when(F.col("f.problem").isin(SEVERAL_PLACES, VARIANTS), "").otherwise(signer)
    return rows.select("recording", "path", signer.alias("signer"), F.explode(rules).alias("f")).select("recording", "path", whole.alias("signer"), "f.*")


def unread_files(tiers: DataFrame) -> DataFrame:
    """Documents whose plain word tiers are empty while a variant has annotations: recording, path, variants, unread."""
    words = word_tiers(tiers).repartition("recording", "path")
    named = F.col("variant") != ""
    each = words.groupBy("recording", "path").agg(F.array_sort(F.collect_set(F.when(named, F.col("variant")))).alias("v"), F.sum(F.when(named, F.col("n")).otherwise(0)).alias("unread"), F.sum(F.when(named, 0).otherwise(F.col("n"))).alias("plain"))
    return each.where((F.size("v") > 0) & (F.col("plain") == 0)).select("recording", "path", F.array_join("v", " ").alias("variants"), "unread")


def to_do_list(found: DataFrame, unread: DataFrame, roster: DataFrame, selected: DataFrame) -> DataFrame:
    """One row for each decision that a person has to make, with rank, what the sheet says and what to do.

    Problems of identity stand once for each tier of a recording, by the first of its findings; contradictions of age or
    gender once for a signer. ``selected`` lists recordings in use. The order of work is ``to_do_order``.
    """
    spark = found.sparkSession
    ranks = spark.createDataFrame([(p, r, c, k == 0) for k, x in enumerate((PER_TIER, PER_SIGNER)) for p, (r, c) in x.items()], "problem string, rank int, category string, by_tier boolean")
    used = selected.select("recording").distinct().withColumn("used", F.lit(True))
    ranked = found.join(F.broadcast(ranks), "problem").join(used, "recording", "left")
    order = F.struct("problem", "signer", "recording", "path", "detail")
    tiers = ranked.where("by_tier").select("rank", "category", "recording", "signer", "detail", "used", F.explode(F.split("tiers", " ")).alias("tier"), order.alias("at"))
    by_tier = tiers.groupBy("rank", "category", "recording", "tier").agg(F.min_by("signer", "at").alias("signer"), F.min_by("detail", "at").alias("problem"), F.max("used").alias("used"))
    # The last detail in the order of the findings stands for a signer.
    people = ranked.where("NOT by_tier").select(order.alias("n"), "rank", "category", "signer", "recording", "detail", F.explode(F.split("tiers", " ")).alias("tier_id"))
    # A row of a signer names several recordings; one that is in use is enough. The long list of them stands in one row and is
    # not carried through a join for each of its members.
    in_use = ranked.where("NOT by_tier").groupBy("category", "signer", "rank").agg(F.max("used").alias("used"))
    by_signer = to_do_by_signer(people).join(in_use, ["category", "signer", "rank"])
    pair = F.regexp_extract("recording", _PAIR, 2), F.regexp_extract("recording", _PAIR, 3)
    prefix = F.regexp_extract("recording", _PAIR, 1)
    both = F.when(prefix != "", F.concat(prefix, F.lit("_"), pair[0], F.lit(" and "), prefix, F.lit("_"), pair[1])).otherwise("")
    told = F.concat(F.lit("gloss is on "), F.col("variants"), F.lit(" instead; "), F.col("unread").cast("string"), F.lit(" annotations unread"))
    files = unread.join(used, "recording", "left").select(F.lit(UNREADABLE[0]).alias("rank"), F.lit(UNREADABLE[1]).alias("category"), "recording", F.lit("all Word-jp tiers are empty").alias("tier"), both.alias("signer"), told.alias("problem"), "used")
    rows = by_tier.unionByName(by_signer).unionByName(files)

    says = F.concat(F.lit("age "), F.coalesce(F.col("age").cast("string"), F.lit("")), F.lit(", "), F.coalesce("gender", F.lit("")))
    sheet = roster.select("signer", says.alias("says"))
    rows = rows.join(sheet, "signer", "left").withColumn("spreadsheet", F.when(F.col("category") == UNREADABLE[1], "").otherwise(F.coalesce("says", F.lit("not in spreadsheet")))).drop("says")
    action = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return rows.select("rank", "category", "signer", "recording", "tier", "problem", "spreadsheet", F.when(F.col("used"), "yes").otherwise("no").alias("in_selection"), action[F.col("category")].alias("action"))


def to_do_order(rows: DataFrame) -> DataFrame:
    """The order of work: rank, signer, recording; then tier, so that ties have one."""
    return rows.orderBy("rank", "signer", "recording", "tier")


def problem_totals(found: DataFrame) -> DataFrame:
    """How many findings, signers and documents each problem has."""
    by_pair = found.groupBy("problem", "signer", "path").agg(F.count("*").alias("n"))
    signers = by_pair.groupBy("problem", "signer").agg(F.sum("n").alias("n")).groupBy("problem").agg(F.sum("n").alias("n_findings"), F.count_if(F.col("signer") != "").alias("n_signers"))
    documents = by_pair.select("problem", "path").distinct().groupBy("problem").agg(F.count("*").alias("n_documents"))
    return signers.join(documents, "problem")
