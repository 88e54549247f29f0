"""Queries of selections, report orders and further audits, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as au
from ..operators import corpus
from ..operators import relations as rel
from ..operators import selection as sel
from ..operators import space as sp
from .corpus_queries import ORACLE_SQL as _CORPUS
from .adapters import CLIPS, MARKED, TOKENS, clips, marked, read, tokens


def _paths(spark, sf_dir):
    task = F.element_at(F.array(*map(F.lit, ("AniN", "cur", "Draft", "ReS"))), (F.col("page_id") % 4 + 1).cast("int"))
    region = F.when(F.col("page_id") % 3 == 0, F.lit("Fukuoka")).otherwise(F.format_string("%02d_Region", F.col("page_id") % 47))
    return read(spark, sf_dir, "pages").select("page_id", F.concat_ws("/", F.lit("corpus"), region, task, F.format_string("fo_%d.eaf", F.col("page_id"))).alias("path"))


def selection_manifest(spark, sf_dir):
    """Pages as documents in folders of regions and tasks."""
    return sel.manifest(_paths(spark, sf_dir))


def manifest_missing(spark, sf_dir):
    """Listed paths that no file has: every seventh file is gone."""
    paths = _paths(spark, sf_dir)
    return sel.listed(paths.select("path"), paths.where("page_id % 7 <> 0"))[1]


def selected_rows(spark, sf_dir):
    """lineitem annotations by keyword; lexical items only without any marker."""
    rows = sel.select_rows(marked(spark, sf_dir), ("lexical_item", "cl", "fs", "pt"), lexical_only=True)
    return rows.groupBy("keyword", "region_code").agg(F.count("*").alias("n"), F.count_distinct("annotation").alias("n_annotations"))


def first_clips(spark, sf_dir):
    """The first hundred clips of each keyword."""
    return sel.first_per_keyword(clips(spark, sf_dir), 100, ["clip_id"]).select("keyword", "clip_id")


def loaded_frames(spark, sf_dir):
    """Frames of the clips of some regions, without excluded signers' folders, with labels resolved anew."""
    index = clips(spark, sf_dir).withColumn("clip", F.concat(F.lit("clips/"), "signer_id", F.lit("/"), F.col("clip_id").cast("string"), F.lit(".mp4")))
    frames = read(spark, sf_dir, "events").select(F.col("event_id").alias("clip_id"), F.col("event_id").alias("frame"), F.floor("value").cast("long").alias("n"))
    people = clips(spark, sf_dir).select("signer_id", "age").distinct().select("signer_id", F.when(F.col("age") < 50, "<50").otherwise("50+").alias("age_group"), F.lit("x").alias("age_band"), F.lit("unknown").alias("gender")).dropDuplicates(["signer_id"])
    excluded = spark.createDataFrame([("3", 1), ("clips/17", 2)], "entry string, number long")
    return sel.load_frames(index, frames, people, ["VIEW", "click"], ["r1", "R3"], excluded).select("clip_id", "frame", "n", "keyword", "region_code", "signer_id", "handedness", "age_group")


def exclusion_lists(spark, sf_dir):
    """Nations in upper and mixed case as two exclusion lists that overlap."""
    n = read(spark, sf_dir, "nation")
    one = n.where("n_nationkey < 15").select(F.concat(F.lower("n_name"), F.lit("/1.mp4")).alias("entry"), F.col("n_nationkey").alias("number"))
    two = n.where("n_nationkey > 9").select(F.concat("n_name", F.lit("/1")).alias("entry"), F.col("n_nationkey").alias("number"))
    return sel.merged_exclusions(one, two)


def whole_rows(spark, sf_dir):
    """The whole corpus of a table by region."""
    return sel.whole_rows(corpus.key_counts(corpus.add_flags(marked(spark, sf_dir)))).select("tag", "key", "n_annotations")


def largest_units(spark, sf_dir):
    """Event types as units of a figure, two of them baselines."""
    unit = F.when(F.col("event_type") == "view", "any annotation").when(F.col("event_type") == "error", "lexical_item (no marker)").otherwise(F.concat("event_type", (F.col("user_id") % 9).cast("string")))
    return sel.largest_units(read(spark, sf_dir, "events").groupBy(unit.alias("unit"), F.date_format("ts", "yyyy-MM").alias("tag")).agg(F.count("*").alias("n_labels")))


def lexical_variety(spark, sf_dir):
    """Distinct words per thousand by language."""
    by = tokens(spark, sf_dir).groupBy(F.col("region_code").alias("tag")).agg(F.count_distinct("lexical_item").alias("n_unique_lexical_items"), F.count("*").alias("n_parsed"))
    return sel.variety(by).select("tag", F.round("per_1000", 6).alias("per_1000"))


def top_glosses_report(spark, sf_dir):
    """The most frequent words of two languages, counted for them alone."""
    flagged = corpus.add_flags(tokens(spark, sf_dir))
    return sel.top_glosses_report(flagged, 50, 2, ["en", "fr"]).select("rank", "scope", "min_signers_required", "gloss", "occurrences", "n_signers", "regions")


def overlap_order(spark, sf_dir):
    """Units of events in the order of an overlap table."""
    kind = F.when(F.col("event_type") == "view", "summary").when(F.col("event_type") == "error", "lexical").otherwise("key")
    by = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("unit"), kind.alias("kind")).agg(F.count("*").alias("n_annotations"))
    return by.withColumn("place", sel.place([sel.kind_rank(F.col("kind")), F.desc("n_annotations"), F.col("unit")]))


def summary_order(spark, sf_dir):
    """Regions and hand roles, the roles in the order asked for."""
    by = clips(spark, sf_dir).groupBy("region_code", "hand_role").agg(F.count("*").alias("n_clips"))
    return by.withColumn("place", sel.place([F.col("region_code"), sel.role_rank(F.col("hand_role"), ("non_dominant", "dominant"))]))


def level_order(spark, sf_dir):
    """Age bands and names of levels in their natural order."""
    age = F.col("age")
    level = F.when(age < 30, "<30").when(age < 50, "30-49").when(age < 70, "50+").otherwise(F.col("region_code"))
    return clips(spark, sf_dir).select(level.alias("level")).distinct().withColumn("place", sel.place([sel.level_key(F.col("level")), F.col("level")]))


def _tiers(spark, sf_dir):
    variant = F.when(F.col("user_id") % 5 == 0, "-T").when(F.col("user_id") % 7 == 0, "2").otherwise("")
    tier = F.when(F.col("event_type") == "error", F.lit("Other")).otherwise(F.concat(F.col("event_type"), F.lit("-Word-jp"), variant))
    return read(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("recording"), tier.alias("tier_id"), (F.col("user_id") % 10).alias("signer"), F.concat_ws("_", F.lit("FO"), (F.col("user_id") % 10).cast("string"), F.when(F.col("event_id") % 90 == 0, "x")).alias("label"), "event_id", "user_id")


def audit_variants(spark, sf_dir):
    """Days as recordings whose tiers are variants of the word tier."""
    return au.tier_variants(_tiers(spark, sf_dir).groupBy("recording", "tier_id").agg(F.count("*").alias("n")))


def audit_file_spellings(spark, sf_dir):
    """Signers that a day spells in two ways."""
    return au.spellings_in_one_file(_tiers(spark, sf_dir).select("recording", "signer", "label", "tier_id"))


def audit_names(spark, sf_dir):
    """Tiers whose id names another signer than their participant, or spells it otherwise."""
    s = read(spark, sf_dir, "supplier")
    name = F.format_string("FO_%02d", F.col("s_suppkey") % 40)
    other = F.when(F.col("s_suppkey") % 3 == 0, F.format_string("FO%d", F.col("s_suppkey") % 40)).when(F.col("s_suppkey") % 7 == 0, "NR_01").otherwise(name)
    tiers = s.select(F.col("s_nationkey").alias("doc"), F.concat(name, F.lit("-Word-jp")).alias("tier_id"), other.alias("participant"))
    return au.name_against_attribute(tiers).distinct()


def audit_to_do_signers(spark, sf_dir):
    """Events as findings, one line per signer, category and rank."""
    t = _tiers(spark, sf_dir)
    rank = F.col("event_id") % 3
    return au.to_do_by_signer(t.select(F.col("event_id").alias("n"), rank.alias("rank"), F.concat(F.lit("c"), rank.cast("string")).alias("category"), F.concat(F.lit("s"), "signer").alias("signer"), "recording", "tier_id", F.col("user_id").cast("string").alias("detail")))


def scoreboard_counts(spark, sf_dir):
    """Events as pairs of levels with fixed intervals: how many separate, and how many of the reliable ones."""
    e = read(spark, sf_dir, "events")
    low = F.floor("value") - 2
    return sp.scoreboard(e.select((F.col("user_id") % 9).alias("n_signers_a"), (F.col("event_id") % 8).alias("n_signers_b"), ((low > 0) | (low + F.col("event_id") % 3 < 0)).alias("separates")))


def broken_parents(spark, sf_dir):
    """Suppliers as tiers below others, some of which are gone."""
    s = read(spark, sf_dir, "supplier")
    tier = lambda c: F.concat(F.lit("t"), c.cast("string"))
    parent = F.when(F.col("s_suppkey") % 4 != 0, tier(F.col("s_suppkey") - 3 * (F.col("s_suppkey") % 11))).otherwise("")
    return rel.broken_parents(s.select((F.col("s_suppkey") % 3).alias("doc"), tier(F.col("s_suppkey")).alias("tier_id"), parent.alias("parent")))


QUERIES = {f.__name__: f for f in (selection_manifest, manifest_missing, selected_rows, first_clips, loaded_frames, exclusion_lists, whole_rows, largest_units, lexical_variety, top_glosses_report, overlap_order, summary_order, level_order, audit_variants, audit_file_spellings, audit_names, audit_to_do_signers, scoreboard_counts, broken_parents)}

_PATHS = """paths AS (SELECT page_id, 'corpus/' || CASE WHEN page_id % 3 = 0 THEN 'Fukuoka' ELSE printf('%02d_Region', page_id % 47) END || '/' || ['AniN', 'cur', 'Draft', 'ReS'][page_id % 4 + 1] || '/fo_' || page_id || '.eaf' AS path FROM pages)"""
_TIERS = """tiers AS (SELECT strftime(ts, '%Y-%m-%d') AS recording, CASE WHEN event_type = 'error' THEN NULL WHEN user_id % 5 = 0 THEN '-T' WHEN user_id % 7 = 0 THEN '2' ELSE '' END AS variant,
  CASE WHEN event_type = 'error' THEN 'Other' ELSE event_type || '-Word-jp' || CASE WHEN user_id % 5 = 0 THEN '-T' WHEN user_id % 7 = 0 THEN '2' ELSE '' END END AS tier_id,
  user_id % 10 AS signer, 'FO_' || (user_id % 10) || CASE WHEN event_id % 90 = 0 THEN '_x' ELSE '' END AS label, event_id, user_id FROM events)"""

_KEY_COUNTS = _CORPUS["key_counts"]
ORACLE_SQL = {
    "whole_rows": f"SELECT tag, key, n_annotations FROM ({_KEY_COUNTS}) WHERE tag = 'GLOBAL'",
    "selection_manifest": f"WITH {_PATHS} SELECT 'fo_' || page_id AS stem, 'FO' AS region_code, path, CASE WHEN page_id % 3 <> 0 AND page_id % 4 <> 2 THEN 'yes' ELSE 'no' END AS in_task_folder FROM paths",
    "manifest_missing": f"WITH {_PATHS} SELECT path FROM paths WHERE page_id % 7 = 0",
    "selected_rows": f"""WITH {MARKED}, k AS (
      SELECT 'lexical_item' AS keyword, * FROM marked WHERE has_lexical AND n_keys = 0 AND NOT is_compound AND NOT is_ambiguous
      UNION ALL SELECT 'cl', * FROM marked WHERE cl = '1' UNION ALL SELECT 'pt', * FROM marked WHERE pt = '1')
    SELECT keyword, region_code, count(*) AS n, count(DISTINCT annotation) AS n_annotations FROM k GROUP BY 1, 2""",
    "first_clips": f"WITH {CLIPS} SELECT keyword, clip_id FROM clips QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY clip_id) <= 100",
    "loaded_frames": f"""WITH {CLIPS} SELECT clip_id, clip_id AS frame, CAST(floor(value) AS BIGINT) AS n, keyword, region_code, signer_id, handedness, CASE WHEN age < 50 THEN '<50' ELSE '50+' END AS age_group
    FROM clips JOIN events ON event_id = clip_id WHERE keyword IN ('view', 'click') AND region_code IN ('R1', 'R3') AND signer_id NOT IN ('3', '17') AND clip_id <> 3""",
    "exclusion_lists": """WITH e AS (SELECT lower(n_name) || '/1.mp4' AS entry, 0 AS list, n_nationkey AS line FROM nation WHERE n_nationkey < 15 UNION ALL SELECT n_name || '/1', 1, n_nationkey FROM nation WHERE n_nationkey > 9)
    SELECT lower(replace(entry, '.mp4', '')) AS key, arg_min(entry, (list, line)) AS entry, min(list) AS list, arg_min(line, (list, line)) AS line FROM e GROUP BY 1""",
    "largest_units": """WITH u AS (SELECT event_type || (user_id % 9) AS unit FROM events WHERE event_type NOT IN ('view', 'error')) SELECT unit, count(*) AS n_labels FROM u GROUP BY 1 HAVING count(*) >= 20 ORDER BY n_labels DESC, unit LIMIT 12""",
    "lexical_variety": f"WITH {TOKENS} SELECT region_code AS tag, round(1000e0 * count(DISTINCT lexical_item) / count(*), 6) AS per_1000 FROM tokens GROUP BY 1",
    "top_glosses_report": f"""WITH {TOKENS}, s AS (SELECT lexical_item AS gloss, count(*) AS occurrences, count(DISTINCT speaker_id) AS n_signers, string_agg(DISTINCT region_code, ';' ORDER BY region_code) AS regions FROM tokens WHERE region_code IN ('en', 'fr') GROUP BY 1)
    SELECT row_number() OVER (ORDER BY occurrences DESC, n_signers DESC, gloss) AS rank, 'en;fr' AS scope, 2 AS min_signers_required, * FROM s WHERE n_signers >= 2 QUALIFY rank <= 50""",
    "overlap_order": """WITH u AS (SELECT event_type AS unit, CASE WHEN event_type = 'view' THEN 'summary' WHEN event_type = 'error' THEN 'lexical' ELSE 'key' END AS kind, count(*) AS n_annotations FROM events GROUP BY 1)
    SELECT *, row_number() OVER (ORDER BY CASE kind WHEN 'summary' THEN 0 WHEN 'lexical' THEN 1 ELSE 2 END, n_annotations DESC, unit) AS place FROM u""",
    "summary_order": f"WITH {CLIPS}, u AS (SELECT region_code, hand_role, count(*) AS n_clips FROM clips GROUP BY 1, 2) SELECT *, row_number() OVER (ORDER BY region_code, hand_role = 'dominant') AS place FROM u",
    "level_order": f"""WITH {CLIPS}, u AS (SELECT DISTINCT CASE WHEN age < 30 THEN '<30' WHEN age < 50 THEN '30-49' WHEN age < 70 THEN '50+' ELSE region_code END AS level FROM clips),
      k AS (SELECT level, TRY_CAST(regexp_replace(level, '[^0-9]', '', 'g') AS BIGINT) AS years FROM u) SELECT level, row_number() OVER (ORDER BY years, level NOT LIKE '<%', level) AS place FROM k""",
    "audit_variants": f"""WITH {_TIERS}, e AS (SELECT recording, variant, count(DISTINCT tier_id) AS t, count(*) AS n FROM tiers WHERE variant IS NOT NULL GROUP BY 1, 2)
    SELECT recording, string_agg(variant, ' ' ORDER BY variant) FILTER (WHERE variant <> '') AS variants, sum(t) FILTER (WHERE variant <> '') AS n_variant_tiers, string_agg(variant || '=' || n, ' ' ORDER BY variant) FILTER (WHERE variant <> '') AS annotations_by_variant,
      sum(n) FILTER (WHERE variant <> '') AS variant_annotations, coalesce(sum(n) FILTER (WHERE variant = ''), 0) AS plain_word_jp_annotations FROM e GROUP BY 1 HAVING count(*) FILTER (WHERE variant <> '') > 0""",
    "audit_file_spellings": f"WITH {_TIERS} SELECT recording, signer, string_agg(DISTINCT label, ' / ' ORDER BY label) AS detail, string_agg(DISTINCT tier_id, ' ' ORDER BY tier_id) AS tiers FROM tiers GROUP BY 1, 2 HAVING count(DISTINCT label) > 1",
    "audit_names": """WITH x AS (SELECT s_nationkey AS doc, s_suppkey AS k, s_suppkey % 40 AS m FROM supplier) SELECT DISTINCT doc, printf('FO_%02d-Word-jp', m) AS tier_id, CASE WHEN k % 3 = 0 THEN 'FO' || m ELSE 'NR_01' END AS participant,
      CASE WHEN k % 3 = 0 THEN 'same signer' ELSE 'different signer' END AS problem FROM x WHERE k % 3 = 0 OR k % 7 = 0""",
    "audit_to_do_signers": f"""WITH {_TIERS} SELECT event_id % 3 AS rank, 'c' || (event_id % 3) AS category, string_agg(DISTINCT recording, ', ' ORDER BY recording) AS recording,
      count(DISTINCT tier_id) || ' tier(s): ' || array_to_string(list_sort(list(DISTINCT tier_id))[1:3], ' ') || CASE WHEN count(DISTINCT tier_id) > 3 THEN ' ...' ELSE '' END AS tier, 's' || signer AS signer, arg_max(CAST(user_id AS VARCHAR), event_id) AS problem
    FROM tiers GROUP BY event_id % 3, signer""",
    "scoreboard_counts": """WITH p AS (SELECT user_id % 9 >= 5 AND event_id % 8 >= 5 AS reliable, floor(value) > 2 OR floor(value) - 2 + event_id % 3 < 0 AS separates FROM events)
    SELECT count(*) AS n_pairs, count(*) FILTER (WHERE separates) AS n_separating, count(*) FILTER (WHERE reliable) AS n_pairs_reliable, count(*) FILTER (WHERE reliable AND separates) AS n_separating_reliable FROM p""",
    "broken_parents": "WITH t AS (SELECT s_suppkey % 3 AS doc, 't' || s_suppkey AS tier_id, CASE WHEN s_suppkey % 4 <> 0 THEN 't' || (s_suppkey - 3 * (s_suppkey % 11)) END AS parent FROM supplier) SELECT * FROM t WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t k WHERE k.doc = t.doc AND k.tier_id = t.parent)",
}
