"""Queries of text functions, joins, recursion, sets and audits, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gloss_parser as gp
from ..functions import text as tx
from ..operators import audit as au
from ..operators import relations as rel
from .adapters import TOKENS, read, tokens

# Annotation strings for the string functions.
GLOSSES = ("~pt2", "食べる!rep2", "//猫/犬", "口形:うん", "ＦＡＬ", "cl:猫の形(fal)", "UN:RH:猫", "ok", "pt3;5種類", "abc", "狙う(pt)", "REPEAT 歩く", "/あ/", "a/b/c", "<家", "裏>", "猫？", "QM", "dr:5種類", "＋足す＋", "[A]山", "山、川,海", "", "家(LH)+裏(RH)", "A+(B+C)+D", "NEG 行く", "d", "１２３", "fal", "D(un)")


def _glosses(spark, sf_dir):
    """The literals, and every whole turn of the conversations."""
    turns = read(spark, sf_dir, "conversations").where("text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn") + 1000).alias("i"), F.col("text").alias("s"))
    return spark.createDataFrame(list(enumerate(GLOSSES)), "i long, s string").unionByName(turns)


def normalize_text(spark, sf_dir):
    s = F.col("s")
    return _glosses(spark, sf_dir).select("i", tx.normalise_annotation(s).alias("annotation"), tx.normalise_digits(s).alias("digits"), tx.without_compound_marks(s).alias("marks"), tx.has_compound_open(s).alias("opens"), tx.has_compound_close(s).alias("closes"), tx.too_many_slashes(s).alias("slashes"))


def residue_check(spark, sf_dir):
    return _glosses(spark, sf_dir).select("i", tx.has_residue(F.col("s")).alias("residue"))


def blocking_flags(spark, sf_dir):
    s = F.col("s")
    return _glosses(spark, sf_dir).select("i", tx.blocking_flag(s).alias("blocking"), tx.question_flag(s).alias("question"), tx.token_flag(s, "NEG").alias("neg"), F.array_join(tx.lexical_components(s), "|").alias("components"))


def bracket_split(spark, sf_dir):
    return _glosses(spark, sf_dir).select("i", F.array_join(tx.split_outside_brackets(F.col("s"), "+"), "|").alias("parts"))


def identity_keys(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    name = F.concat(F.lit("fo_"), F.lpad(F.col("page_id").cast("string"), 3, "0"), F.lit("_AniN_parsed_out.csv"))
    return p.select("page_id", tx.file_key(name).alias("file_key"), tx.region_of(name).alias("region"), tx.signer_stem(name).alias("signer"), tx.signer_key(name).alias("signer_key"), tx.hms(F.col("page_id") * 1500.0).alias("hms"))


def ref_chain_times(spark, sf_dir):
    """Documents as annotations that refer to the one five before, in chains of 41; the first of a chain has its own
    times, but in the last of five it refers to the fourth of its chain, which makes a circle."""
    place, first = F.floor(F.col("doc_id") / 5) % 41, (F.floor(F.col("doc_id") / 5) % 41 == 0) & (F.col("doc_id") % 5 != 4)
    ref = F.when(place != 0, F.col("doc_id") - 5).when(F.col("doc_id") % 5 == 4, F.col("doc_id") + 15)
    d = read(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("doc"), F.col("doc_id").alias("id"), ref.alias("ref"), F.when(first, F.col("n_chars")).alias("start_ms"), F.when(first, F.col("n_chars") + 100).alias("end_ms"))
    return rel.inherited_times(d)


def tier_closure(spark, sf_dir):
    t = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 3).alias("doc"), F.col("s_suppkey").alias("tier_id"), F.floor(F.col("s_suppkey") / 3).alias("parent"))
    return rel.tier_closure(t, F.col("tier_id") % 7 == 0)


def broken_refs(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("doc"), F.col("doc_id").alias("id"), (F.col("doc_id") - 5 * (F.col("doc_id") % 7)).alias("ref"))
    return rel.broken_references(d)


def match_report(spark, sf_dir):
    return rel.match_report(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select((F.col("doc_id") + 10).alias("doc_id")), "doc_id")


def index_semi(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "lang", "source")


def unmatched_anti(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang", "source")


def _vocabulary(spark, sf_dir, lang):
    return tokens(spark, sf_dir).where(F.col("region_code") == lang).select("lexical_item")


def vocab_intersect(spark, sf_dir):
    return _vocabulary(spark, sf_dir, "fr").intersect(_vocabulary(spark, sf_dir, "es"))


def vocab_except(spark, sf_dir):
    return _vocabulary(spark, sf_dir, "fr").distinct().exceptAll(_vocabulary(spark, sf_dir, "es").distinct())


def union_findings(spark, sf_dir):
    d, l = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    short = d.where("n_chars < 100").select(F.col("doc_id").alias("doc"), F.col("n_chars").cast("string").alias("detail"))
    poor = l.where("quality = 0").select(F.col("doc_id").alias("doc"), F.lit("quality").alias("detail"))
    orphan = d.join(l, "doc_id", "left_anti").where("source = 'src3'").select(F.col("doc_id").alias("doc"), F.col("source").alias("detail"))
    return rel.findings(("short", short), ("poor", poor), ("unlabelled", orphan))


def audit_copies(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("recording"), F.col("doc_id").alias("path"))
    return rel.copies(d, "recording", "path")


def audit_spellings(spark, sf_dir):
    t = read(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("signer"), F.concat_ws("-", "event_type", (F.col("user_id") % 2).cast("string")).alias("label"), F.date_format("ts", "yyyy-MM-dd").alias("doc"))
    return rel.spellings(t)


def fullest_tier(spark, sf_dir):
    t = read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("doc"), (F.col("user_id") % 10).alias("signer"), F.col("event_type").alias("tier_id")).agg((F.count("*") - 3).alias("n"))
    return rel.fullest_tier(t)


def merged_cells(spark, sf_dir):
    v = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("parent"), F.col("role").alias("column"), F.col("turn").alias("ordinal"), F.col("text").alias("value"))
    return rel.merge_cells(v)


def carried_down(spark, sf_dir):
    r = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise("").alias("name"))
    return rel.carry_down(r, "name", "s_nationkey", "s_suppkey")


def signer_prefix_match(spark, sf_dir):
    roster = spark.createDataFrame([(x,) for x in ("FO_1", "FO_12", "FO", "GM_03", "GM_3_A", "NR07")], "signer_id string")
    names = read(spark, sf_dir, "supplier").select(F.concat(F.element_at(F.array(*map(F.lit, ("FO_0", "fo", "GM-3", "NR_", "XX"))), (F.col("s_suppkey") % 5 + 1).cast("int")), (F.col("s_suppkey") % 13).cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "_A").otherwise("")).alias("name")).distinct()
    return rel.match_signers(names, roster)


def exclusions_anti(spark, sf_dir):
    entries = spark.createDataFrame([("\"a/5\"", 1), ("/7.html", 2), ("a", 3), ("b/9.mp4", 4)], "entry string, number long")
    clips = read(spark, sf_dir, "pages").select("page_id", F.concat(F.when(F.col("page_id") % 2 == 0, "A/").otherwise("b/"), (F.col("page_id") % 10).cast("string"), F.lit(".mp4")).alias("clip"))
    return rel.excluded(clips.withColumn("clip", F.concat("clip", F.lit(""))).withColumn("path", F.concat_ws("/", F.lit("x"), "clip")), "clip", entries).where("number IS NULL").select("page_id", "clip")


def diff_report(spark, sf_dir):
    old = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    new = old.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"), F.when(F.col("doc_id") % 50 == 0, F.lit(None)).otherwise(F.col("toxic")).alias("toxic"))
    return rel.diff(old, new, "doc_id", ["quality", "toxic"])


def parse_annotations(spark, sf_dir):
    """Gloss strings, mixed with words of the documents, through the rule parser."""
    words = tokens(spark, sf_dir).select("annotation").distinct().repartition(2 * spark.sparkContext.defaultParallelism)  # a Python stage of its own size
    mixed = F.concat_ws("+", "annotation", F.element_at(F.array(*map(F.lit, GLOSSES)), (F.pmod(F.crc32(F.col("annotation").cast("binary")), F.lit(len(GLOSSES))) + 1).cast("int")))
    return words.select(gp.parse_column(mixed).alias("p")).select("p.*")


def parse_documents(spark, sf_dir):
    """Turns as annotations of a document, with compound groups over the whole document."""
    t = read(spark, sf_dir, "conversations")
    text = F.concat(F.when(F.length("text") % 7 == 0, "<").otherwise(""), F.col("text"), F.when(F.length("text") % 5 == 0, ">").otherwise(""))
    return gp.parse_rows(t.select("conv_id", "turn", "role", text.alias("annotation")), "conv_id", ["turn", "role"])


def audit_outside_pair(spark, sf_dir):
    """Suppliers as signers of recordings that their nation and key name."""
    x = read(spark, sf_dir, "supplier").select(F.format_string("FO_%02d-%02d_Ani", F.col("s_nationkey"), F.col("s_nationkey") + 1).alias("recording"), F.format_string("FO%d", F.col("s_suppkey") % 26).alias("signer"))
    return au.outside_pair(x).distinct()


def audit_roster(spark, sf_dir):
    """Customers against a roster that knows some of them, with some ages and genders changed."""
    c0 = read(spark, sf_dir, "customer").select(F.format_string("FO_%d", F.col("c_custkey")).alias("signer"), (F.col("c_custkey") % 60).alias("age"), F.when(F.col("c_custkey") % 2 == 0, "f").otherwise("male").alias("gender"), "c_custkey")
    people = c0.select("signer", F.when(F.col("c_custkey") % 11 != 0, F.col("age")).alias("age"), "gender")
    roster = c0.where("c_custkey % 5 <> 0").select("signer", F.when(F.col("c_custkey") % 7 == 0, F.col("age") + 1).otherwise(F.col("age")).alias("age"), F.when(F.col("c_custkey") % 13 == 0, "男").otherwise(F.col("gender")).alias("gender"))
    return au.against_roster(people, roster)


def audit_to_do(spark, sf_dir):
    """Events as findings of several ranks, one line per tier."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("n"), (F.col("event_id") % 4).alias("rank"), (F.col("user_id") % 20).cast("string").alias("signer"), F.col("event_type").alias("tier_id"), F.date_format("ts", "yyyy-MM-dd").alias("doc"), F.lpad(F.col("event_id").cast("string"), 6, "0").alias("problem"), F.col("user_id").cast("string").alias("detail"))
    return au.to_do(e)


def resolved_tiers(spark, sf_dir):
    """Rows of a day find their tier by id, or else by their signer."""
    tiers = read(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("doc"), F.concat_ws("-", "event_type", (F.col("user_id") % 9).cast("string")).alias("tier_id"), (F.col("user_id") % 9).cast("string").alias("participant")).where("event_id % 7 = 0").distinct()
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.date_format("ts", "yyyy-MM-dd").alias("doc"), F.concat_ws("-", "event_type", (F.col("user_id") % 9).cast("string")).alias("tier_id"), (F.col("user_id") % 9).cast("string").alias("speaker_id"))
    return au.resolve_tiers(rows, tiers)

QUERIES = {f.__name__: f for f in (normalize_text, residue_check, blocking_flags, bracket_split, identity_keys, ref_chain_times, tier_closure, broken_refs, match_report, index_semi, unmatched_anti, vocab_intersect, vocab_except, union_findings, audit_copies, audit_spellings, fullest_tier, merged_cells, carried_down, signer_prefix_match, exclusions_anti, diff_report, audit_outside_pair, audit_roster, audit_to_do, resolved_tiers, parse_annotations, parse_documents)}

_VALUES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(GLOSSES))
_G = f"g AS (SELECT CAST(i AS BIGINT) AS i, s FROM (VALUES {_VALUES}) AS v(i, s) UNION ALL SELECT conv_id * 1000 + turn + 1000, text FROM conversations WHERE text IS NOT NULL)"
_ST = lambda e: f"trim({e}, ' 　\t\n')"
_SPELL = "drop2"
for _old, _new in tx.KEYWORD_SPELLINGS:
    _SPELL = f"replace({_SPELL}, '{_old}', '{_new}')"
_ALLOWED = r"぀-ゟ゠-ヿ一-鿿ー々〆〤0-9０-９、。，．〒「」”“\"：:\s　＋+\-−\(\)（）\[\];"

ORACLE_SQL = {
    "normalize_text": f"""WITH {_G}, a AS (SELECT *, translate(regexp_replace(s, '^([^˜~〜]*)[˜~〜]', '\\1'), '!！', '') AS drop2 FROM g),
      b AS (SELECT *, regexp_replace(regexp_replace({_SPELL}, 'dr', 'dw', 'gi'), '\\bREPEAT\\b', 'REP', 'gi') AS k FROM a), c AS (SELECT *, translate({_ST("regexp_replace(k, '^[\\s　]*/+', '')")}, '&＋', '++') AS t FROM b),
      d AS (SELECT *, replace({_ST('t')}, '／', '+') AS u FROM c), e AS (SELECT *, CASE WHEN u LIKE '/%' THEN '/' ELSE '' END AS lead, CASE WHEN u LIKE '/%' THEN substr(u, 2) ELSE u END AS body FROM d),
      f AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '/+$', ''), '[\\s　]*/[\\s　]*', '+', 'g'), '^[\\s　]*\\++[\\s　]*', ''), '[\\s　]*\\++[\\s　]*$', '') AS rest FROM e)
    SELECT i, {_ST(f"lead || {_ST('rest')}")} AS annotation, translate(s, '０１２３４５６７８９', '0123456789') AS digits, translate(s, '<>＜＞', '') AS marks, regexp_matches(s, '[<＜]') AS opens, regexp_matches(s, '[>＞]') AS closes,
      length(s) - length(replace(s, '/', '')) > 1 AND NOT regexp_matches({_ST('s')}, '^/[^/]+/$') AS slashes FROM f""",
    "residue_check": f"""WITH {_G}, p AS (SELECT *, list_filter(list_transform(string_split(s, ';'), lambda x: {_ST('x')}), lambda x: x <> '') AS parts FROM g)
    SELECT i, CASE WHEN len(parts) > 0 AND len(list_filter(parts, lambda x: NOT regexp_full_match(x, '(ok|pt[0-9]*)', 'i'))) = 0 THEN false
      ELSE regexp_matches(regexp_replace(array_to_string(list_transform(string_split(s, ';'), lambda x: CASE WHEN regexp_full_match({_ST('x')}, 'pt[0-9]*', 'i') THEN '' ELSE x END), ';'), '\\[[A-Za-z]+\\]', '[]', 'g'), '[^{_ALLOWED}]') END AS residue FROM p""",
    "blocking_flags": f"""WITH {_G}, t AS (SELECT *, regexp_replace({_ST('s')}, '^/+', '') AS u FROM g)
    SELECT i, lower(coalesce(nullif(regexp_extract(u, '^(FAL|UN|D)([^A-Za-z]|$)', 1, 'i'), ''), nullif(regexp_extract(u, '[\\(（][\\s　]*(FAL|UN|D)[\\s　]*[\\)）][\\s　]*$', 1, 'i'), ''))) AS blocking,
      regexp_matches(s, '[?？]') OR regexp_matches(s, '(^|[^A-Za-z])QM([^A-Za-z]|$)', 'i') AS question, regexp_matches(s, '(^|[^A-Za-z])NEG([^A-Za-z]|$)', 'i') AS neg,
      array_to_string(list_filter(list_transform(regexp_split_to_array(s, '[、,，][\\s　]*'), lambda x: {_ST('x')}), lambda x: x <> ''), '|') AS components FROM t""",
    "bracket_split": f"""WITH {_G}, c AS (SELECT i, k, substr(s, k, 1) AS ch FROM (SELECT i, s, unnest(range(1, length(s) + 1)) AS k FROM g)),
      d AS (SELECT *, sum(CASE WHEN ch IN ('（', '(', '{{', '｛') THEN 1 WHEN ch IN ('）', ')', '}}', '｝') THEN -1 ELSE 0 END) OVER (PARTITION BY i ORDER BY k) AS level FROM c),
      m AS (SELECT *, ch = '+' AND level = least(0, min(level) OVER (PARTITION BY i ORDER BY k)) AS cuts FROM d), p AS (SELECT *, count(*) FILTER (WHERE cuts) OVER (PARTITION BY i ORDER BY k) AS part FROM m),
      q AS (SELECT i, part, {_ST("string_agg(ch, '' ORDER BY k) FILTER (WHERE NOT cuts)")} AS t FROM p GROUP BY i, part)
    SELECT g.i, coalesce(string_agg(t, '|' ORDER BY part) FILTER (WHERE t <> ''), '') AS parts FROM g LEFT JOIN q USING (i) GROUP BY g.i""",
    "identity_keys": """WITH p AS (SELECT page_id, 'fo_' || lpad(CAST(page_id AS VARCHAR), 3, '0') || '_AniN_parsed_out.csv' AS name, lpad(CAST(page_id AS VARCHAR), 3, '0') AS n FROM pages)
    SELECT page_id, 'fo' || n || 'anin' AS file_key, 'FO' AS region, 'FO_' || lpad(CAST(CAST(n AS INT) AS VARCHAR), CAST(greatest(2, length(CAST(CAST(n AS INT) AS VARCHAR))) AS INT), '0') AS signer, 'FO_' || CAST(CAST(n AS INT) AS VARCHAR) || '_ANIN_PARSED_OUT_CSV' AS signer_key,
      printf('%02d:%02d:%02d', t // 3600, t // 60 % 60, t % 60) AS hms FROM (SELECT *, CAST(round_even(page_id * 1.5e0, 0) AS BIGINT) AS t FROM p)""",
    "ref_chain_times": """WITH RECURSIVE d AS (SELECT doc_id % 5 AS doc, doc_id AS id, CASE WHEN doc_id // 5 % 41 <> 0 THEN doc_id - 5 WHEN doc_id % 5 = 4 THEN doc_id + 15 END AS ref, CASE WHEN doc_id // 5 % 41 = 0 AND doc_id % 5 <> 4 THEN n_chars END AS s FROM documents),
      r AS (SELECT doc, id, ref AS next, s FROM d UNION SELECT r.doc, r.id, d.ref, d.s FROM r JOIN d ON r.s IS NULL AND d.doc = r.doc AND d.id = r.next)
    SELECT doc, id, max(s) AS start_ms, max(s) + 100 AS end_ms FROM r GROUP BY doc, id""",
    "tier_closure": """WITH RECURSIVE t AS (SELECT s_suppkey % 3 AS doc, s_suppkey AS tier_id, s_suppkey // 3 AS parent FROM supplier), r AS (SELECT doc, tier_id FROM t WHERE tier_id % 7 = 0 UNION SELECT t.doc, t.tier_id FROM r JOIN t ON t.doc = r.doc AND t.parent = r.tier_id) SELECT * FROM r""",
    "broken_refs": "WITH d AS (SELECT doc_id % 5 AS doc, doc_id AS id, doc_id - 5 * (doc_id % 7) AS ref FROM documents) SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d k WHERE k.doc = d.doc AND k.id = d.ref)",
    "match_report": "WITH l AS (SELECT DISTINCT doc_id FROM documents), r AS (SELECT DISTINCT doc_id + 10 AS doc_id FROM labels) SELECT CASE WHEN l.doc_id IS NULL THEN 'right_only' WHEN r.doc_id IS NULL THEN 'left_only' ELSE 'matched' END AS side, count(*) AS n FROM l FULL JOIN r ON l.doc_id = r.doc_id GROUP BY 1",
    "index_semi": "SELECT doc_id, lang, source FROM documents SEMI JOIN labels USING (doc_id)",
    "unmatched_anti": "SELECT doc_id, lang, source FROM documents ANTI JOIN labels USING (doc_id)",
    "vocab_intersect": f"WITH {TOKENS} SELECT lexical_item FROM tokens WHERE region_code = 'fr' INTERSECT SELECT lexical_item FROM tokens WHERE region_code = 'es'",
    "vocab_except": f"WITH {TOKENS} SELECT lexical_item FROM tokens WHERE region_code = 'fr' EXCEPT SELECT lexical_item FROM tokens WHERE region_code = 'es'",
    "union_findings": "SELECT doc_id AS doc, 'short' AS problem, CAST(n_chars AS VARCHAR) AS detail FROM documents WHERE n_chars < 100 UNION ALL SELECT doc_id, 'poor', 'quality' FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'unlabelled', source FROM documents ANTI JOIN labels USING (doc_id) WHERE source = 'src3'",
    "audit_copies": "SELECT md5(text) AS recording, doc_id AS path, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents QUALIFY copies > 1",
    "audit_spellings": "WITH l AS (SELECT user_id % 50 AS signer, event_type || '-' || CAST(user_id % 2 AS VARCHAR) AS label, count(*) AS n_tiers, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS n_files FROM events GROUP BY 1, 2) SELECT *, count(*) OVER (PARTITION BY signer) AS n_spellings, dense_rank() OVER (PARTITION BY signer ORDER BY label) AS label_number FROM l QUALIFY n_spellings > 1",
    "fullest_tier": "WITH t AS (SELECT strftime(ts, '%Y-%m-%d') AS doc, user_id % 10 AS signer, event_type AS tier_id, count(*) - 3 AS n FROM events GROUP BY 1, 2, 3) SELECT doc, signer, arg_max(tier_id, (n, tier_id)) AS tier_id, max(n) AS n, count(*) - 1 AS dropped FROM t WHERE n > 0 GROUP BY 1, 2",
    "merged_cells": "WITH v AS (SELECT conv_id AS parent, role AS \"column\", text AS value, min(turn) AS first FROM conversations WHERE text <> '' GROUP BY 1, 2, 3) SELECT parent, \"column\", string_agg(value, ' | ' ORDER BY first, value) AS cell FROM v GROUP BY 1, 2",
    "carried_down": "SELECT s_suppkey, s_nationkey, last_value(CASE WHEN s_suppkey % 3 = 0 THEN s_name END IGNORE NULLS) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS UNBOUNDED PRECEDING) AS name FROM supplier",
    "signer_prefix_match": """WITH n0 AS (SELECT DISTINCT ['FO_0', 'fo', 'GM-3', 'NR_', 'XX'][s_suppkey % 5 + 1] || (s_suppkey % 13) || CASE WHEN s_suppkey % 2 = 0 THEN '_A' ELSE '' END AS name FROM supplier),
      n AS (SELECT name, regexp_replace(upper(regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g')), '(^|[^0-9])0+([0-9])', '\\1\\2', 'g') AS key FROM n0),
      r AS (SELECT * FROM (VALUES ('FO_1', 'FO_1'), ('FO_12', 'FO_12'), ('FO', 'FO'), ('GM_03', 'GM_3'), ('GM_3_A', 'GM_3_A'), ('NR07', 'NR7')) AS v(signer_id, rk)),
      j AS (SELECT name, signer_id, length(replace(rk, '_', '')) AS len, CASE WHEN key = rk THEN 0 WHEN replace(key, '_', '') = replace(rk, '_', '') THEN 1
        WHEN starts_with(key, rk || '_') OR (starts_with(replace(key, '_', ''), replace(rk, '_', '')) AND NOT regexp_matches(replace(rk, '_', '') || '|' || substr(replace(key, '_', ''), length(replace(rk, '_', '')) + 1, 1), '[0-9][|][0-9]')) THEN 2 END AS tier FROM n, r),
      b AS (SELECT name, arg_min(signer_id, (tier, -len, signer_id)) AS signer_id, min(tier) AS tier FROM j WHERE tier IS NOT NULL GROUP BY name)
    SELECT n.name, b.signer_id, b.tier FROM n LEFT JOIN b USING (name)""",
    "exclusions_anti": "WITH c AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'A/' ELSE 'b/' END || CAST(page_id % 10 AS VARCHAR) || '.mp4' AS clip FROM pages) SELECT * FROM c WHERE clip NOT LIKE 'A/%' AND clip NOT IN ('b/7.mp4', 'b/9.mp4')",
    "audit_outside_pair": """WITH x AS (SELECT s_nationkey AS a, s_nationkey + 1 AS b, s_suppkey % 26 AS k FROM supplier)
    SELECT DISTINCT printf('FO_%02d-%02d_Ani', a, b) AS recording, printf('FO%d', k) AS signer, printf('FO_%02d', a) AS first, printf('FO_%02d', b) AS second FROM x WHERE k NOT IN (a, b)""",
    "audit_roster": """WITH c AS (SELECT c_custkey AS k, printf('FO_%d', c_custkey) AS signer, c_custkey % 60 AS age, CASE WHEN c_custkey % 2 = 0 THEN 'f' ELSE 'male' END AS gender FROM customer),
      r AS (SELECT k, CASE WHEN k % 7 = 0 THEN age + 1 ELSE age END AS sheet_age, CASE WHEN k % 13 = 0 OR gender = 'male' THEN 'male' ELSE 'female' END AS sheet_gender FROM c WHERE k % 5 <> 0),
      j AS (SELECT signer, CASE WHEN k % 11 <> 0 THEN age END AS age, gender, sheet_age, sheet_gender FROM c LEFT JOIN r USING (k)),
      p AS (SELECT *, CASE WHEN sheet_gender IS NULL THEN 'not in roster' WHEN age IS NULL THEN 'missing' WHEN age <> sheet_age OR left(gender, 1) <> left(sheet_gender, 1) THEN 'contradicts' END AS problem FROM j) SELECT * FROM p WHERE problem IS NOT NULL""",
    "audit_to_do": """WITH e AS (SELECT event_id % 4 AS rank, CAST(user_id % 20 AS VARCHAR) AS signer, event_type AS tier_id, strftime(ts, '%Y-%m-%d') AS doc, lpad(CAST(event_id AS VARCHAR), 6, '0') AS problem, CAST(user_id AS VARCHAR) AS detail FROM events)
    SELECT signer, tier_id, min(rank) AS rank, arg_min(problem, (rank, doc, problem)) AS problem, arg_max(detail, (rank, doc, problem)) AS detail, string_agg(DISTINCT doc, ';' ORDER BY doc) AS docs FROM e GROUP BY signer, tier_id""",
    "resolved_tiers": """WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS doc, event_type || '-' || CAST(user_id % 9 AS VARCHAR) AS tier_id, CAST(user_id % 9 AS VARCHAR) AS who FROM events), t AS (SELECT DISTINCT doc, tier_id, who AS participant FROM e WHERE event_id % 7 = 0),
      s AS (SELECT e.event_id, arg_min(t.tier_id, (CASE WHEN participant = who THEN 0 ELSE 1 END, length(t.tier_id), t.tier_id)) AS r FROM e JOIN t ON t.doc = e.doc AND (participant = who OR contains(participant, who) OR contains(t.tier_id, who)) GROUP BY 1)
    SELECT e.event_id AS row_id, coalesce(d.tier_id, s.r) AS resolved, CASE WHEN d.tier_id IS NOT NULL THEN 'tier' WHEN s.r IS NOT NULL THEN 'speaker' END AS how FROM e LEFT JOIN t d ON d.doc = e.doc AND d.tier_id = e.tier_id LEFT JOIN s USING (event_id)""",
    "diff_report": "SELECT doc_id, 'quality' AS \"column\", CAST(quality AS VARCHAR) AS old, CAST(1 - quality AS VARCHAR) AS new FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR), NULL FROM labels WHERE doc_id % 50 = 0",
}
