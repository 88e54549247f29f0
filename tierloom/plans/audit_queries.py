"""Queries of the one-pass audit over the orders table seen as word tiers, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules
from .adapters import read


def tiers_of_orders(orders: DataFrame) -> DataFrame:
    """Orders as word tiers of documents: eight neighbouring keys are a document, every tenth a copy of the next one's recording."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    doc = F.floor(key / 8)
    rec = F.when(doc % 10 == 0, doc + 1).otherwise(doc)
    base = orders.select("o_orderkey", "o_custkey", "o_orderstatus", doc.alias("doc"), rec.alias("rec"), (rec % 89 + 1).alias("a"))
    n = F.col("a") + F.when(key % 17 == 0, 5).when(key % 3 == 0, 0).otherwise(1)
    base = base.withColumn("n", n)
    age = 20 + F.col("n") % 6 * 10 + F.when(cust % 19 == 0, 10).otherwise(0)
    gender = F.when((F.col("n") + F.when(cust % 23 == 0, 1).otherwise(0)) % 2 == 0, "M").otherwise("F")
    plain = F.format_string("FO_%02d_KT", "n")
    label = F.when(cust % 29 == 0, plain).otherwise(F.format_string("FO_%02d_KT_%d%s", F.col("n"), age, gender))
    variant = F.when(key % 31 == 0, "-2").when(key % 37 == 0, "-roman").otherwise("")
    recording = F.format_string("FO_%02d-%02d_%d", F.col("a"), F.col("a") + 1, F.col("rec"))
    participant = F.when(cust % 7 == 0, None).when(cust % 41 == 0, plain).when(cust % 43 == 0, F.format_string("FO_%02d_XX", F.col("n") + 1)).otherwise(label)
    filled = F.when((F.col("doc") % 13 == 0) & (variant == ""), 0).otherwise(key % 5)
    return base.select(recording.alias("recording"), F.concat(F.when(F.col("doc") % 10 == 0, "/copy/").otherwise("/main/"), recording, F.lit(".eaf")).alias("path"), F.concat(label, F.lit("-Word-jp"), variant).alias("tier_id"), participant.alias("participant"), filled.alias("n"), (F.col("o_orderstatus") == "F").alias("in_use"))


def roster_of_customers(customers: DataFrame) -> DataFrame:
    """Customers as a roster of signers, some of whom it does not know."""
    n = F.col("c_custkey") % 97
    known = customers.select(n.alias("n")).where("n % 13 <> 0").distinct()
    return known.select(F.format_string("FO_%02d", "n").alias("signer"), (20 + F.col("n") % 6 * 10).alias("age"), F.when(F.col("n") % 2 == 0, "M").otherwise("F").alias("gender"))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tiers_of_orders(read(spark, sf_dir, "orders")), roster_of_customers(read(spark, sf_dir, "customer"))


def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules in one scan."""
    return rules.findings(*_inputs(spark, sf_dir))


def audit_to_do_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do about the findings."""
    tiers, roster = _inputs(spark, sf_dir)
    selected = tiers.where("in_use").select("recording").distinct()
    return rules.to_do_list(rules.findings(tiers, roster), rules.unread_files(tiers), roster, selected)


def audit_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose glosses stand on variants alone."""
    return rules.unread_files(tiers_of_orders(read(spark, sf_dir, "orders")))


QUERIES = {f.__name__: f for f in (audit_findings, audit_to_do_list, audit_unread)}

_TIERS = """o AS (SELECT o_orderkey AS key, o_custkey AS cust, o_orderstatus = 'F' AS in_use, o_orderkey // 8 AS doc, CASE WHEN o_orderkey // 8 % 10 = 0 THEN o_orderkey // 8 + 1 ELSE o_orderkey // 8 END AS rec FROM orders),
  o1 AS (SELECT *, rec % 89 + 1 AS a, rec % 89 + 1 + CASE WHEN key % 17 = 0 THEN 5 WHEN key % 3 = 0 THEN 0 ELSE 1 END AS k FROM o),
  o2 AS (SELECT *, printf('FO_%02d', k) AS signer, CASE WHEN cust % 29 <> 0 THEN 20 + k % 6 * 10 + CASE WHEN cust % 19 = 0 THEN 10 ELSE 0 END END AS age,
    CASE WHEN cust % 29 <> 0 THEN CASE WHEN (k + CASE WHEN cust % 23 = 0 THEN 1 ELSE 0 END) % 2 = 0 THEN 'M' ELSE 'F' END END AS gender,
    CASE WHEN key % 31 = 0 THEN '-2' WHEN key % 37 = 0 THEN '-roman' ELSE '' END AS variant, printf('FO_%02d-%02d_%d', a, a + 1, rec) AS recording FROM o1),
  o3 AS (SELECT *, signer || '_KT' || coalesce('_' || age || gender, '') AS label, CASE WHEN doc % 10 = 0 THEN '/copy/' ELSE '/main/' END || recording || '.eaf' AS path FROM o2),
  tiers AS (SELECT *, label || '-Word-jp' || variant AS tier_id, CASE WHEN cust % 7 = 0 THEN '' WHEN cust % 41 = 0 THEN signer || '_KT' WHEN cust % 43 = 0 THEN printf('FO_%02d_XX', k + 1) ELSE label END AS attribute,
    CASE WHEN doc % 13 = 0 AND variant = '' THEN 0 ELSE key % 5 END AS n FROM o3),
  roster AS (SELECT printf('FO_%02d', k) AS signer, CAST(20 + k % 6 * 10 AS VARCHAR) AS sheet_age, CASE WHEN k % 2 = 0 THEN 'M' ELSE 'F' END AS sheet_gender FROM (SELECT DISTINCT c_custkey % 97 AS k FROM customer) WHERE k % 13 <> 0),
  words AS (SELECT recording, path, a, signer, label, tier_id, attribute, variant, age, gender, sum(n) AS n FROM tiers WHERE variant <> '-roman' GROUP BY ALL)"""
_FINDINGS = f"""{_TIERS},
  labels AS (SELECT recording, path, a, signer, label, age, gender, string_agg(DISTINCT tier_id, ' ' ORDER BY tier_id) AS ids FROM words GROUP BY ALL),
  signers AS (SELECT recording, path, a, signer, string_agg(DISTINCT label, ' / ' ORDER BY label) AS spellings, count(DISTINCT label) AS c, string_agg(DISTINCT tier_id, ' ' ORDER BY tier_id) AS ids FROM words GROUP BY ALL),
  docs AS (SELECT DISTINCT recording, path FROM words), copies AS (SELECT *, count(*) OVER (PARTITION BY recording) AS c FROM docs),
  variants AS (SELECT recording, path, string_agg(variant || '=' || n, ' ' ORDER BY variant) AS d FROM (SELECT recording, path, variant, sum(n) AS n FROM words WHERE variant <> '' GROUP BY ALL) GROUP BY ALL),
  ways AS (SELECT signer, label, row_number() OVER (PARTITION BY signer ORDER BY label) AS i, count(*) OVER (PARTITION BY signer) AS c FROM (SELECT DISTINCT signer, label FROM words)),
  sheeted AS (SELECT labels.*, sheet_age, sheet_gender FROM labels LEFT JOIN roster USING (signer)),
  found AS (
    SELECT recording, path, '' AS signer, 'recording in several places' AS problem, c || ' copies' AS detail, '' AS tiers FROM copies WHERE c > 1
    UNION ALL SELECT recording, path, '', 'word tier variants', d, '' FROM variants
    UNION ALL SELECT recording, path, signer, 'signer written several ways', i || ' of ' || c || ': ' || label, ids FROM labels JOIN ways USING (signer, label) WHERE c > 1
    UNION ALL SELECT recording, path, signer, 'several spellings in one file', spellings, ids FROM signers WHERE c > 1
    UNION ALL SELECT recording, path, signer, 'signer from another recording', printf('this recording is FO_%02d and FO_%02d', a, a + 1), ids FROM signers WHERE signer NOT IN (printf('FO_%02d', a), printf('FO_%02d', a + 1))
    UNION ALL SELECT DISTINCT recording, path, signer, 'tier name and PARTICIPANT disagree' || CASE WHEN starts_with(attribute, signer) THEN '' ELSE ' (different signer)' END, 'name says ' || label || ', PARTICIPANT says ' || attribute, tier_id FROM words WHERE attribute NOT IN ('', label)
    UNION ALL SELECT recording, path, signer, 'no age/gender in the ID', label, ids FROM sheeted WHERE age IS NULL AND sheet_age IS NOT NULL
    UNION ALL SELECT recording, path, signer, 'not in the spreadsheet', label, ids FROM sheeted WHERE age IS NOT NULL AND sheet_age IS NULL
    UNION ALL SELECT recording, path, signer, 'age contradicts the spreadsheet', label || ' says ' || age || ', sheet says ' || sheet_age, ids FROM sheeted WHERE CAST(age AS VARCHAR) <> sheet_age
    UNION ALL SELECT recording, path, signer, 'gender contradicts the spreadsheet', label || ' says ' || gender || ', sheet says ' || sheet_gender, ids FROM sheeted WHERE gender <> sheet_gender)"""
_UNREAD = """unread AS (SELECT recording, path, string_agg(DISTINCT variant, ' ' ORDER BY variant) FILTER (WHERE variant <> '') AS variants, CAST(sum(n) FILTER (WHERE variant <> '') AS BIGINT) AS unread
    FROM words GROUP BY ALL HAVING count(*) FILTER (WHERE variant <> '') > 0 AND coalesce(sum(n) FILTER (WHERE variant = ''), 0) = 0)"""
TO_DO_SQL = f"""{_FINDINGS}, {_UNREAD},
  ranks AS (SELECT * FROM (VALUES {", ".join(f"('{p}', {r}, '{c}', {flag})" for m, flag in ((rules.PER_TIER, "true"), (rules.PER_SIGNER, "false")) for p, (r, c) in m.items())}) AS v(problem, rank, category, by_tier)),
  actions AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{a}')" for c, a in rules.ACTIONS.items())}) AS v(category, action)),
  ranked AS (SELECT *, row(problem, signer, recording, path, detail) AS pos FROM found JOIN ranks USING (problem)),
  by_tier AS (SELECT rank, category, recording, tier, arg_min(signer, pos) AS signer, arg_min(detail, pos) AS problem, [recording] AS places FROM (SELECT *, unnest(string_split(tiers, ' ')) AS tier FROM ranked WHERE by_tier) GROUP BY 1, 2, 3, 4),
  people AS (SELECT rank, category, signer, list_sort(list(DISTINCT recording)) AS places, list_sort(list(DISTINCT tier)) AS tiers, arg_max(detail, pos) AS problem FROM (SELECT *, unnest(string_split(tiers, ' ')) AS tier FROM ranked WHERE NOT by_tier) GROUP BY 1, 2, 3),
  lines AS (SELECT rank, category, recording, tier, signer, problem, places FROM by_tier
    UNION ALL SELECT rank, category, array_to_string(places, ', '), len(tiers) || ' tier(s): ' || array_to_string(tiers[1:3], ' ') || CASE WHEN len(tiers) > 3 THEN ' ...' ELSE '' END, signer, problem, places FROM people
    UNION ALL SELECT 2, 'Unreadable gloss', recording, 'all Word-jp tiers are empty', substr(recording, 1, 5) || ' and FO_' || substr(recording, 7, 2), 'gloss is on ' || variants || ' instead; ' || unread || ' annotations unread', [recording] FROM unread),
  used AS (SELECT list(DISTINCT recording) AS all_used FROM tiers WHERE in_use)
SELECT rank, lines.signer, lines.category, recording, tier, problem, CASE WHEN lines.category = 'Unreadable gloss' THEN '' WHEN sheet_age IS NULL THEN 'not in spreadsheet' ELSE 'age ' || sheet_age || ', ' || sheet_gender END AS spreadsheet,
  CASE WHEN list_has_any(places, all_used) THEN 'yes' ELSE 'no' END AS in_selection, action FROM lines LEFT JOIN roster ON roster.signer = lines.signer JOIN actions ON actions.category = lines.category CROSS JOIN used"""

ORACLE_SQL = {"audit_findings": f"WITH {_FINDINGS} SELECT * FROM found", "audit_to_do_list": f"WITH {TO_DO_SQL}", "audit_unread": f"WITH {_TIERS}, {_UNREAD} SELECT * FROM unread"}
