"""Queries of the report's tables and of sheets, with their oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report_tables as rt
from ..operators import space as sp
from ..sources import sheets
from .adapters import CLIPS, clips, read

_GROUPS = ("gender", "region_code", "handedness")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips summed by region, category and hand role, with a spread as interval."""
    rows = clips(spark, sf_dir).where("hand_present").groupBy("region_code", "keyword", "hand_role").agg(F.sum("regions_used").alias("s"), F.count("*").alias("n_annotations"), F.count_distinct("signer_id").alias("n_signers"), F.min("regions_used").alias("ci_low"), F.max("regions_used").alias("ci_high"))
    return rows.withColumn("avg_regions", F.col("s") / F.col("n_annotations")).drop("s")


def report_regions(spark, sf_dir):
    return rt.region_table(_cells(spark, sf_dir))


def report_central(spark, sf_dir):
    cells = _cells(spark, sf_dir).select("keyword", "hand_role", F.col("avg_regions").alias("central_percent"), "n_annotations")
    return rt.central_table(cells, ["central_percent"], "n_annotations").select("keyword", *[F.floor(F.col(f"central_percent_{r}") * 1e6 + 0.5).alias(f"central_{r}_e6") for r in rt.ROLES])


def report_separation(spark, sf_dir):
    """Pairs of levels of three groupings; half a region apart stands for separating."""
    c = clips(spark, sf_dir)
    parts = [sp.pairwise_levels(c, g, role=r).withColumns({"group": F.lit(g), "hand_role": F.lit(r)}) for g in _GROUPS for r in rt.ROLES]
    pairs = reduce(DataFrame.unionByName, parts).withColumn("separates", F.abs("difference") > 0.05)
    return rt.separation_table(pairs)


def report_spread(spark, sf_dir):
    c = clips(spark, sf_dir)
    parts = [sp.effect_spread(c, g).withColumns({"group": F.lit(g), "hand_role": F.lit("dominant")}) for g in _GROUPS]
    parts.append(sp.effect_spread(c, "keyword", within="region_code").withColumns({"group": F.lit("keyword"), "hand_role": F.lit("dominant")}))
    names = ["click", "view", "purchase"]
    return rt.spread_table(reduce(DataFrame.unionByName, parts), names).select("group", *[F.floor(F.col(n) * 1e6 + 0.5).alias(f"{n}_e6") for n in ["pooled", *names]])


def sheet_roster(spark, sf_dir):
    """Customers as rows of workbooks of five hundred each: headings, pairs and ages that carry down."""
    k = F.col("c_custkey")
    names = F.array(*map(F.lit, ("福岡県 Fukuoka", "notes", "Nara", "石川県")))
    heading = F.when(k % 40 == 0, F.element_at(names, (F.floor(k / 40) % 4 + 1).cast("int"))).otherwise("")
    number = F.when(k % 17 == 0, "x").otherwise((k % 90).cast("string"))
    cells = F.array(heading, F.when(k % 3 == 0, k.cast("string")).otherwise(""), number, F.when(k % 2 == 0, "r").otherwise(" L "), F.when(k % 5 < 2, (20 + k % 60).cast("string")), F.when(k % 2 == 0, "m").otherwise("f"))
    rows = read(spark, sf_dir, "customer").select(F.floor(k / 500).cast("string").alias("workbook"), F.lit("signers").alias("sheet"), k.alias("row"), cells.alias("cells"))
    return sheets.roster_of_sheet(rows)


QUERIES = {f.__name__: f for f in (report_regions, report_central, report_separation, report_spread, sheet_roster)}

_MEANS = f"""{CLIPS}, cells AS (SELECT region_code, keyword, hand_role, count(*) AS n_annotations, count(DISTINCT signer_id) AS n_signers, min(regions_used) AS ci_low, max(regions_used) AS ci_high,
  sum(regions_used) / count(*)::DOUBLE AS avg_regions FROM clips WHERE hand_present GROUP BY ALL)"""
_LEVELS = " UNION ALL ".join(f"SELECT '{g}' AS grp, keyword AS within, CAST({g} AS VARCHAR) AS level, regions_used, signer_id FROM clips WHERE hand_present AND hand_role = 'dominant'" for g in _GROUPS)
_LEVELS = f"{_LEVELS} UNION ALL SELECT 'keyword', region_code, keyword, regions_used, signer_id FROM clips WHERE hand_present AND hand_role = 'dominant'"
_LEVELS = f"{CLIPS}, lv AS ({_LEVELS}), means AS (SELECT grp, within, level, sum(regions_used) / count(*)::DOUBLE AS mean, count(DISTINCT signer_id) AS s FROM lv GROUP BY ALL)"

ORACLE_SQL = {
    "report_regions": f"""WITH {_MEANS} SELECT d.region_code, d.keyword, d.n_annotations, d.n_signers, d.avg_regions AS avg_regions_dominant, d.ci_low AS ci_low_dominant, d.ci_high AS ci_high_dominant,
      n.avg_regions AS avg_regions_non_dominant, n.ci_low AS ci_low_non_dominant, n.ci_high AS ci_high_non_dominant
      FROM (SELECT * FROM cells WHERE hand_role = 'dominant') d LEFT JOIN (SELECT * FROM cells WHERE hand_role = 'non_dominant') n USING (region_code, keyword)""",
    "report_central": f"""WITH {_MEANS} SELECT keyword, {", ".join(f"CAST(floor(sum(avg_regions * n_annotations) FILTER (WHERE hand_role = '{r}') / sum(n_annotations) FILTER (WHERE hand_role = '{r}') * 1e6 + 0.5) AS BIGINT) AS central_{r}_e6" for r in rt.ROLES)} FROM cells GROUP BY keyword""",
    "report_separation": f"""WITH {_LEVELS}, pairs AS (SELECT a.grp, a.within, a.level AS la, b.level AS lb, a.mean - b.mean AS d FROM means a JOIN means b ON a.grp = b.grp AND a.within = b.within AND a.level < b.level
        WHERE a.s >= {sp.STABLE_SIGNERS} AND b.s >= {sp.STABLE_SIGNERS} AND a.grp <> 'keyword'),
      w AS (SELECT grp, count(*) FILTER (WHERE abs(d) > 0.05) AS separating, count(*) AS pairs, arg_min(row(d, within, la, lb), row(-abs(d), within, la, lb)) AS w FROM pairs GROUP BY grp)
      SELECT grp AS "group", separating, pairs, abs(w[1]) AS widest_gap, w[3] AS level_a, w[4] AS level_b, w[2] AS compared_within, 2 * separating > pairs AS mostly FROM w""",
    "report_spread": f"""WITH {_LEVELS}, sp AS (SELECT grp, within, max(mean) - min(mean) AS spread FROM means WHERE s >= {sp.STABLE_SIGNERS} GROUP BY ALL HAVING count(*) >= 2)
      SELECT grp AS "group", CAST(floor(avg(spread) FILTER (WHERE grp = 'keyword') * 1e6 + 0.5) AS BIGINT) AS pooled_e6, {", ".join(f"CAST(floor(min(spread) FILTER (WHERE grp <> 'keyword' AND within = '{c}') * 1e6 + 0.5) AS BIGINT) AS {c}_e6" for c in ("click", "view", "purchase"))} FROM sp GROUP BY grp""",
    "sheet_roster": """WITH c AS (SELECT c_custkey AS k, CAST(c_custkey // 500 AS VARCHAR) AS workbook, CASE WHEN c_custkey % 40 = 0 THEN ['FO', '', 'NR', 'IS'][c_custkey // 40 % 4 + 1] END AS head,
        CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS pair, CASE WHEN c_custkey % 5 < 2 THEN CAST(20 + c_custkey % 60 AS VARCHAR) END AS age FROM customer),
      d AS (SELECT *, last_value(nullif(head, '') IGNORE NULLS) OVER w AS prefecture FROM c WINDOW w AS (PARTITION BY workbook ORDER BY k ROWS UNBOUNDED PRECEDING)),
      e AS (SELECT *, head IS NULL AND prefecture IS NOT NULL AND k % 17 <> 0 AS listed FROM d),
      f AS (SELECT *, sum(CASE WHEN nullif(head, '') IS NOT NULL OR (listed AND pair <> '') THEN 1 ELSE 0 END) OVER (PARTITION BY workbook ORDER BY k ROWS UNBOUNDED PRECEDING) AS carried FROM e),
      g AS (SELECT *, last_value(CASE WHEN listed THEN age END IGNORE NULLS) OVER (PARTITION BY workbook, carried ORDER BY k ROWS UNBOUNDED PRECEDING) AS held FROM f)
      SELECT workbook, 'signers' AS sheet, prefecture || '_' || lpad(CAST(k % 90 AS VARCHAR), 2, '0') AS signer, prefecture, pair, coalesce(held, '') AS age, CASE WHEN k % 2 = 0 THEN 'M' ELSE 'F' END AS gender, CASE WHEN k % 2 = 0 THEN 'R' ELSE 'L' END AS dominant_hand
      FROM g WHERE listed QUALIFY row_number() OVER (PARTITION BY workbook, prefecture, k % 90 ORDER BY k DESC) = 1""",
}
