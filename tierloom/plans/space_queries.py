"""Queries of the signing-space operators and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as geo
from ..operators import series as se
from ..operators import space as sp
from .adapters import CLIPS, POINTS, SERIES, clips, points, read, series


def _clips(spark, sf_dir):
    return clips(spark, sf_dir).withColumns({"age_group": sp.bucket(F.col("age"), sp.AGE_GROUPS), "age_band": sp.bucket(F.col("age"), sp.AGE_BANDS)})


def _classified(spark, sf_dir):
    lines = geo.reference_lines(F.lit(0.5), F.lit(-0.5), F.lit(-0.3), F.lit(-0.9))
    return points(spark, sf_dir).withColumn("region", geo.classify_point(F.col("x"), F.col("y"), lines))


def _counts(spark, sf_dir):
    """Points of a clip by region; even points are the dominant hand, a seventh of the clips stand for a signer each."""
    rows = _classified(spark, sf_dir).withColumns({"hand_role": F.when(F.col("point") % 2 == 0, "dominant").otherwise("non_dominant"), "signer_id": (F.col("clip_id") % 37).cast("string"), "region_code": F.concat(F.lit("R"), (F.col("clip_id") % 3).cast("string"))})
    return rows.groupBy("clip_id", "keyword", "region_code", "signer_id", "hand_role", "region").agg(F.count("*").alias("n"))


_SETS = [["region_code", "keyword"], ["age_group", "keyword"], ["age_band", "keyword"], ["gender", "keyword"], ["region_code", "age_band", "gender", "keyword"]]


def cross_table(spark, sf_dir):
    return sp.summarise(_clips(spark, sf_dir), _SETS).select("grouping", "region_code", "keyword", "age_group", "age_band", "gender", "hand_role", "n_annotations", "n_clips", "n_signers", "n_left_handed_signers", "median_regions", "avg_regions", "hand_present_percent", "ci_quality", "ci_reliable", F.floor(F.col("sd_regions") * 1e6 + 0.5).alias("sd_regions_e6"))


def clip_summary(spark, sf_dir):
    return sp.clip_table(_counts(spark, sf_dir))


def _distribution(spark, sf_dir):
    return sp.region_distribution(_counts(spark, sf_dir).where("hand_role = 'dominant'"), ["keyword"])


def _e6(name):
    return F.floor(F.col(name) * 1e6 + 0.5).alias(f"{name}_e6")


def region_distribution(spark, sf_dir):
    return _distribution(spark, sf_dir).select("keyword", "region", _e6("percent"), "points", "n_clips", "n_signers")


def region_groups(spark, sf_dir):
    return sp.region_groups(_distribution(spark, sf_dir), ["keyword"]).select("keyword", "group", _e6("percent"), "points")


def central_periphery(spark, sf_dir):
    return sp.central_periphery(_distribution(spark, sf_dir), ["keyword"]).select("keyword", "dominant_region", *map(_e6, ("dominant_percent", "central_percent", "periphery_percent", "extreme_percent")))


def effect_spread(spark, sf_dir):
    return sp.effect_spread(_clips(spark, sf_dir), "region_code").select("compared_within", "n_levels", "levels_excluded_few_signers", "highest_level", "highest_mean", "lowest_level", "lowest_mean", "spread", _e6("sd_of_level_means"))


def pairwise_levels(spark, sf_dir):
    return sp.pairwise_levels(_clips(spark, sf_dir), "gender")


def bootstrap_ci(spark, sf_dir):
    return sp.bootstrap_ci(_clips(spark, sf_dir), ["keyword", "region_code", "hand_role"])


def bootstrap_difference(spark, sf_dir):
    return sp.bootstrap_difference(_clips(spark, sf_dir), "age_band")


def comparison_scoreboard(spark, sf_dir):
    return sp.scoreboard(sp.bootstrap_difference(_clips(spark, sf_dir), "gender"))


def weighted_central(spark, sf_dir):
    cells = _clips(spark, sf_dir).groupBy("keyword", "region_code").agg(F.sum("regions_used").alias("total"), F.count("*").alias("n_clips")).withColumn("percent", F.col("total") / F.col("n_clips"))
    return sp.pooled_percent(cells, ["keyword"], "percent", "n_clips").select("keyword", _e6("percent"), "n_clips")


def region_pivot(spark, sf_dir):
    return _clips(spark, sf_dir).groupBy("keyword").pivot("gender", ["female", "male"]).agg(F.sum("regions_used"))


def classify_points(spark, sf_dir):
    return _classified(spark, sf_dir).select("clip_id", F.col("point").cast("long").alias("point"), "region")


def hand_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


def normalised_points(spark, sf_dir):
    """Points normalised by shoulders that the clip's first pairs stand for."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(6)])
    x, y = geo.normalise_point(F.col("e4"), F.col("e5"), (F.col("e0") + 1.0, F.col("e1")), (F.col("e2") - 1.0, F.col("e3")), F.col("e0") * 2, F.col("vec_id") % 10 == 0)
    yaw = geo.raw_yaw(F.when(F.col("vec_id") % 2 == 0, "left").otherwise("right"), (F.col("e0"), F.col("e1")), (F.col("e2"), F.col("e3")))
    return e.select("vec_id", *[F.floor(v * 1e6 + 0.5).alias(n) for n, v in (("x_e6", x), ("y_e6", y), ("yaw_e6", yaw))])


def gap_interpolate(spark, sf_dir):
    return se.fill_gaps(series(spark, sf_dir), max_gap=1).select("clip_id", F.col("frame").cast("long").alias("frame"), _e6("filled"), "source")


def gap_fill_edges(spark, sf_dir):
    return se.fill_gaps(series(spark, sf_dir), 0, True).select("clip_id", F.col("frame").cast("long").alias("frame"), _e6("filled"), "source")


def median_filter(spark, sf_dir):
    return se.filtered(series(spark, sf_dir), se.median_filter(F.col("values")), "smooth").select("clip_id", "frame", _e6("smooth"))


def moving_average(spark, sf_dir):
    return se.filtered(series(spark, sf_dir), se.moving_average(F.col("values")), "smooth").select("clip_id", "frame", _e6("smooth"))


def yaw_series(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("value", F.col("value") / 1000.0)
    return se.yaw_of_clips(s).select("clip_id", "frame", _e6("yaw"))


def compound_groups(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.length("text") % 3 == 0).alias("opens"), (F.length("text") % 4 == 0).alias("closes"))
    return se.compound_groups(turns, "conv_id", ["turn", "role"])


QUERIES = {f.__name__: f for f in (cross_table, clip_summary, region_distribution, region_groups, central_periphery, effect_spread, pairwise_levels, bootstrap_ci, bootstrap_difference, comparison_scoreboard, weighted_central, region_pivot, classify_points, hand_counts, normalised_points, gap_interpolate, gap_fill_edges, median_filter, moving_average, yaw_series, compound_groups)}

_BAND = lambda bands: "CASE " + " ".join(f"WHEN age >= {a} AND age < {b} THEN '{n}'" for n, a, b in bands) + " ELSE 'unknown' END"
_BANDED = f"{CLIPS}, banded AS (SELECT *, {_BAND(sp.AGE_GROUPS)} AS age_group, {_BAND(sp.AGE_BANDS)} AS age_band FROM clips)"
_COLS = ["region_code", "keyword", "age_group", "age_band", "gender"]
_GROUPING = "concat_ws('+', " + ", ".join(f"CASE WHEN grouping({x}) = 0 THEN '{x}' END" for x in _COLS) + ")"
_QUALITY = lambda n: f"CASE WHEN {n} >= 8 THEN 'solid' WHEN {n} >= 5 THEN 'usable' WHEN {n} >= 3 THEN 'indicative' WHEN {n} >= 2 THEN 'unstable' ELSE 'none' END"
_RD = lambda name: f"CAST(floor({name} * 1e6 + 0.5e0) AS BIGINT) AS {name}_e6"
# Lines of the classification query: shoulders at -0.5 and 0.5, chin -0.3, face top -0.9, middle 0.8, hip 1.6, bottom 2.1.
_REGION = """CASE WHEN x BETWEEN -0.5 AND 0.5 AND y BETWEEN -0.3 AND 0.8 THEN 'upper_torso' WHEN x BETWEEN -0.5 AND 0.5 AND y BETWEEN 0.8 AND 1.6 THEN 'lower_torso'
  WHEN x BETWEEN 0.5 AND 1 AND y BETWEEN -0.9 AND -0.3 THEN 'p_upper_left' WHEN x BETWEEN -0.5 AND 0.5 AND y BETWEEN -0.9 AND -0.3 THEN 'p_upper_center' WHEN x BETWEEN -1 AND -0.5 AND y BETWEEN -0.9 AND -0.3 THEN 'p_upper_right'
  WHEN x BETWEEN 0.5 AND 1 AND y BETWEEN -0.3 AND 0.8 THEN 'p_left_upper_torso' WHEN x BETWEEN 0.5 AND 1 AND y BETWEEN 0.8 AND 1.6 THEN 'p_left_lower_torso'
  WHEN x BETWEEN -1 AND -0.5 AND y BETWEEN -0.3 AND 0.8 THEN 'p_right_upper_torso' WHEN x BETWEEN -1 AND -0.5 AND y BETWEEN 0.8 AND 1.6 THEN 'p_right_lower_torso'
  WHEN x BETWEEN 0.5 AND 1 AND y BETWEEN 1.6 AND 2.1 THEN 'p_lower_left' WHEN x BETWEEN -0.5 AND 0.5 AND y BETWEEN 1.6 AND 2.1 THEN 'p_lower_center' WHEN x BETWEEN -1 AND -0.5 AND y BETWEEN 1.6 AND 2.1 THEN 'p_lower_right'
  WHEN y < -0.9 THEN CASE WHEN x < -0.5 THEN 'ep_upper_right' WHEN x > 0.5 THEN 'ep_upper_left' ELSE 'ep_upper_center' END
  WHEN y > 2.1 THEN CASE WHEN x < -0.5 THEN 'ep_lower_right' WHEN x > 0.5 THEN 'ep_lower_left' ELSE 'ep_lower_center' END
  WHEN x < -1 THEN 'ep_right_' || CASE WHEN y < -0.3 THEN 'upper' WHEN y < 0.8 THEN 'upper_torso' WHEN y < 1.6 THEN 'lower_torso' ELSE 'lower' END
  WHEN x > 1 THEN 'ep_left_' || CASE WHEN y < -0.3 THEN 'upper' WHEN y < 0.8 THEN 'upper_torso' WHEN y < 1.6 THEN 'lower_torso' ELSE 'lower' END ELSE 'p_upper_center' END"""
_COUNTS = f"""{POINTS}, classified AS (SELECT *, {_REGION} AS region FROM points), counts AS (SELECT clip_id, keyword, 'R' || CAST(clip_id % 3 AS VARCHAR) AS region_code, CAST(clip_id % 37 AS VARCHAR) AS signer_id,
  CASE WHEN point % 2 = 0 THEN 'dominant' ELSE 'non_dominant' END AS hand_role, region, count(*) AS n FROM classified GROUP BY ALL)"""
_DIST = f"""{_COUNTS}, c AS (SELECT keyword, clip_id, signer_id, region, sum(n) AS n FROM counts WHERE hand_role = 'dominant' GROUP BY ALL), s AS (SELECT *, 100e0 * n / sum(n) OVER (PARTITION BY keyword, clip_id) AS share FROM c),
  z AS (SELECT keyword, count(DISTINCT clip_id) AS n_clips, count(DISTINCT signer_id) AS n_signers FROM s GROUP BY 1),
  dist AS (SELECT keyword, region, sum(share) / any_value(n_clips) AS percent, CAST(sum(n) AS BIGINT) AS points, any_value(n_clips) AS n_clips, any_value(n_signers) AS n_signers FROM s JOIN z USING (keyword) GROUP BY keyword, region)"""
_GROUP = "CASE " + " ".join(f"WHEN region IN ({', '.join(repr(r) for r in rs)}) THEN '{g}'" for g, rs in sp.REGION_GROUPS.items()) + " END"
_FILL = f"""{SERIES}, e AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN frame END) OVER (PARTITION BY clip_id ORDER BY frame) AS fa, min(CASE WHEN value IS NOT NULL THEN frame END) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fb FROM series),
  g AS (SELECT e.clip_id, e.frame, e.value, fa, fb, a.value AS va, b.value AS vb FROM e LEFT JOIN series a ON a.clip_id = e.clip_id AND a.frame = fa LEFT JOIN series b ON b.clip_id = e.clip_id AND b.frame = fb)"""
_LINEAR = "va + (vb - va) * (frame - fa) / CAST(fb - fa AS DOUBLE)"
_EDGED = f"{_FILL}, f AS (SELECT clip_id, frame, coalesce(CASE WHEN value IS NOT NULL THEN value WHEN fa IS NOT NULL AND fb IS NOT NULL THEN {_LINEAR} ELSE coalesce(va, vb) END, 0e0) AS v FROM g), l AS (SELECT clip_id, list(v ORDER BY frame) AS vs FROM f GROUP BY 1)"
_PAD = lambda half: f"list_transform(range(i - {half}, i + {half + 1}), lambda j: vs[greatest(1, least(len(vs), j))])"

ORACLE_SQL = {
    "cross_table": f"""WITH {_BANDED}, g AS (SELECT {_GROUPING} AS grouping, {', '.join(_COLS)}, hand_role, count(*) FILTER (WHERE hand_present) AS n_annotations, count(*) AS n_clips, count(DISTINCT signer_id) FILTER (WHERE hand_present) AS n_signers,
      count(DISTINCT signer_id) FILTER (WHERE hand_present AND handedness = 'left') AS n_left_handed_signers, sum(regions_used) FILTER (WHERE hand_present) AS total, stddev_samp(regions_used) FILTER (WHERE hand_present) AS sd_regions,
      quantile_cont(CAST(regions_used AS DOUBLE), 0.5) FILTER (WHERE hand_present) AS median_regions FROM banded GROUP BY GROUPING SETS ({', '.join('(' + ', '.join([*s, 'hand_role']) + ')' for s in _SETS)}))
    SELECT grouping, {', '.join(_COLS)}, hand_role, n_annotations, n_clips, n_signers, n_left_handed_signers, median_regions, total / CAST(n_annotations AS DOUBLE) AS avg_regions, 100e0 * n_annotations / n_clips AS hand_present_percent,
      {_QUALITY('n_signers')} AS ci_quality, n_signers >= 5 AS ci_reliable, {_RD('sd_regions')} FROM g WHERE n_annotations > 0""",
    "clip_summary": f"""WITH {_COUNTS} SELECT clip_id, hand_role, min(keyword) AS keyword, min(region_code) AS region_code, min(signer_id) AS signer_id, CAST(sum(n) AS BIGINT) AS total_points, count(*) AS regions_used, string_agg(region, ';' ORDER BY region) AS used_regions, true AS hand_present FROM counts GROUP BY 1, 2""",
    "region_distribution": f"WITH {_DIST} SELECT keyword, region, {_RD('percent')}, points, n_clips, n_signers FROM dist",
    "region_groups": f"WITH {_DIST}, g AS (SELECT keyword, {_GROUP} AS \"group\", sum(percent) AS percent, CAST(sum(points) AS BIGINT) AS points FROM dist GROUP BY 1, 2) SELECT keyword, \"group\", {_RD('percent')}, points FROM g",
    "central_periphery": f"""WITH {_DIST}, g AS (SELECT keyword, arg_max(region, (floor(percent * 1e6 + 0.5e0), region)) AS dominant_region, max(percent) AS dominant_percent, sum(CASE WHEN region IN ('upper_torso', 'lower_torso') THEN percent ELSE 0e0 END) AS central_percent,
      sum(CASE WHEN region LIKE 'p\\_%' ESCAPE '\\' THEN percent ELSE 0e0 END) AS periphery_percent, sum(CASE WHEN region LIKE 'ep\\_%' ESCAPE '\\' THEN percent ELSE 0e0 END) AS extreme_percent FROM dist GROUP BY 1)
    SELECT keyword, dominant_region, {', '.join(map(_RD, ('dominant_percent', 'central_percent', 'periphery_percent', 'extreme_percent')))} FROM g""",
    "effect_spread": f"""WITH {CLIPS}, l AS (SELECT keyword AS compared_within, region_code AS level, sum(regions_used) / CAST(count(*) AS DOUBLE) AS mean, count(DISTINCT signer_id) AS s FROM clips WHERE hand_role = 'dominant' AND hand_present GROUP BY 1, 2),
      g AS (SELECT compared_within, count(*) FILTER (WHERE s >= 5) AS n_levels, count(*) FILTER (WHERE s < 5) AS levels_excluded_few_signers, arg_min(level, (-mean, level)) FILTER (WHERE s >= 5) AS highest_level, max(mean) FILTER (WHERE s >= 5) AS highest_mean,
        arg_min(level, (mean, level)) FILTER (WHERE s >= 5) AS lowest_level, min(mean) FILTER (WHERE s >= 5) AS lowest_mean, stddev_samp(mean) FILTER (WHERE s >= 5) AS sd_of_level_means FROM l GROUP BY 1)
    SELECT compared_within, n_levels, levels_excluded_few_signers, highest_level, highest_mean, lowest_level, lowest_mean, highest_mean - lowest_mean AS spread, {_RD('sd_of_level_means')} FROM g WHERE n_levels >= 2""",
    "pairwise_levels": f"""WITH {CLIPS}, l AS (SELECT keyword, gender, sum(regions_used) / CAST(count(*) AS DOUBLE) AS mean, count(*) AS n_clips, count(DISTINCT signer_id) AS n_signers FROM clips WHERE hand_role = 'dominant' AND hand_present GROUP BY 1, 2)
    SELECT a.keyword AS compared_within, a.gender AS level_a, a.mean AS mean_a, a.n_clips AS n_clips_a, a.n_signers AS n_signers_a, b.gender AS level_b, b.mean AS mean_b, b.n_clips AS n_clips_b, b.n_signers AS n_signers_b, a.mean - b.mean AS difference,
      {_QUALITY('a.n_signers')} AS quality_a, {_QUALITY('b.n_signers')} AS quality_b FROM l a JOIN l b ON a.keyword = b.keyword AND a.gender < b.gender""",
    "weighted_central": f"WITH {CLIPS}, g AS (SELECT keyword, sum(regions_used) / CAST(count(*) AS DOUBLE) AS percent, count(*) AS n_clips FROM clips GROUP BY 1) SELECT keyword, {_RD('percent')}, n_clips FROM g",
    "region_pivot": f"WITH {CLIPS} SELECT keyword, CAST(sum(regions_used) FILTER (WHERE gender = 'female') AS BIGINT) AS female, CAST(sum(regions_used) FILTER (WHERE gender = 'male') AS BIGINT) AS male FROM clips GROUP BY 1",
    "classify_points": f"WITH {_COUNTS} SELECT clip_id, point, region FROM classified",
    "hand_counts": f"WITH {_COUNTS} SELECT * FROM counts",
    "normalised_points": """WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS e0, CAST(embedding[2] AS DOUBLE) AS e1, CAST(embedding[3] AS DOUBLE) AS e2, CAST(embedding[4] AS DOUBLE) AS e3, CAST(embedding[5] AS DOUBLE) AS e4, CAST(embedding[6] AS DOUBLE) AS e5 FROM embeddings),
      s AS (SELECT *, e0 + 1 - (e2 - 1) AS dx, e1 - e3 AS dy, e4 - (e0 + e2) / 2 AS px, e5 - (e1 + e3) / 2 AS py FROM e), n AS (SELECT *, atan2(dy, dx) AS t, sqrt(dx * dx + dy * dy) AS len FROM s),
      r AS (SELECT vec_id, (px * cos(t) + py * sin(t)) / len / CASE WHEN e0 = 0 THEN 1 ELSE greatest(cos(e0 * 2), 0.34e0) END * CASE WHEN vec_id % 10 = 0 THEN -1 ELSE 1 END AS x, (py * cos(t) - px * sin(t)) / len AS y,
        abs(atan2(abs(e1 - e3), abs(e0 - e2) + 1e-6)) * CASE WHEN vec_id % 2 = 0 THEN 1 ELSE -1 END AS yaw FROM n)
    SELECT vec_id, CAST(floor(x * 1e6 + 0.5e0) AS BIGINT) AS x_e6, CAST(floor(y * 1e6 + 0.5e0) AS BIGINT) AS y_e6, CAST(floor(yaw * 1e6 + 0.5e0) AS BIGINT) AS yaw_e6 FROM r""",
    "gap_interpolate": f"""WITH {_FILL}, f AS (SELECT clip_id, frame, CASE WHEN value IS NOT NULL THEN value WHEN fb - fa - 1 <= 1 THEN {_LINEAR} END AS filled, CASE WHEN value IS NOT NULL THEN 'observed' WHEN fb - fa - 1 <= 1 THEN 'interpolated' ELSE 'missing' END AS source FROM g)
    SELECT clip_id, frame, {_RD('filled')}, source FROM f""",
    "gap_fill_edges": f"""WITH {_FILL}, f AS (SELECT clip_id, frame, CASE WHEN value IS NOT NULL THEN value WHEN fa IS NOT NULL AND fb IS NOT NULL THEN {_LINEAR} ELSE coalesce(va, vb) END AS filled,
      CASE WHEN value IS NOT NULL THEN 'observed' WHEN fa IS NOT NULL AND fb IS NOT NULL THEN 'interpolated' WHEN coalesce(va, vb) IS NOT NULL THEN 'nearest' ELSE 'missing' END AS source FROM g) SELECT clip_id, frame, {_RD('filled')}, source FROM f""",
    "median_filter": f"WITH {_EDGED}, m AS (SELECT clip_id, unnest(range(1, len(vs) + 1)) AS i, vs FROM l), s AS (SELECT clip_id, i AS frame, list_sort({_PAD(3)})[4] AS smooth FROM m) SELECT clip_id, frame, {_RD('smooth')} FROM s",
    "moving_average": f"WITH {_EDGED}, m AS (SELECT clip_id, unnest(range(1, len(vs) + 1)) AS i, vs FROM l), s AS (SELECT clip_id, i AS frame, list_sum({_PAD(7)}) / 15 AS smooth FROM m) SELECT clip_id, frame, {_RD('smooth')} FROM s",
    "compound_groups": """WITH RECURSIVE t AS (SELECT conv_id, turn, role, length(text) % 3 = 0 AS opens, length(text) % 4 = 0 AS closes, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS i FROM conversations),
      w AS (SELECT *, false AS was FROM t WHERE i = 1 UNION ALL SELECT t.*, CASE WHEN w.was THEN NOT w.closes ELSE w.opens END FROM w JOIN t ON t.conv_id = w.conv_id AND t.i = w.i + 1)
    SELECT conv_id, turn, role, opens, closes, was OR opens AS in_compound FROM w""",
}
