"""Signing-space summaries: clip tables, group summaries, region shares, comparisons, bootstrap.

A clip table has clip_id, keyword, region_code, signer_id, handedness, age_group, age_band, gender,
hand_role, hand_present and regions_used. Intervals resample signers, not clips: each signer's sum and
count are what a resample needs, so a cell sends one row per signer to its interval.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Regions in the order in which they are tested, their groups, bands and tiers.
CORE_REGIONS = ("upper_torso", "lower_torso", "p_upper_left", "p_upper_center", "p_upper_right", "p_left_upper_torso", "p_left_lower_torso", "p_right_upper_torso", "p_right_lower_torso", "p_lower_left", "p_lower_center", "p_lower_right")
EXTREME_REGIONS = ("ep_upper_left", "ep_upper_center", "ep_upper_right", "ep_left_upper", "ep_left_upper_torso", "ep_left_lower_torso", "ep_left_lower", "ep_right_upper", "ep_right_upper_torso", "ep_right_lower_torso", "ep_right_lower", "ep_lower_left", "ep_lower_center", "ep_lower_right")
REGION_GROUPS = {
    "central torso": ("upper_torso", "lower_torso"),
    "upper/head periphery": ("p_upper_left", "p_upper_center", "p_upper_right"),
    "side periphery": ("p_left_upper_torso", "p_left_lower_torso", "p_right_upper_torso", "p_right_lower_torso"),
    "below torso periphery": ("p_lower_left", "p_lower_center", "p_lower_right"),
    "extreme periphery": EXTREME_REGIONS,
}
AGE_GROUPS = (("<20", 0, 20), ("20", 20, 30), ("30", 30, 40), ("40", 40, 50), ("50", 50, 60), ("60", 60, 70), ("70", 70, 80), ("80", 80, 200))
AGE_BANDS = (("<50", 0, 50), ("50+", 50, 200))
QUALITY_TIERS = ((8, "solid"), (5, "usable"), (3, "indicative"), (2, "unstable"))
STABLE_SIGNERS = 5
ITERATIONS, CONFIDENCE, SEED = 2000, 0.95, 20260806
#: Draws of a bootstrap that are held at once; more are drawn in turn.
DRAWS = 4_000_000


def bucket(value: Column, bands: Sequence[tuple[str, float, float]]) -> Column:
    """Label of the half-open band that holds a value."""
    return reduce(lambda out, b: F.when((value >= b[1]) & (value < b[2]), b[0]).otherwise(out), reversed(bands), F.lit("unknown"))


def ci_quality(n_signers: Column) -> Column:
    """How far an interval from so many signers can be trusted."""
    return reduce(lambda out, t: F.when(n_signers >= t[0], t[1]).otherwise(out), reversed(QUALITY_TIERS), F.lit("none"))


def normalise_gender(value: Column) -> Column:
    """male, female or unknown."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(v.isin("m", "male", "man", "男", "男性"), "male").when(v.isin("f", "female", "woman", "女", "女性"), "female").otherwise("unknown")


def infer_side(signer: Column, forced: str | None = None, overrides: dict[str, str] | None = None) -> Column:
    """Which half of the frame a signer sits in: a forced side, that of the first override whose key the name holds, else right
    where the first number of the name is odd and left where it is even or missing."""
    if forced in ("left", "right"):
        return F.lit(forced)
    odd = F.regexp_extract(F.coalesce(signer, F.lit("")), r"(\d+)", 1).rlike("[13579]$")
    side = F.when(odd, "right").otherwise("left")
    for key, own in reversed([(k, v) for k, v in (overrides or {}).items() if k]):
        side = F.when(signer.contains(key), own).otherwise(side)
    return side


def to_seconds(time: Column) -> Column:
    """A time in seconds: numbers above 1000 are milliseconds, others seconds already; text that is no number is null."""
    number = time.try_cast("double")
    return F.when(number > 1000, number / 1000.0).otherwise(number)


def clip_table(counts: DataFrame) -> DataFrame:
    """One row per clip and hand role from long counts (clip_id, hand_role, region, n and clip columns)."""
    seen = F.col("region") != "missing"
    per_region = counts.groupBy("clip_id", "hand_role", "region").agg(F.sum("n").alias("n"), *[F.min(c).alias(c) for c in ("keyword", "region_code", "signer_id")])
    used = F.when(seen & (F.col("n") > 0), F.col("region"))
    return per_region.groupBy("clip_id", "hand_role").agg(*[F.min(c).alias(c) for c in ("keyword", "region_code", "signer_id")], F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)).alias("total_points"), F.count(used).alias("regions_used"), F.array_join(F.array_sort(F.collect_list(used)), ";").alias("used_regions")).withColumn("hand_present", F.col("total_points") > 0)


def summarise(clips: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Counts, means and spreads of regions used for several groupings in one pass.

    Each grouping also splits by hand role; columns outside a row's grouping are null, and ``grouping`` names
    it. Cells without a present hand are left out.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    present = F.col("hand_present")
    value = F.when(present, F.col("regions_used"))
    rows = clips.groupingSets([[*s, "hand_role"] for s in sets], *columns, "hand_role").agg(
        F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns]).alias("grouping"),
        F.count_if(present).alias("n_annotations"), F.count("*").alias("n_clips"), F.count_distinct(F.when(present, F.col("signer_id"))).alias("n_signers"),
        F.count_distinct(F.when(present & (F.col("handedness") == "left"), F.col("signer_id"))).alias("n_left_handed_signers"),
        F.sum(value).alias("sum_regions"), F.stddev_samp(value).alias("sd_regions"), F.percentile(value, 0.5).alias("median_regions"),
    ).where("n_annotations > 0")
    return rows.withColumns({"avg_regions": F.col("sum_regions") / F.col("n_annotations"), "hand_present_percent": F.lit(100.0) * F.col("n_annotations") / F.col("n_clips"), "ci_quality": ci_quality(F.col("n_signers")), "ci_reliable": F.col("n_signers") >= STABLE_SIGNERS}).drop("sum_regions")


def region_distribution(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of points per region, averaged over clips so that a long clip counts once."""
    rows = counts.where(F.col("region") != "missing").groupBy(*keys, "clip_id", "signer_id", "region").agg(F.sum("n").alias("n"))
    per_clip = rows.withColumn("share", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "clip_id")))
    sizes = per_clip.groupBy(*keys).agg(F.count_distinct("clip_id").alias("n_clips"), F.count_distinct("signer_id").alias("n_signers"))
    out = per_clip.groupBy(*keys, "region").agg(F.sum("share").alias("shares"), F.sum("n").alias("points")).join(sizes, list(keys))
    return out.select(*keys, "region", (F.col("shares") / F.col("n_clips")).alias("percent"), "points", "n_clips", "n_signers")


def group_of(region: Column) -> Column:
    """Anatomical group of a region."""
    return reduce(lambda out, g: F.when(region.isin(*g[1]), g[0]).otherwise(out), REGION_GROUPS.items(), F.lit(None).cast("string"))


def region_groups(distribution: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Region shares summed over anatomical groups."""
    return distribution.groupBy(*keys, group_of(F.col("region")).alias("group")).agg(F.sum("percent").alias("percent"), F.sum("points").alias("points"))


def central_periphery(distribution: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The leading region and the central, peripheral and extreme shares; ties by region name."""
    share = lambda cond: F.sum(F.when(cond, F.col("percent")).otherwise(0.0))
    r = F.col("region")
    return distribution.groupBy(*keys).agg(
        F.max_by("region", F.struct(F.floor(F.col("percent") * 1e6 + 0.5), r)).alias("dominant_region"), F.max("percent").alias("dominant_percent"), share(r.isin(*REGION_GROUPS["central torso"])).alias("central_percent"), share(r.startswith("p_")).alias("periphery_percent"), share(r.startswith("ep_")).alias("extreme_percent")
    )


def _present(clips: DataFrame, role: str) -> DataFrame:
    return clips.where((F.col("hand_role") == role) & F.col("hand_present"))


def level_means(clips: DataFrame, group: str, within: str = "keyword", role: str = "dominant", value: str = "regions_used") -> DataFrame:
    """Mean, clips and signers of every level."""
    rows = _present(clips, role).groupBy(F.col(within).alias("compared_within"), F.col(group).alias("level")).agg(F.sum(value).alias("total"), F.count("*").alias("n_clips"), F.count_distinct("signer_id").alias("n_signers"))
    return rows.withColumn("mean", F.col("total") / F.col("n_clips")).drop("total")


def effect_spread(clips: DataFrame, group: str, min_signers: int = STABLE_SIGNERS, **kw: str) -> DataFrame:
    """How far apart the means of well-sampled levels are; ties by level name."""
    levels = level_means(clips, group, **kw)
    kept = F.col("n_signers") >= min_signers
    mean = F.when(kept, F.col("mean"))
    out = levels.groupBy("compared_within").agg(
        F.count_if(kept).alias("n_levels"), F.count_if(~kept).alias("levels_excluded_few_signers"), (F.max(mean) - F.min(mean)).alias("spread"), F.stddev_samp(mean).alias("sd_of_level_means"),
        F.min_by("level", F.when(kept, F.struct(-F.col("mean"), F.col("level")))).alias("highest_level"), F.max(mean).alias("highest_mean"), F.min_by("level", F.when(kept, F.struct("mean", "level"))).alias("lowest_level"), F.min(mean).alias("lowest_mean"),
    )
    return out.where("n_levels >= 2")


def pairwise_levels(clips: DataFrame, group: str, **kw: str) -> DataFrame:
    """Every pair of levels within each category: means, sizes and their difference. Levels are few."""
    levels = level_means(clips, group, **kw)
    a = levels.select("compared_within", *[F.col(c).alias(f"{c}_a") for c in ("level", "mean", "n_clips", "n_signers")])
    b = levels.select("compared_within", *[F.col(c).alias(f"{c}_b") for c in ("level", "mean", "n_clips", "n_signers")])
    return a.join(b, "compared_within").where("level_a < level_b").withColumns({"difference": F.col("mean_a") - F.col("mean_b"), "quality_a": ci_quality(F.col("n_signers_a")), "quality_b": ci_quality(F.col("n_signers_b"))})


def bootstrap_mean(sums: np.ndarray, counts: np.ndarray, iterations: int = ITERATIONS, confidence: float = CONFIDENCE, seed: int = SEED) -> tuple[float, float]:
    """Percentile interval of the pooled mean over signers given by their sums and counts, in id order."""
    n = len(sums)
    if n < 2:
        return float("nan"), float("nan")
    # One generator in rows of draws, as many at once as fit DRAWS: the same draws as all at once.
    rng, means = np.random.default_rng(seed), np.empty(iterations)
    step = max(1, DRAWS // n)
    for i in range(0, iterations, step):
        drawn = rng.integers(0, n, size=(min(step, iterations - i), n))
        means[i : i + step] = sums[drawn].sum(axis=1) / counts[drawn].sum(axis=1)
    alpha = (1 - confidence) / 2
    low, high = np.percentile(means, [100 * alpha, 100 * (1 - alpha)])
    return float(low), float(high)


def bootstrap_pair(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], iterations: int = ITERATIONS, confidence: float = CONFIDENCE, seed: int = SEED) -> tuple[float, float, float]:
    """Interval of the difference of two pooled means, and the share of resamples with the first above."""
    (sa, ca), (sb, cb) = a, b
    if len(sa) < 2 or len(sb) < 2:
        return float("nan"), float("nan"), float("nan")
    rng, out = np.random.default_rng(seed), np.empty(iterations)
    for i in range(iterations):  # one generator: the first group draws before the second in each round
        x, y = rng.integers(0, len(sa), len(sa)), rng.integers(0, len(sb), len(sb))
        out[i] = sa[x].sum() / ca[x].sum() - sb[y].sum() / cb[y].sum()
    alpha = (1 - confidence) / 2
    low, high = np.percentile(out, [100 * alpha, 100 * (1 - alpha)])
    return float(low), float(high), float((out > 0).mean())


def _signer_sums(frame: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    per_signer = frame.groupBy(*keys, "signer_id").agg(F.sum(value).cast("double").alias("s"), F.count(value).cast("double").alias("c"))
    return per_signer.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("signer_id", "s", "c"))).alias("signers"))


def bootstrap_ci(clips: DataFrame, keys: Sequence[str], value: str = "regions_used") -> DataFrame:
    """Signer-level interval of the mean of every cell; a cell's array has one entry per signer."""
    cells = _signer_sums(clips.where("hand_present"), keys, value)

    @F.pandas_udf("struct<low:double,high:double>")
    def interval(sums, counts):
        import pandas as pd

        found = [bootstrap_mean(np.asarray(s, float), np.asarray(c, float)) for s, c in zip(sums, counts, strict=True)]
        return pd.DataFrame(found, columns=["low", "high"])

    ci = F.when(F.size("signers") >= 2, interval("signers.s", "signers.c"))
    out = cells.select(*keys, F.size("signers").alias("n_signers"), ci.alias("ci"))
    return out.select(*keys, "n_signers", F.col("ci.low").alias("ci_low"), F.col("ci.high").alias("ci_high"), ci_quality(F.col("n_signers")).alias("ci_quality"))


def bootstrap_difference(clips: DataFrame, group: str, within: str = "keyword", role: str = "dominant", value: str = "regions_used") -> DataFrame:
    """Interval of the difference of every pair of levels within each category."""
    cells = _signer_sums(_present(clips, role), [within, group], value)
    a = cells.select(F.col(within).alias("compared_within"), F.col(group).alias("level_a"), F.col("signers").alias("a"))
    b = cells.select(F.col(within).alias("compared_within"), F.col(group).alias("level_b"), F.col("signers").alias("b"))

    @F.pandas_udf("struct<low:double,high:double,above:double>")
    def interval(a, b):
        import pandas as pd

        side = lambda cell: (np.array([x["s"] for x in cell]), np.array([x["c"] for x in cell]))
        return pd.DataFrame([bootstrap_pair(side(x), side(y)) for x, y in zip(a, b, strict=True)], columns=["low", "high", "above"])

    pairs = a.join(b, "compared_within").where("level_a < level_b").where((F.size("a") >= 2) & (F.size("b") >= 2)).withColumn("ci", interval("a", "b"))
    return pairs.select("compared_within", "level_a", "level_b", F.size("a").alias("n_signers_a"), F.size("b").alias("n_signers_b"), F.col("ci.low").alias("diff_ci_low"), F.col("ci.high").alias("diff_ci_high"), F.col("ci.above").alias("p_a_greater"), ((F.col("ci.low") > 0) | (F.col("ci.high") < 0)).alias("separates"))


def scoreboard(differences: DataFrame) -> DataFrame:
    """How many pairs separate, and how many of the reliable ones."""
    reliable = (F.col("n_signers_a") >= STABLE_SIGNERS) & (F.col("n_signers_b") >= STABLE_SIGNERS)
    return differences.agg(F.count("*").alias("n_pairs"), F.count_if("separates").alias("n_separating"), F.count_if(reliable).alias("n_pairs_reliable"), F.count_if(reliable & F.col("separates")).alias("n_separating_reliable"))


def pooled_percent(rows: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Percentages pooled over cells, weighted by their sizes."""
    return rows.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value), F.sum(weight).alias(weight))
