"""The report's tables as small frames: pivots by hand role and category, weighted shares, separation counts.

Every table is a frame of as many rows as a page shows, whatever the corpus; ``sources.files.latex_table`` sets it. Inputs
are summaries: one row for each cell of the design, not for each clip.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .space import STABLE_SIGNERS

# Hand roles and the grouping variables in the order of the page.
ROLES = ("dominant", "non_dominant")
GROUPS = (("keyword", "Linguistic category"), ("region_code", "Prefecture"), ("age_group", "Age group"), ("age_band", "Age band"), ("gender", "Gender"))


def by_role(cells: DataFrame, keys: Sequence[str], values: Sequence[str], shared: Sequence[str] = ()) -> DataFrame:
    """Cells with the two hand roles beside each other; keys without the dominant hand are left out.

    ``shared`` columns are those of the dominant hand, ``values`` stand once for each role. One row per key and role is
    expected; of several the first in the order of all values counts.
    """
    dominant = F.col("hand_role") == ROLES[0]
    first = lambda c, role: F.min_by(c, F.when(F.col("hand_role") == role, F.struct(*values, *shared)))
    out = cells.groupBy(*keys).agg(*[first(c, ROLES[0]).alias(c) for c in shared], *[first(c, r).alias(f"{c}_{r}") for r in ROLES for c in values], F.max(dominant).alias("__has"))
    return out.where("__has").drop("__has")


def region_table(by_region: DataFrame) -> DataFrame:
    """Regions and categories down the page, the hand roles across it: clips and signers, then mean and interval of each."""
    return by_role(by_region, ["region_code", "keyword"], ["avg_regions", "ci_low", "ci_high"], ["n_annotations", "n_signers"])


def levels_table(parts: Sequence[tuple[str, DataFrame]], role: str = ROLES[0]) -> DataFrame:
    """Several groupings below each other, one hand role: grouping, level, keyword, clips, signers, mean and interval.

    parts are (column of the level, summary); the order of the parts is told by ``part``.
    """
    out = None
    for number, (column, summary) in enumerate(parts):
        rows = summary.where(F.col("hand_role") == role).select(F.lit(number).alias("part"), F.lit(column).alias("grouping"), F.col(column).cast("string").alias("level"), "keyword", "n_annotations", "n_signers", "avg_regions", "ci_low", "ci_high")
        out = rows if out is None else out.unionByName(rows)
    return out


def central_table(cells: DataFrame, shares: Sequence[str] = ("central_percent", "periphery_percent", "extreme_percent"), weight: str = "n_clips") -> DataFrame:
    """Shares of each category by hand role, averaged over cells by their clips; cells without clips weigh nothing."""
    mean = lambda c, role: F.sum(F.when(F.col("hand_role") == role, F.col(c) * F.col(weight))) / F.nullif(F.sum(F.when((F.col("hand_role") == role) & F.col(c).isNotNull(), F.col(weight))), F.lit(0))
    return cells.groupBy("keyword").agg(*[mean(c, r).alias(f"{c}_{r}") for r in ROLES for c in shares])


def separation_table(comparisons: DataFrame, role: str = ROLES[0], min_signers: int = STABLE_SIGNERS) -> DataFrame:
    """How many pairs of levels separate among those with signers enough, and the pair with the widest gap, by grouping.

    comparisons have group, hand_role, compared_within, level_a, level_b, n_signers_a, n_signers_b, difference and separates.
    Of equal gaps the first by place of comparison and levels is told; ``mostly`` says that more than half separate.
    """
    reliable = comparisons.where((F.col("hand_role") == role) & (F.col("n_signers_a") >= min_signers) & (F.col("n_signers_b") >= min_signers) & F.col("difference").isNotNull())
    order = F.struct(-F.abs("difference"), F.col("compared_within"), F.col("level_a"), F.col("level_b"))
    widest = F.min_by(F.struct("difference", "compared_within", "level_a", "level_b"), order)
    out = reliable.groupBy("group").agg(F.count_if("separates").alias("separating"), F.count("*").alias("pairs"), widest.alias("w"))
    return out.select("group", "separating", "pairs", F.abs("w.difference").alias("widest_gap"), F.col("w.level_a").alias("level_a"), F.col("w.level_b").alias("level_b"), F.col("w.compared_within").alias("compared_within"), (2 * F.col("separating") > F.col("pairs")).alias("mostly"))


def spread_table(spread: DataFrame, categories: Sequence[str], role: str = ROLES[0]) -> DataFrame:
    """Highest less lowest level mean of each grouping, a column for each category; the categories' own row is their mean.

    spread has group, hand_role, compared_within and spread.
    """
    rows = spread.where(F.col("hand_role") == role)
    own = F.col("group") == "keyword"
    cell = lambda c: F.min(F.when(~own & (F.col("compared_within") == c), F.col("spread")))
    return rows.groupBy("group").agg(F.avg(F.when(own, F.col("spread"))).alias("pooled"), *[cell(c).alias(c) for c in categories])


def page_order(group: Column) -> Column:
    """Place of a grouping variable on the page; unknown ones come last."""
    place = F.lit(len(GROUPS))
    for k, (name, _) in reversed(list(enumerate(GROUPS))):
        place = F.when(group == name, k).otherwise(place)
    return place
