"""Per-clip time series: gap filling and edge-padded filters.

Frames of a clip are few and stay together, so windows are partitioned by clip. Filters work on a
clip's array, because window frames shrink at the edges where these pad.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
HAND_GAP, MEDIAN_WINDOW, MEAN_WINDOW = 5, 7, 15
YAW_LIMIT_DEG, YAW_MIN_VALID, YAW_MIN_SIGNAL_DEG = 35.0, 0.25, 1.5


def fill_gaps(series: DataFrame, max_gap: int = HAND_GAP, fill_edges: bool = False) -> DataFrame:
    """Linear values inside gaps of at most ``max_gap`` frames (0: of any length), with their source.

    The series has clip_id, frame and value; edges take the nearest value only if asked to.
    """
    w = Window.partitionBy("clip_id").orderBy("frame")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    seen = F.when(F.col("value").isNotNull(), F.struct("frame", "value"))
    s = series.select("clip_id", "frame", "value", F.last(seen, True).over(back).alias("a"), F.first(seen, True).over(ahead).alias("b"))
    a, b = F.col("a"), F.col("b")
    gap = b["frame"] - a["frame"] - 1
    between = a.isNotNull() & b.isNotNull() & ((gap <= max_gap) if max_gap else F.lit(True))
    linear = a["value"] + (b["value"] - a["value"]) * (F.col("frame") - a["frame"]) / (b["frame"] - a["frame"])
    edge = F.lit(fill_edges) & (a.isNull() | b.isNull()) & F.coalesce(a, b).isNotNull()
    value = F.when(F.col("value").isNotNull(), F.col("value").cast("double")).when(between, linear).when(edge, F.coalesce(a["value"], b["value"]).cast("double"))
    source = F.when(F.col("value").isNotNull(), "observed").when(between, "interpolated").when(edge, "nearest").otherwise("missing")
    return s.select("clip_id", "frame", value.alias("filled"), source.alias("source"))


def padded(values: Column, reach: int, at: Column) -> Column:
    """The neighbours of a position up to ``reach`` away, the ends repeated."""
    n = F.size(values)
    return F.transform(F.sequence(at - reach, at + reach), lambda j: F.element_at(values, F.least(F.greatest(j, F.lit(1)), n)))


def median_filter(values: Column, window: int = MEDIAN_WINDOW) -> Column:
    """Centred median of an array, edge-padded."""
    half = window // 2
    return F.transform(values, lambda _, i: F.element_at(F.array_sort(padded(values, half, i + 1)), half + 1))


def moving_average(values: Column, window: int = MEAN_WINDOW) -> Column:
    """Centred mean of an array, edge-padded."""
    half = window // 2
    return F.transform(values, lambda _, i: F.aggregate(padded(values, half, i + 1), F.lit(0.0), lambda t, x: t + x) / window)


def filtered(series: DataFrame, filter_: Column, name: str) -> DataFrame:
    """Apply an array filter (over ``values``) to every clip's filled series."""
    filled = fill_gaps(series, 0, True).withColumn("filled", F.coalesce("filled", F.lit(0.0)))
    arrays = filled.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "filled"))), lambda x: x["filled"]).alias("values"))
    return arrays.select("clip_id", F.posexplode(filter_).alias("i", name)).select("clip_id", (F.col("i") + 1).cast("long").alias("frame"), name)


def yaw_of_clips(series: DataFrame) -> DataFrame:
    """Per-frame smoothed yaw of every clip, in radians.

    Values are raw turns, null where not measurable. Too few measured frames, or a peak too weak to be a
    turn, give zeros. Each filter is a column of its own, so that no filter is computed again for every frame.
    """
    limit = math.radians(YAW_LIMIT_DEG)
    filled = fill_gaps(series, 0, True)
    arrays = filled.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", F.coalesce("filled", F.lit(0.0)).alias("v")))), lambda x: x["v"]).alias("values"), F.avg((F.col("source") == "observed").cast("double")).alias("valid"))
    medians = arrays.select("clip_id", "valid", median_filter(F.col("values")).alias("medians"))
    means = medians.select("clip_id", "valid", moving_average(F.col("medians")).alias("means"))
    smooth = means.select("clip_id", "valid", F.transform("means", lambda v: F.greatest(F.lit(-limit), F.least(F.lit(limit), v))).alias("smooth"))
    usable = (F.col("valid") >= YAW_MIN_VALID) & (F.array_max(F.transform("smooth", F.abs)) >= math.radians(YAW_MIN_SIGNAL_DEG))
    yaw = F.when(usable, F.col("smooth")).otherwise(F.transform("smooth", lambda _: F.lit(0.0)))
    return smooth.select("clip_id", F.posexplode(yaw).alias("i", "yaw")).select("clip_id", (F.col("i") + 1).cast("long").alias("frame"), "yaw")


def compound_groups(rows: DataFrame, document: str, order: list[str]) -> DataFrame:
    """Rows inside a compound group, over a document's whole row order.

    Columns opens and closes say whether a row holds an opening or closing mark. A lone opening starts a
    group and a lone closing ends one; a row with both toggles: it ends the group it is in, or starts one.
    A row is inside if the group stood open before it or it opens one.
    """
    w = Window.partitionBy(document).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    reset = F.when(F.col("opens") & ~F.col("closes"), 1).when(~F.col("opens") & F.col("closes"), 0)
    both = (F.col("opens") & F.col("closes")).cast("int")
    r = rows.withColumns({"__reset": reset, "__toggles": F.sum(both).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    mark = F.struct(F.col("__reset").alias("state"), F.col("__toggles").alias("toggles"))
    last = F.last(F.when(F.col("__reset").isNotNull(), mark), True).over(before)
    passed = F.coalesce(F.sum(both).over(before), F.lit(0))
    r = r.withColumns({"__last": last, "__passed": passed})
    since = F.col("__passed") - F.coalesce(F.col("__last.toggles"), F.lit(0))
    was_open = (F.coalesce(F.col("__last.state"), F.lit(0)) + since) % 2 == 1
    return r.withColumn("in_compound", was_open | F.col("opens")).drop("__reset", "__toggles", "__last", "__passed")
