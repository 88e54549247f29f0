"""Points in signing space: normalisation, reference lines, regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .space import CORE_REGIONS

# Fixed values, in shoulder widths and degrees.
SIDE_PERIPHERY, FALLBACK_FACE_TOP, FACE_HEIGHT = 0.5, -1.05, 0.55
TORSO_HEIGHT, LOWER_FRACTION, MIN_WIDTH = 1.6, 0.5, 0.5
CHIN_RANGE, FACE_TOP_RANGE = (-1.2, 0.25), (-1.8, -0.15)
MIN_COS, YAW_GAIN, MIN_VISIBILITY = 0.34, 1.0, 0.25


def normalise_point(x: Column, y: Column, left: tuple[Column, Column], right: tuple[Column, Column], yaw: Column | None = None, mirror: Column | None = None) -> tuple[Column, Column]:
    """A point with the shoulders' midpoint as origin, their line as x-axis and their distance as unit.

    The signer's right shoulder is on the image's left. Yaw undoes foreshortening, mirroring follows.
    """
    dx, dy = left[0] - right[0], left[1] - right[1]
    length = F.hypot(dx, dy)
    scale = F.when(length == 0, 1.0).otherwise(length)
    angle = F.atan2(dy, dx)
    px, py = x - (left[0] + right[0]) / 2, y - (left[1] + right[1]) / 2
    nx, ny = (px * F.cos(angle) + py * F.sin(angle)) / scale, (py * F.cos(angle) - px * F.sin(angle)) / scale
    if yaw is not None:
        nx = F.when(yaw.isNull() | F.isnan(yaw) | (yaw == 0), nx).otherwise(nx / F.greatest(F.cos(yaw), F.lit(MIN_COS)))
    if mirror is not None:
        nx = F.when(mirror, -nx).otherwise(nx)
    return nx, ny


def shoulders_ok(left_visibility: Column, right_visibility: Column) -> Column:
    """Both shoulders visible enough to normalise by."""
    return (left_visibility >= MIN_VISIBILITY) & (right_visibility >= MIN_VISIBILITY)


def raw_yaw(side: Column, left: tuple[Column, Column], right: tuple[Column, Column]) -> Column:
    """Turn of a frame from the shoulders' (x, z); the sign follows the camera side."""
    turn = F.abs(F.atan2(F.lit(YAW_GAIN) * F.abs(left[1] - right[1]), F.abs(left[0] - right[0]) + 1e-6))
    return F.when(F.lower(side) == "left", turn).otherwise(-turn)


def reference_lines(left_x: Column, right_x: Column, chin_y: Column, face_top_y: Column) -> dict[str, Column]:
    """The lines that bound the regions, from normalised shoulders and face (null or NaN where not seen)."""
    low, high = F.least(left_x, right_x), F.greatest(left_x, right_x)
    within = lambda c, r: c.isNotNull() & ~F.isnan(c) & (c >= r[0]) & (c <= r[1])
    chin = F.when(within(chin_y, CHIN_RANGE), chin_y).otherwise(0.0)
    top = F.when(within(face_top_y, FACE_TOP_RANGE), face_top_y).otherwise(FALLBACK_FACE_TOP)
    top = F.when(top >= chin, chin - FACE_HEIGHT).otherwise(top)
    width = F.greatest(high - low, F.lit(MIN_WIDTH))
    hip = width * TORSO_HEIGHT
    return {"right": low, "left": high, "outer_right": low - SIDE_PERIPHERY, "outer_left": high + SIDE_PERIPHERY, "top": top, "chin": chin, "mid": hip / 2, "hip": hip, "bottom": hip + width * LOWER_FRACTION}


def classify_point(x: Column, y: Column, lines: dict[str, Column]) -> Column:
    """Region of a point: the first core rectangle that holds it, else the sector outside."""
    columns = {"right": (lines["outer_right"], lines["right"]), "center": (lines["right"], lines["left"]), "left": (lines["left"], lines["outer_left"])}
    rows = {"upper": (lines["top"], lines["chin"]), "upper_torso": (lines["chin"], lines["mid"]), "lower_torso": (lines["mid"], lines["hip"]), "lower": (lines["hip"], lines["bottom"])}
    inside = lambda c, r: (x >= columns[c][0]) & (x <= columns[c][1]) & (y >= rows[r][0]) & (y <= rows[r][1])

    def holds(name: str) -> Column:
        if not name.startswith("p_"):
            return inside("center", name)
        first, second = name[2:].split("_", 1)
        return inside(second, first) if first in ("upper", "lower") else inside(first, second)

    across = lambda stem: F.when(x < lines["right"], f"{stem}_right").when(x > lines["left"], f"{stem}_left").otherwise(f"{stem}_center")
    down = lambda stem: F.when(y < lines["chin"], f"{stem}_upper").when(y < lines["mid"], f"{stem}_upper_torso").when(y < lines["hip"], f"{stem}_lower_torso").otherwise(f"{stem}_lower")
    outside = F.when(y < lines["top"], across("ep_upper")).when(y > lines["bottom"], across("ep_lower")).when(x < lines["outer_right"], down("ep_right")).when(x > lines["outer_left"], down("ep_left")).otherwise("p_upper_center")
    core = reduce(lambda out, name: F.when(holds(name), name).otherwise(out), reversed(CORE_REGIONS), outside)
    finite = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    return F.when(finite, core).otherwise("missing")


def points_inside_frame(points: Column) -> Column:
    """How many points (x, y) lie within the frame and a small margin."""
    return F.size(F.filter(points, lambda p: p["x"].between(-0.05, 1.05) & p["y"].between(-0.05, 1.05)))


def by_role(handedness: Column, left: Column, right: Column) -> tuple[Column, Column]:
    """(dominant, non-dominant) of two hands' values."""
    swap = F.lower(handedness) == "left"
    return F.when(swap, left).otherwise(right), F.when(swap, right).otherwise(left)


def region_counts(frames: DataFrame) -> DataFrame:
    """Points of each hand role by region, per frame: clip_id, frame, hand_role, region, n.

    Every frame has rows for both roles: where a role counts nothing, one of region missing with n 0.

    Frames have clip_id, frame, handedness, yaw, left_shoulder and right_shoulder (x, y, v), chin and
    face_top (x, y), left_hand and right_hand (arrays of x, y). Frames without visible shoulders, and hands
    with a point that is not finite, count nothing. Left-handers are mirrored, so roles pool.
    """
    left, right = F.col("left_shoulder"), F.col("right_shoulder")
    pair = (left["x"], left["y"]), (right["x"], right["y"])
    mirror = F.lower("handedness") == "left"

    def normal(p: Column) -> tuple[Column, Column]:
        return normalise_point(p["x"], p["y"], *pair, F.col("yaw"), mirror)

    good = frames.where(shoulders_ok(left["v"], right["v"]))
    lines = reference_lines(normal(left)[0], normal(right)[0], normal(F.col("chin"))[1], normal(F.col("face_top"))[1])
    dominant, other = by_role(F.col("handedness"), F.col("left_hand"), F.col("right_hand"))
    roles = F.explode(F.array(F.struct(F.lit("dominant").alias("hand_role"), dominant.alias("points")), F.struct(F.lit("non_dominant").alias("hand_role"), other.alias("points"))))
    hands = good.select("*", *[v.alias(f"__{k}") for k, v in lines.items()], roles.alias("hand"))
    finite = F.forall("hand.points", lambda p: ~(F.isnan(p["x"]) | F.isnan(p["y"]) | p["x"].isNull() | p["y"].isNull()))
    points = hands.where(finite).select("*", F.explode("hand.points").alias("p"))
    x, y = normal(F.col("p"))
    placed = points.select("clip_id", "frame", F.col("hand.hand_role").alias("hand_role"), x.alias("x"), y.alias("y"), *[f"__{k}" for k in lines])
    region = classify_point(F.col("x"), F.col("y"), {k: F.col(f"__{k}") for k in lines})
    counted = placed.groupBy("clip_id", "frame", "hand_role", region.alias("region")).agg(F.count("*").alias("n"))
    every = frames.select("clip_id", "frame", F.explode(F.array(F.lit("dominant"), F.lit("non_dominant"))).alias("hand_role"))
    joined = every.join(counted, ["clip_id", "frame", "hand_role"], "left")
    return joined.select("clip_id", "frame", "hand_role", F.coalesce("region", F.lit("missing")).alias("region"), F.coalesce("n", F.lit(0)).alias("n"))


def mask_runs(mask: Column) -> Column:
    """The runs of ones of a mask's row (an array of 0 and 1): array of (first, last), from 0."""
    at = F.sequence(F.lit(0), F.size(mask) - 1)
    starts = F.filter(at, lambda i: (F.get(mask, i) == 1) & ((i == 0) | (F.coalesce(F.get(mask, i - 1), F.lit(0)) != 1)))
    ends = F.filter(at, lambda i: (F.get(mask, i) == 1) & (F.coalesce(F.get(mask, i + 1), F.lit(0)) != 1))
    return F.when(F.size(mask) > 0, F.transform(F.arrays_zip(starts.alias("first"), ends.alias("last")), lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last")))).otherwise(F.array().cast("array<struct<first:int,last:int>>"))


def on_target(points: DataFrame, runs: DataFrame, keys: list[str], min_fraction: float = 0.6, dilate: int = 0) -> DataFrame:
    """Whether enough of the points of each key lie on its mask: keys, n_points, inside (fraction) and on_target.

    points have the keys, x and y normalised to the frame and its width and height in pixels; runs have the keys, row, first
    and last of the mask's runs of pixels, so a mask is never laid out. Points outside the frame count at its edge; a
    coordinate that is missing (null or NaN) makes a point that is not on the mask. ``dilate`` widens the mask by so many
    pixels on all sides. Keys without points have no row, keys without a mask have no point on it.
    """
    pixel = lambda v, size: F.greatest(F.lit(0), F.least(F.rint(F.col(v) * F.col(size)), F.col(size) - 1)).cast("int")
    known = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    placed = points.where(known).select(*keys, pixel("x", "width").alias("__x"), pixel("y", "height").alias("__row")).groupBy(*keys, "__row", "__x").agg(F.count("*").alias("__n"))
    # Points of a row meet the runs of that row; equal pixels are one row with their number.
    rows = runs.select(*keys, F.explode(F.sequence(F.col("row") - dilate, F.col("row") + dilate)).alias("__row"), (F.col("first") - dilate).alias("__first"), (F.col("last") + dilate).alias("__last"))
    hit = placed.join(rows, [*keys, "__row"]).where("__x BETWEEN __first AND __last").select(*keys, "__row", "__x", "__n").distinct()
    inside = hit.groupBy(*keys).agg(F.sum("__n").alias("__inside"))
    out = points.groupBy(*keys).agg(F.count("*").alias("n_points")).join(inside, keys, "left")
    share = F.coalesce("__inside", F.lit(0)) / F.col("n_points")
    return out.select(*keys, "n_points", share.alias("inside"), (share >= min_fraction).alias("on_target"))
