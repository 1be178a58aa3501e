
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import ColumnLike, balance_ratio, clamp, col, linear01, row_weighted_mean
from plumbline.functions.vectors import cosine, hamming_similarity, histogram_intersection
from plumbline.operators.ranking import weakest


# M05
def feature_channels(a: str, b: str, low: float = 0.45, high: float = 0.70) -> Column:
    """struct of similarities of two feature structs (columns a and b); a channel is null where a side lacks it."""
    x, y = F.col(a), F.col(b)
    chroma = F.sqrt((x["lab"][1] - y["lab"][1]) ** 2 + (x["lab"][2] - y["lab"][2]) ** 2)
    ratio = lambda f: F.when((x[f] > 0) & (y[f] > 0), linear01(x[f] / F.greatest(F.lit(1e-6), y[f]), 0.55, 1.10))
    return F.struct(
        linear01(cosine(x["embedding"], y["embedding"]), low, high).alias("embedding"),
        clamp((cosine(x["hog"], y["hog"]) + 1.0) / 2.0, 0.0, 1.0).alias("hog"),
        clamp(histogram_intersection(x["lbp"], y["lbp"]), 0.0, 1.0).alias("lbp"),
        clamp(hamming_similarity(x["phash"], y["phash"]), 0.0, 1.0).alias("phash"),
        clamp(1.0 - F.abs(x["lab"][0] - y["lab"][0]) / 18.0, 0.0, 1.0).alias("luma"),
        clamp(1.0 - chroma / 22.0, 0.0, 1.0).alias("chroma"),
        ratio("lap_var").alias("sharp"),
        ratio("hf_energy").alias("texture"),
    )


# M06
def framing(height: ColumnLike, headroom: ColumnLike, feet: ColumnLike) -> Column:
    """struct(score, reasons): how well a figure fills its frame, by distances from targets."""
    h, room, f = F.coalesce(col(height), F.lit(0.0)), F.coalesce(col(headroom), F.lit(1.0)), F.coalesce(col(feet), F.lit(0.0))
    size, top = 1.0 - clamp(F.abs(h - 0.82) / 0.22, 0.0, 1.0), 1.0 - clamp(F.abs(room - 0.07) / 0.12, 0.0, 1.0)
    found = F.array_compact(F.array(F.when(f < 0.5, F.lit("FEET_CROPPED_OR_NOT_IN_FRAME")), F.when(size < 0.6, F.lit("SUBJECT_SCALE_OFF")), F.when(top < 0.6, F.lit("HEADROOM_OFF"))))
    reasons = F.when(F.size(found) == 0, F.array(F.lit("FRAMING_OK"))).otherwise(found)
    return F.struct(clamp(0.40 * f + 0.35 * size + 0.25 * top, 0.0, 1.0).alias("score"), reasons.alias("reasons"))


#: bucket, least area, darkness, sharpness floor, texture floor (fixed values).
SIZE_TOLERANCES = [("full_far", 0.0, 16.0, 0.42, 0.48), ("mid", 0.012, 13.0, 0.50, 0.55), ("near", 0.022, 10.0, 0.55, 0.60)]


# M07
def size_tolerances(area: ColumnLike) -> Column:
    """struct(bucket, dark_delta, sharp_floor, texture_floor) by the area of a face."""
    out = None
    for name, least, dark, sharp, texture in reversed(SIZE_TOLERANCES):
        row = F.struct(F.lit(name).alias("bucket"), F.lit(dark).alias("dark_delta"), F.lit(sharp).alias("sharp_floor"), F.lit(texture).alias("texture_floor"))
        out = (F.when if out is None else out.when)(col(area) >= least, row)
    return out


# M08
def view_of_points(points: ColumnLike) -> Column:
    """struct(bucket, side, yaw) from five points (x, y): eyes, nose, corners of the mouth; unknown without them."""
    p = col(points)
    at = lambda i, axis: F.get(F.get(p, F.lit(i)), F.lit(axis))
    middle = (at(0, 0) + at(1, 0)) / 2.0
    apart = F.greatest(F.lit(1e-6), F.sqrt((at(0, 0) - at(1, 0)) ** 2 + (at(0, 1) - at(1, 1)) ** 2))
    nose, mouth = (at(2, 0) - middle) / apart, ((at(3, 0) + at(4, 0)) / 2.0 - middle) / apart
    yaw = 0.7 * F.abs(nose) + 0.3 * F.abs(mouth)
    known = F.coalesce(F.size(p) == 5, F.lit(False)) & yaw.isNotNull()
    bucket = F.when(yaw < 0.10, "front").when(yaw < 0.28, "three_quarter").otherwise("profile_like")
    side = F.when(nose < -0.02, "left").when(nose > 0.02, "right").otherwise("unknown")
    nothing = F.struct(F.lit("unknown").alias("bucket"), F.lit("unknown").alias("side"), F.lit(0.0).alias("yaw"))
    return F.when(known, F.struct(bucket.alias("bucket"), side.alias("side"), yaw.alias("yaw"))).otherwise(nothing)


# M09
def lane_strengths(shoulder: ColumnLike, hip: ColumnLike, torso: ColumnLike) -> Column:
    """struct(bucket, profile, frontal): means of what is known of three linear maps each."""
    s, h, t = col(shoulder), col(hip), col(torso)
    profile = row_weighted_mean([(linear01(0.235 - s, 0.0, 0.070), 1.0), (linear01(0.155 - h, 0.0, 0.060), 1.0), (linear01(0.95 - t, 0.0, 0.40), 1.0)])
    frontal = row_weighted_mean([(linear01(s, 0.18, 0.27), 1.0), (linear01(h, 0.10, 0.19), 1.0), (linear01(t, 0.72, 1.18), 1.0)])
    bucket = F.when(profile.isNull() & frontal.isNull(), "unknown").when(profile > frontal + 0.08, "side_like").otherwise("frontal_like")
    return F.struct(bucket.alias("bucket"), F.coalesce(profile, F.lit(0.0)).alias("profile"), F.coalesce(frontal, F.lit(0.0)).alias("frontal"))


# M10, M35, R04
def composite(parts: Sequence[tuple[ColumnLike, float]]) -> Column:
    """A weighted mean of what is known, held within [0, 1]."""
    return clamp(row_weighted_mean(parts), 0.0, 1.0)


# M12
def pose_explained(core: ColumnLike, sensitive: ColumnLike, gap: ColumnLike, pose: ColumnLike) -> Column:
    """How much of a difference the pose explains: the largest of three pressures, greatest() skipping what is unknown."""
    stable = clamp((col(core) - 0.52) / 0.26, 0.0, 1.0)
    pressure = F.greatest(clamp(F.coalesce(col(gap), F.lit(0.0)) / 0.18, 0.0, 1.0), clamp((col(core) - col(sensitive)) / 0.30, 0.0, 1.0), clamp((1.0 - col(pose)) / 0.55, 0.0, 1.0))
    return F.when(pressure <= 0.05, stable).otherwise(stable * (0.70 + 0.30 * pressure))


# M11, W12, W15
def part_similarities(rows: DataFrame, keys: Sequence[str], parts: DataFrame) -> DataFrame:
    """keys, part, similarity, coverage of long measurements (keys, name, master, candidate, scale) by parts (part, name, least).

    A part with fewer than its least number of measurements has no similarity.
    """
    gap = F.abs(F.col("candidate") - F.col("master")) / F.greatest(F.col("scale"), F.lit(1e-6))
    wanted = parts.groupBy("part").agg(F.count("*").alias("__wanted"))
    met = rows.join(parts, "name").groupBy(*keys, "part").agg(F.avg(1.0 / (1.0 + gap)).alias("__s"), F.count(gap).alias("__n"), F.max("least").alias("__least"))
    return met.join(wanted, "part").select(*keys, "part", F.when(F.col("__n") >= F.col("__least"), F.col("__s")).alias("similarity"), (F.col("__n") / F.col("__wanted")).alias("coverage"))


def topology_summary(similarities: DataFrame, keys: Sequence[str], weights: dict[str, float], structural: Sequence[str]) -> DataFrame:
    """keys, mean (weighted over the parts that are there), coverage, and the weakest structural part."""
    wide = similarities.groupBy(*keys).agg(*[F.max(F.when(F.col("part") == p, F.col("similarity"))).alias(p) for p in weights], F.avg("coverage").alias("coverage"))
    low = weakest([(p, p) for p in structural])
    return wide.select(*keys, row_weighted_mean([(p, w) for p, w in weights.items()]).alias("mean"), "coverage", low["part"].alias("weakest"), low["value"].alias("weakest_similarity"))


# M71, F23
def distance(a: Column, b: Column) -> Column:
    """Between two points given as arrays; null where one is missing."""
    squares = F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def body_ratios(joints: ColumnLike) -> Column:
    """struct of ratios from a map joint -> point: widths and leg lengths against the torso, left against right."""
    j = lambda name: F.try_element_at(col(joints), F.lit(name))
    ratio = lambda a, b: F.when(b > 1e-6, a / F.nullif(b, F.lit(0.0)))
    shoulders, hips = distance(j("left_shoulder"), j("right_shoulder")), distance(j("left_hip"), j("right_hip"))
    torso = distance(j("neck"), j("mid_hip"))
    legs = [distance(j(f"{s}_hip"), j(f"{s}_knee")) + distance(j(f"{s}_knee"), j(f"{s}_ankle")) for s in ("left", "right")]
    leg = row_weighted_mean([(legs[0], 1.0), (legs[1], 1.0)])
    return F.struct(ratio(shoulders, torso).alias("shoulder_width_to_torso"), ratio(hips, torso).alias("hip_width_to_torso"), ratio(shoulders, hips).alias("shoulder_to_hip"), ratio(leg, torso).alias("leg_length_to_torso"), balance_ratio(legs[0], legs[1]).alias("leg_balance"))


# M44, M67
def with_fallbacks(**sources: Sequence[ColumnLike]) -> list[Column]:
    """Per name the first of several columns that is not null."""
    return [F.coalesce(*[col(c) for c in held]).alias(name) for name, held in sources.items()]


# M45
def first_that_holds(outcomes: Sequence[tuple[Column, str]], rest: str) -> Column:
    """An ordered cascade: the name of the first condition that holds; a null one does not."""
    out = None
    for condition, name in outcomes:
        out = (F.when if out is None else out.when)(F.coalesce(condition, F.lit(False)), F.lit(name))
    return F.lit(rest) if out is None else out.otherwise(F.lit(rest))


# F24, M40
def mask_ratio(mask: ColumnLike) -> Column:
    """Share of set cells of a mask given as rows of 0 and 1; null for an empty one."""
    cells = F.flatten(col(mask))
    return F.when(F.size(cells) > 0, F.aggregate(cells, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.nullif(F.size(cells), F.lit(0)))


def mirror_overlap(mask: ColumnLike) -> Column:
    """Intersection over union of a mask and its mirror image; null where it is empty."""
    both = F.flatten(F.transform(col(mask), lambda row: F.zip_with(row, F.reverse(row), lambda a, b: F.struct(F.least(a, b).alias("i"), F.greatest(a, b).alias("u")))))
    add = lambda name: F.aggregate(both, F.lit(0.0), lambda a, x: a + x[name].cast("double"))
    return F.when(add("u") > 0, add("i") / F.nullif(add("u"), F.lit(0.0)))


def row_widths(mask: ColumnLike) -> Column:
    """Per row the distance from its first to its last set cell; null where fewer than two are set."""

    def width(row: Column) -> Column:
        first, last = F.array_position(row, 1), F.size(row) + 1 - F.array_position(F.reverse(row), 1)
        return F.when((first > 0) & (last > first), (last - first + 1).cast("int"))

    return F.transform(col(mask), width)


# M19
def sidecar_confidence(parts: Sequence[tuple[ColumnLike, float]], floor: float = 0.0) -> Column:
    """The weighted confidence of the parts that are there, at least floor; null without any."""
    mean = row_weighted_mean(parts, positive_only=True)
    return F.when(mean.isNotNull(), F.greatest(F.lit(floor), mean))
