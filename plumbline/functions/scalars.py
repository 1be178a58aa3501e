"""Scalar functions as column expressions. Null in, null out, unless a docstring says otherwise.

"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _value(x: ColumnLike | float) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) else col(x)


# F01
def clamp(x: ColumnLike, low: float, high: float) -> Column:
    """x held within [low, high]. greatest and least skip nulls, so null is kept apart."""
    c = col(x)
    return F.when(c.isNotNull(), F.greatest(_value(low), F.least(_value(high), c)))


# F02
def linear01(x: ColumnLike, low: float, high: float) -> Column:
    """0 at low and below, 1 at high and above, linear between; 0 where high is not above low."""
    c = col(x)
    if high <= low:
        return F.when(c.isNotNull(), F.lit(0.0))
    return F.when(c <= low, F.lit(0.0)).when(c >= high, F.lit(1.0)).when(c.isNotNull(), (c - low) / (high - low))


# F03
def soft_range(x: ColumnLike, low: float, high: float, margin: float) -> Column:
    """1 inside [low, high], falling linearly to 0 over the margin outside."""
    c, span = col(x), max(1e-6, margin)
    outside = F.when(c < low, low - c).otherwise(c - high)
    return F.when(c.between(low, high), F.lit(1.0)).when(c.isNotNull(), clamp(1.0 - outside / span, 0.0, 1.0))


# F04
def decay(x: ColumnLike, scale: float) -> Column:
    return F.exp(-col(x) / max(1e-6, scale))


# F05
def range_score(x: ColumnLike, low: float, high: float) -> Column:
    """Position of a finite x within [low, high], held within [0, 1]; null where the range is empty."""
    if high <= low:
        return F.lit(None).cast("double")
    return clamp((finite_or_null(x) - low) / (high - low), 0.0, 1.0)


def inverse_range_score(x: ColumnLike, low: float, high: float) -> Column:
    return 1.0 - range_score(x, low, high)


# F06
def deviation_score(x: ColumnLike, soft: float, hard: float, floor: float = 0.2) -> Column:
    """1 up to soft, floor from hard on, linear between."""
    c = finite_or_null(x)
    between = 1.0 - (1.0 - floor) * (c - soft) / max(1e-6, hard - soft)
    return F.when(c <= soft, F.lit(1.0)).when(c >= hard, F.lit(max(0.0, floor))).when(c.isNotNull(), F.greatest(F.lit(floor), between))


# F07
def angle_delta(x: ColumnLike, centre: float) -> Column:
    """Distance in degrees on the circle by one wrap: min(d, |360 - d|)."""
    d = F.abs(finite_or_null(x) - centre)
    return F.when(d.isNotNull(), F.least(d, F.abs(360.0 - d)))


def angle_delta_wrapped(x: ColumnLike, centre: float) -> Column:
    """The other rule: d as it is up to 180, 360 - d beyond."""
    d = F.abs(col(x) - centre)
    return F.when(d > 180.0, 360.0 - d).otherwise(d)


# F08
def relative_error(a: ColumnLike, b: ColumnLike) -> Column:
    return F.abs(col(a) - col(b)) / F.greatest(F.lit(1e-6), F.abs(col(a)) + F.abs(col(b)))


def relative_similarity(pairs: Sequence[tuple[ColumnLike, ColumnLike]]) -> Column:
    """1 less the mean relative error of the pairs; null as soon as one side is missing."""
    total: Column = F.lit(0.0)
    for a, b in pairs:
        total = total + relative_error(a, b)
    return clamp(1.0 - total / len(pairs), 0.0, 1.0)


# F09
def reciprocal_similarity(delta: ColumnLike, scale: float) -> Column:
    return 1.0 / (1.0 + col(delta) / scale)


# F21
def colour_distances(l1: ColumnLike, a1: ColumnLike, b1: ColumnLike, l2: ColumnLike, a2: ColumnLike, b2: ColumnLike) -> Column:
    """struct(delta_e, delta_l, delta_ab) of two Lab colours."""
    dl, da, db = col(l1) - col(l2), col(a1) - col(a2), col(b1) - col(b2)
    return F.struct(F.sqrt(dl * dl + da * da + db * db).alias("delta_e"), F.abs(dl).alias("delta_l"), F.sqrt(da * da + db * db).alias("delta_ab"))


# F22
def box_iou(a: Sequence[ColumnLike], b: Sequence[ColumnLike]) -> Column:
    """Intersection over union of two boxes (left, top, right, bottom); 0 where the union is empty."""
    (al, at, ar, ab), (bl, bt, br, bb) = [col(x) for x in a], [col(x) for x in b]
    zero = F.lit(0.0)
    common = F.greatest(zero, F.least(ar, br) - F.greatest(al, bl)) * F.greatest(zero, F.least(ab, bb) - F.greatest(at, bt))
    area = lambda l, t, r, b: F.greatest(zero, r - l) * F.greatest(zero, b - t)  # noqa: E731, E741
    union = area(al, at, ar, ab) + area(bl, bt, br, bb) - common
    return F.when(union > 0, common / union).when(union.isNotNull(), zero)


def box_shift(a: Sequence[ColumnLike], b: Sequence[ColumnLike]) -> Column:
    """struct(centre, width, height): distance of the centres and differences of the sides."""
    (al, at, ar, ab), (bl, bt, br, bb) = [col(x) for x in a], [col(x) for x in b]
    dx, dy = (al + ar - bl - br) / 2.0, (at + ab - bt - bb) / 2.0
    return F.struct(F.sqrt(dx * dx + dy * dy).alias("centre"), (ar - al - br + bl).alias("width"), (ab - at - bb + bt).alias("height"))


# F23
def joint_angle(ax: ColumnLike, ay: ColumnLike, bx: ColumnLike, by: ColumnLike, cx: ColumnLike, cy: ColumnLike) -> Column:
    """Angle at b in degrees between a and c; null where a limb has no length."""
    ux, uy, vx, vy = col(ax) - col(bx), col(ay) - col(by), col(cx) - col(bx), col(cy) - col(by)
    length = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    return F.when(length > 1e-8, F.degrees(F.acos(clamp((ux * vx + uy * vy) / F.nullif(length, F.lit(0.0)), -1.0, 1.0))))


def balance_ratio(left: ColumnLike, right: ColumnLike) -> Column:
    """Smaller over larger side; null where both vanish."""
    big = F.greatest(F.abs(col(left)), F.abs(col(right)))
    small = F.least(F.abs(col(left)), F.abs(col(right)))
    return F.when(col(left).isNotNull() & col(right).isNotNull() & (big > 1e-8), small / F.nullif(big, F.lit(0.0)))


# F25
def bucket(x: ColumnLike, cuts: Sequence[tuple[float, str]], rest: str) -> Column:
    """The name of the first cut that x is below; rest for the others and for null."""
    out = None
    for cut, name in cuts:
        out = (F.when if out is None else out.when)(col(x) < cut, F.lit(name))
    return F.lit(rest) if out is None else out.otherwise(F.lit(rest))


# F26
def status_for(score: ColumnLike, pass_at: ColumnLike | float, warn_at: ColumnLike | float) -> Column:
    """PASS, WARN or FAIL; a missing or NaN score fails."""
    c = finite_or_null(score)
    return F.when(c >= _value(pass_at), "PASS").when(c >= _value(warn_at), "WARN").otherwise("FAIL")


# F27
def band(x: ColumnLike, cuts: Sequence[tuple[float, str]], rest: str, missing: str) -> Column:
    """The name of the first cut that x reaches; cuts from high to low."""
    out = F.when(finite_or_null(x).isNull(), F.lit(missing))
    for cut, name in cuts:
        out = out.when(col(x) >= cut, F.lit(name))
    return out.otherwise(F.lit(rest))


# F28
def token(c: ColumnLike) -> Column:
    """Lower case, every run of other characters one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def path_tokens(c: ColumnLike) -> Column:
    return F.filter(F.split(F.lower(col(c)), "[^a-z0-9]+"), lambda x: x != "")


# F29
def view_family(detail: ColumnLike, fallback: ColumnLike) -> Column:
    """front, three_quarter, side or back by the detail, else by the lane; null if neither says."""
    d, lane = F.coalesce(F.trim(col(detail)), F.lit("")), F.coalesce(F.trim(col(fallback)), F.lit(""))
    return (
        F.when(d.startswith("strict_side_90") | d.startswith("side_like"), "side")
        .when(d.isin("strict_back_180", "back_like"), "back")
        .when(d.isin("front", "three_quarter"), d)
        .when(lane == "side_90", "side")
        .when(lane == "back_180", "back")
        .when(lane.isin("front", "three_quarter"), lane)
    )


def view_family_of_text(c: ColumnLike) -> Column:
    """The family named anywhere in a text: three_quarter before front, since its paths name both."""
    t = token(c)
    return F.when(t.contains("three_quarter") | t.contains("3q"), "three_quarter").when(t.contains("side") | t.contains("90"), "side").when(t.contains("back") | t.contains("180"), "back").when(t.contains("front"), "front")


# F31
def path_key(c: ColumnLike) -> Column:
    """A path as a key: slashes forward, no ./ before it, no slash at its ends, lower case; blank is null."""
    forward = F.regexp_replace(F.translate(F.trim(col(c)), "\\", "/"), r"^(\./)+", "")
    return F.nullif(F.lower(F.trim(forward, F.lit("/"))), F.lit(""))


def base_name(c: ColumnLike) -> Column:
    return F.element_at(F.split(path_key(c), "/"), -1)


def stem(c: ColumnLike) -> Column:
    return F.regexp_replace(base_name(c), r"\.[a-z0-9]+$", "")


# F33
def stable_id(prefix: str, *parts: ColumnLike, size: int = 16) -> Column:
    """prefix and the first hex digits of a hash of the parts, kept apart by a separator that parts rarely hold."""
    joined = F.concat_ws("\x1f", *[F.coalesce(col(p).cast("string"), F.lit("\x00")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, size))


# F32
def json_digest(c: Column) -> Column:
    """SHA-256 of a struct or map as JSON; for maps the keys are sorted first."""
    return F.sha2(F.to_json(c), 256)


def sorted_map(c: ColumnLike) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(col(c))))


# F36
def utc_instant(c: ColumnLike) -> Column:
    """A timestamp from an ISO text that names its zone; null without a zone or if it cannot be read."""
    text = F.trim(col(c))
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.try_to_timestamp(text))


# P02
def first_text(*cs: ColumnLike) -> Column:
    return F.coalesce(*[F.nullif(F.trim(col(c).cast("string")), F.lit("")) for c in cs])


# P03
def round_or_null(c: ColumnLike, digits: int = 4) -> Column:
    return F.round(col(c), digits)


# P04
def number_or(c: ColumnLike, default: float) -> Column:
    """A number from text or number, else the default; NaN passes."""
    return F.coalesce(col(c).try_cast("double"), F.lit(default))


# P05
def finite_or_null(c: ColumnLike) -> Column:
    d = col(c).try_cast("double") if isinstance(c, str) else c
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


# P06
def truth(c: ColumnLike, default: bool = False) -> Column:
    """Texts that mean yes or no; others give the default."""
    t = F.lower(F.trim(col(c).cast("string")))
    return F.when(t.isin("1", "true", "yes", "y", "on"), F.lit(True)).when(t.isin("0", "false", "no", "n", "off", ""), F.lit(False)).otherwise(F.lit(default))


def row_weighted_mean(items: Sequence[tuple[ColumnLike, float]], positive_only: bool = False) -> Column:
    """Mean over the columns that are not null, weights renormalised; null where none is left."""
    above, below = F.lit(0.0), F.lit(0.0)
    for c, w in items:
        if positive_only and w <= 0:
            continue
        above = above + F.when(col(c).isNotNull(), col(c) * w).otherwise(0.0)
        below = below + F.when(col(c).isNotNull(), F.lit(float(w))).otherwise(0.0)
    return F.when(below > 0, above / F.nullif(below, F.lit(0.0)))


def row_geometric_mean(items: Sequence[tuple[ColumnLike, float]], floor: float = 1e-4) -> Column:
    """Exp of the weighted mean logarithm, values held within [floor, 1]."""
    return F.exp(row_weighted_mean([(F.ln(clamp(c, floor, 1.0)), w) for c, w in items]))


def softmax_margin(values: Sequence[ColumnLike]) -> Column:
    """struct(best, margin, probabilities) of scores in a row."""
    scores = F.array(*[col(v) for v in values])
    down = F.sort_array(scores, asc=False)
    top = F.element_at(down, 1)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.struct(top.alias("best"), (top - F.element_at(down, 2)).alias("margin"), F.transform(powers, lambda x: x / total).alias("probabilities"))
