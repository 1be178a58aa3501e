
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.scalars import ColumnLike, clamp, col


def doubles(c: ColumnLike) -> Column:
    return F.transform(col(c), lambda x: x.cast("double"))


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    """Scalar product in double precision; null for different lengths or a null element."""
    x, y = doubles(a), doubles(b)
    return F.when(F.size(x) == F.size(y), total(F.zip_with(x, y, lambda p, q: p * q)))


def norm(c: ColumnLike) -> Column:
    return F.sqrt(total(F.transform(doubles(c), lambda x: x * x)))


# F11
def cosine(a: ColumnLike, b: ColumnLike, least: float = 1e-8) -> Column:
    """Null where a norm is below least or the lengths differ."""
    na, nb = norm(a), norm(b)
    return F.when((na >= least) & (nb >= least), dot(a, b) / F.nullif(na * nb, F.lit(0.0)))


# F12
def unit(c: ColumnLike, least: float = 1e-8) -> Column:
    n = norm(c)
    return F.when(n > least, F.transform(doubles(c), lambda x: x / n))


# F13
def angular_distance(a: ColumnLike, b: ColumnLike) -> Column:
    """struct(radians, errors): acos of the cosine, held within [-1, 1], or why there is none."""
    c = cosine(a, b)
    errors = F.filter(
        F.array(
            F.when(col(a).isNull() | col(b).isNull(), F.lit("VECTOR_MISSING")),
            F.when(F.size(col(a)) != F.size(col(b)), F.lit("VECTOR_LENGTHS_DIFFER")),
            F.when((norm(a) < 1e-8) | (norm(b) < 1e-8), F.lit("VECTOR_WITHOUT_LENGTH")),
        ),
        lambda x: x.isNotNull(),
    )
    return F.struct(F.acos(clamp(c, -1.0, 1.0)).alias("radians"), errors.alias("errors"))


# F10
def decayed_similarity(a: ColumnLike, b: ColumnLike, factor: float = 1.0) -> Column:
    """exp(-factor * mean absolute difference); null for empty or unequal vectors."""
    x, y = doubles(a), doubles(b)
    gap = total(F.zip_with(x, y, lambda p, q: F.abs(p - q)))
    return F.when((F.size(x) == F.size(y)) & (F.size(x) > 0), F.exp(-factor * gap / F.nullif(F.size(x), F.lit(0))))


# F14
def log_ratios(candidate: ColumnLike, reference: ColumnLike, least_components: int = 3) -> Column:
    """map name -> ln(candidate / reference) over names positive in both; null below least_components."""
    pairs = F.map_zip_with(col(candidate), col(reference), lambda _, c, r: F.when((c > 0) & (r > 0), F.ln(c / r)))
    kept = F.map_filter(pairs, lambda _, v: v.isNotNull())
    return F.when(F.size(kept) >= least_components, kept)


# F15
def centred(c: ColumnLike) -> Column:
    """The vector less its mean."""
    x = doubles(c)
    mean = total(x) / F.nullif(F.size(x), F.lit(0))
    return F.transform(x, lambda v: v - mean)


# F18
def hamming_similarity(a: ColumnLike, b: ColumnLike, bits: int = 64) -> Column:
    """Share of equal bits of two packed hashes."""
    return 1.0 - F.bit_count(col(a).bitwiseXOR(col(b))) / float(bits)


# F19
def histogram_intersection(a: ColumnLike, b: ColumnLike) -> Column:
    x, y = doubles(a), doubles(b)
    return F.when(F.size(x) == F.size(y), total(F.zip_with(x, y, lambda p, q: F.least(p, q))))


# A52
def blended_top(values: ColumnLike, k: int, mean_weight: float = 0.6, median_weight: float = 0.4) -> Column:
    """Weighted mean of the mean and the median of the k greatest elements; 0 for an empty list."""
    top = F.slice(F.sort_array(F.filter(doubles(values), lambda x: x.isNotNull()), asc=False), 1, k)
    n = F.size(top)
    mean = total(top) / F.nullif(n, F.lit(0))
    low, high = F.floor((n + 1) / 2).cast("int"), F.ceil((n + 1) / 2).cast("int")
    median = (F.try_element_at(top, low) + F.try_element_at(top, high)) / 2.0
    return F.when(n == 0, F.lit(0.0)).otherwise((mean_weight * mean + median_weight * median) / max(1e-8, mean_weight + median_weight))


# F35, M35
def standardised(c: ColumnLike, centre: list[float], scale: list[float], least_ready: int) -> Column:
    """struct(vector, coverage): (x - centre) / scale with nulls at 0, null below least_ready present elements."""
    x = doubles(c)
    middles, scales = F.array(*[F.lit(float(v)) for v in centre]), F.array(*[F.lit(max(1e-6, float(v))) for v in scale])
    ready = F.size(F.filter(x, lambda v: v.isNotNull()))
    shifted = F.zip_with(F.zip_with(x, middles, lambda v, m: v - m), scales, lambda v, s: F.coalesce(v / s, F.lit(0.0)))
    return F.struct(F.when(ready >= least_ready, shifted).alias("vector"), (ready / float(len(centre))).alias("coverage"))
