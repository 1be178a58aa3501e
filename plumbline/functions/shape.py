"""

Points are complex numbers here, so the best rotation without reflection of one weighted shape onto another is the
phase of a single inner product, and whole batches of shapes of equal size are fitted together by NumPy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROCRUSTES = "available boolean, residual double, raw_rms double, effective_weight_share double, iterations int, converged boolean, error string"
DELTA, ITERATIONS, TOLERANCE = 0.05, 20, 1e-9


def _centre_and_scale(z: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shapes (rows) with weighted mean 0 and weighted mean square 1, and which rows have an extent."""
    total = w.sum(1)
    safe = np.where(total > 1e-12, total, 1.0)
    z = z - ((z * w).sum(1) / safe)[:, None]
    square = (w * np.abs(z) ** 2).sum(1) / safe
    good = (total > 1e-12) & (square > 1e-16)
    return z / np.sqrt(np.where(good, square, 1.0))[:, None], good


def _turned(candidate: np.ndarray, reference: np.ndarray, w: np.ndarray) -> np.ndarray:
    inner = (w * np.conj(candidate) * reference).sum(1)
    size = np.abs(inner)
    return candidate * np.where(size > 0, inner / np.where(size > 0, size, 1.0), 1.0)[:, None]


def procrustes_batch(reference: np.ndarray, candidate: np.ndarray, weights: np.ndarray, delta: float = DELTA, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> dict[str, np.ndarray]:
    """Robust (Huber, iteratively reweighted) similarity fit of each candidate to its reference, all complex n x k."""
    n = len(reference)
    robust = np.ones(weights.shape)
    steps, converged, good = np.zeros(n, int), np.zeros(n, bool), np.ones(n, bool)
    phase = np.full(n, np.nan)
    for step in range(iterations):
        live = np.flatnonzero(good & ~converged)
        if not len(live):
            break
        w = weights[live] * robust[live]
        r, good_r = _centre_and_scale(reference[live], w)
        c, good_c = _centre_and_scale(candidate[live], w)
        good[live] = good_r & good_c
        turned = _turned(c, r, w)
        away = np.abs(turned - r)
        new = np.where(away > delta, delta / np.maximum(away, 1e-12), 1.0)
        angle = np.angle((w * np.conj(c) * r).sum(1))
        # the Frobenius distance of two plane rotations is 2 sqrt(2) |sin(half their angle)|
        moved = 2 * np.sqrt(2) * np.abs(np.sin((angle - phase[live]) / 2))
        done = (np.nan_to_num(moved, nan=np.inf) <= tolerance) & (np.abs(new - robust[live]).max(1) <= tolerance)
        robust[live], phase[live], steps[live] = new, angle, step + 1
        converged[live] = done
    w = weights * robust
    r, good_r = _centre_and_scale(reference, w)
    c, good_c = _centre_and_scale(candidate, w)
    good &= good_r & good_c
    away = np.abs(_turned(c, r, w) - r)
    loss = np.where(away <= delta, 0.5 * away**2, delta * (away - 0.5 * delta))
    total = np.maximum(weights.sum(1), 1e-12)
    return {
        "good": good,
        "residual": np.sqrt(2 * (weights * loss).sum(1) / total),
        "raw_rms": np.sqrt((weights * away**2).sum(1) / total),
        "share": w.sum(1) / total,
        "iterations": steps,
        "converged": converged,
        "away": away,
        "weights": w,
        "reference": r,
    }


def _points(value: object) -> np.ndarray | None:
    """Complex points from a flat list x, y, x, y, ... of at least three finite points."""
    if value is None:
        return None
    flat = np.array([np.nan if v is None else v for v in value], float)
    if flat.size < 6 or flat.size % 2 or not np.isfinite(flat).all():
        return None
    return flat[0::2] + 1j * flat[1::2]


def _weights(value: object, count: int) -> np.ndarray | None:
    if value is None:
        return np.ones(count)
    w = np.array([np.nan if v is None else v for v in value], float)
    if w.size != count or not np.isfinite(w).all():
        return None
    w = np.clip(w, 0, None)
    return w if np.count_nonzero(w) >= 3 else None


def procrustes_frame(reference: pd.Series, candidate: pd.Series, weights: pd.Series) -> pd.DataFrame:
    rows = [(False, None, None, None, 0, False, None)] * len(reference)
    groups: dict[int, list] = {}
    for i, (a, b, w) in enumerate(zip(reference, candidate, weights)):
        pa, pb = _points(a), _points(b)
        error = "LANDMARK_POINTS_INVALID" if pa is None or pb is None else "LANDMARK_SHAPE_MISMATCH" if len(pa) != len(pb) else None
        pw = None if error else _weights(w, len(pa))
        error = error or ("LANDMARK_VISIBILITY_WEIGHTS_INVALID" if pw is None else None)
        if error:
            rows[i] = (False, None, None, None, 0, False, error)
        else:
            groups.setdefault(len(pa), []).append((i, pa, pb, pw))
    for held in groups.values():
        at, a, b, w = zip(*held)
        fit = procrustes_batch(np.array(a), np.array(b), np.array(w))
        for k, i in enumerate(at):
            if fit["good"][k]:
                rows[i] = (True, float(fit["residual"][k]), float(fit["raw_rms"][k]), float(fit["share"][k]), int(fit["iterations"][k]), bool(fit["converged"][k]), None)
            else:
                rows[i] = (False, None, None, None, int(fit["iterations"][k]), False, "LANDMARK_CONFIGURATION_DEGENERATE")
    return pd.DataFrame(rows, columns=["available", "residual", "raw_rms", "effective_weight_share", "iterations", "converged", "error"])


# F16
def procrustes(reference: Column, candidate: Column, weights: Column | None = None) -> Column:
    """struct of PROCRUSTES: how far two landmark lists (flat x, y, ...) differ after shift, scale and rotation."""
    fit = F.pandas_udf(procrustes_frame, PROCRUSTES)
    return fit(reference, candidate, F.lit(None).cast("array<double>") if weights is None else weights)


# F17
def pose_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two normalised pose vectors; points at the origin are hidden ones."""
    out = []
    for x, y in zip(a, b):
        p, q = (None if v is None else np.array([0.0 if e is None else e for e in v], float) for v in (x, y))
        out.append(_pose_similarity(p, q))
    return pd.Series(out, dtype="float64")


def _cos01(p: np.ndarray, q: np.ndarray) -> float | None:
    length = np.linalg.norm(p) * np.linalg.norm(q)
    return float(np.clip((p @ q / length + 1) / 2, 0, 1)) if np.linalg.norm(p) >= 1e-8 and np.linalg.norm(q) >= 1e-8 else None


def _pose_similarity(p: np.ndarray | None, q: np.ndarray | None) -> float | None:
    if p is None or q is None or p.shape != q.shape or p.size % 2 or not np.isfinite([*p, *q]).all():
        return None
    cos = _cos01(p, q)
    zp, zq = p[0::2] + 1j * p[1::2], q[0::2] + 1j * q[1::2]
    hidden = lambda z: (np.abs(z.real) < 1e-8) & (np.abs(z.imag) < 1e-8)
    seen = ~hidden(zp) & ~hidden(zq)
    if seen.sum() < 3:
        return None if cos is None else float(np.clip(0.6 * cos + 0.4 * np.exp(-2.5 * np.linalg.norm(p - q)), 0, 1))
    x, y = zp[seen] - zp[seen].mean(), zq[seen] - zq[seen].mean()
    if np.linalg.norm(x) < 1e-8 or np.linalg.norm(y) < 1e-8:
        return cos
    x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
    gap = np.linalg.norm(x - _turned(y[None], x[None], np.ones((1, len(x))))[0]) / np.sqrt(len(x))
    return float(np.clip((0.72 * np.exp(-4 * gap) + 0.28 * (cos or 0.0)) * (0.9 + 0.1 * seen.mean()), 0, 1))


def pose_similarity_of(a: Column, b: Column) -> Column:
    return F.pandas_udf(pose_similarity, "double")(a, b)


# F34
def topology_signature(points: pd.Series) -> pd.Series:
    """30 shape statistics of a landmark list, free of shift and scale; null below five points or without extent."""
    out: list[list[float] | None] = []
    for value in points:
        z = _points(value)
        out.append(None if z is None or len(z) < 5 else _signature(z))
    return pd.Series(out)


def _signature(z: np.ndarray) -> list[float] | None:
    z = z - z.mean()
    size = np.linalg.norm(z)
    if size <= 1e-8:
        return None
    z = z / size
    x, y, side = z.real, z.imag, np.abs(z.real)
    spread = np.sort(np.linalg.eigvalsh(np.cov(np.stack([x, y]))))[::-1]
    q25, q50, q75 = np.quantile(y, [0.25, 0.5, 0.75])
    mean_side = lambda mask: float(side[mask].mean()) if mask.any() else 0.0
    gaps = np.abs(z[:, None] - z[None, :])[np.triu_indices(len(z), 1)]
    width, height = np.ptp(x), np.ptp(y)
    parts = [width, height, width / max(height, 1e-8), x.std(), y.std(), spread[1] / spread[0] if spread[0] > 1e-8 else 0.0]
    parts += [mean_side(y <= q25), mean_side((y > q25) & (y < q75)), mean_side(y >= q75), mean_side(y <= q50), mean_side(y > q50)]
    for values, at in ((np.abs(z), [0.1, 0.25, 0.5, 0.75, 0.9]), (gaps, [0.05, 0.25, 0.5, 0.75, 0.95]), (side, [0.25, 0.5, 0.75, 0.9]), (y, [0.1, 0.25, 0.5, 0.75, 0.9])):
        parts += np.quantile(values, at).tolist()
    return [float(p) for p in parts]


def topology_signature_of(points: Column) -> Column:
    return F.pandas_udf(topology_signature, "array<double>")(points)


# M20
def pair_weights(a: Column, b: Column) -> Column:
    """Element by element the smaller weight; the one side that is there; null (uniform) if none is."""
    return F.coalesce(F.zip_with(a, b, lambda x, y: F.least(x, y)), a, b)


# M33
def band_residuals(df: DataFrame, keys: list[str], band: str, residual: str, weight: str) -> DataFrame:
    """keys, band, weighted root mean square of the residuals of a band of landmarks."""
    total = F.sum(weight)
    return df.groupBy(*keys, band).agg(F.when(total > 1e-12, F.sqrt(F.sum(F.col(weight) * F.col(residual) * F.col(residual)) / F.nullif(total, F.lit(0.0)))).alias("rms"))
