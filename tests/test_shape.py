from __future__ import annotations

import cmath

import numpy as np
import pandas as pd
import pytest

from plumbline.functions import shape
from plumbline.functions.provider import Provider, Registry, apply_chain

#: The published landmarks (fixed values).
POINTS = [(-2, -1), (-1, 1), (0, -1), (1, 2), (2, 0), (0, 3)]


def flat(z):
    return [v for p in z for v in (p.real, p.imag)]


REFERENCE = [complex(*p) for p in POINTS]


def fit(reference, candidate, weights=None):
    return shape.procrustes_frame(pd.Series([reference]), pd.Series([candidate]), pd.Series([weights])).iloc[0]


def test_shift_scale_and_turn_leave_nothing():
    moved = [3.7 * cmath.exp(0.63j) * z + complex(12, -5) for z in REFERENCE]
    got = fit(flat(REFERENCE), flat(moved))
    assert got.available and got.residual < 1e-12 and got.converged


def test_a_mirror_image_is_another_shape():
    assert fit(flat(REFERENCE), flat([complex(-z.real, z.imag) for z in REFERENCE])).residual > 0.1


def test_an_outlier_weighs_less():
    off = [*REFERENCE[:-1], REFERENCE[-1] + complex(30, -25)]
    got = fit(flat(REFERENCE), flat(off))
    assert got.residual < got.raw_rms and got.effective_weight_share < 1


@pytest.mark.parametrize(("candidate", "weights", "error"), [(None, None, "LANDMARK_POINTS_INVALID"), (flat(REFERENCE[:-1]), None, "LANDMARK_SHAPE_MISMATCH"), (flat(REFERENCE), [1.0, 1, 0, 0, 0, 0], "LANDMARK_VISIBILITY_WEIGHTS_INVALID"), ([1.0] * 12, None, "LANDMARK_CONFIGURATION_DEGENERATE"), ([float("nan")] * 12, None, "LANDMARK_POINTS_INVALID")])
def test_what_cannot_be_fitted(candidate, weights, error):
    got = fit(flat(REFERENCE), candidate, weights)
    assert not got.available and got.error == error


def test_pose_similarity():
    same = shape.pose_similarity(pd.Series([flat(REFERENCE)] * 3), pd.Series([flat(REFERENCE), None, flat(REFERENCE)[:-2]]))
    assert same[0] == pytest.approx(1.0) and np.isnan(same[1]) and np.isnan(same[2])


def test_topology_signature_is_free_of_shift_and_scale():
    a, b, c = shape.topology_signature(pd.Series([flat(REFERENCE), flat([5 * z + 3j for z in REFERENCE]), flat(REFERENCE[:4])]))
    assert len(a) == 30 and np.allclose(a, b) and c is None


def test_the_second_provider_does_what_the_first_refuses(spark):
    def strict(rows):
        if (rows["x"] < 0).any():
            raise ValueError
        return rows.assign(y=rows["x"] * 2)[["y"]]

    registry = Registry()
    registry.add(Provider("strict", ["x"], "y double", strict))
    registry.add(Provider("mild", ["x"], "y double", lambda rows: rows.assign(y=rows["x"].abs())[["y"]]))
    df = spark.createDataFrame([(1, 2.0), (2, -3.0), (3, None)], "id int, x double")
    got = {r.id: (r.y, r.provider, r.reasons) for r in apply_chain(df, "id", registry.chain("strict", "mild")).collect()}
    assert got[1] == (4.0, "strict", []) and got[2] == (3.0, "mild", ["strict:ValueError"]) and got[3] == (None, None, ["strict:NO_VALUE", "mild:NO_VALUE"])
    with pytest.raises(ValueError):
        registry.add(Provider("mild", [], "y double", strict))
    with pytest.raises(KeyError):
        registry.get("none")
