"""Properties that hold for any input, tried on generated ones."""

from __future__ import annotations

import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import bpe, clusters, packing, percentiles

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def encoders():
    with open(bpe.default_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return bpe.load_ranks(), tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(max_size=80), max_size=6))
def test_encoding_any_text(encoders, texts):
    mine, other = encoders
    assert mine.encode(texts) == [other.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(sizes=st.lists(st.integers(1, 100), max_size=60))
def test_best_fit_neither_overfills_nor_opens_too_many(sizes):
    sizes = np.array(sizes, np.int64)
    box, start = packing.best_fit(sizes, 100)
    filled = {}
    for b, s, size in zip(box.tolist(), start.tolist(), sizes.tolist()):
        filled.setdefault(b, []).append((s, size))
    for held in filled.values():
        at = 0
        for s, size in sorted(held):
            assert s == at
            at += size
        assert at <= 100
    # two containers that are both at most half full would have been one
    assert sum(sum(size for _, size in held) <= 50 for held in filled.values()) <= 1


@settings(max_examples=60, deadline=None)
@given(parts=st.lists(st.lists(st.integers(-50, 50), max_size=1500), max_size=6), p=st.sampled_from([0.0, 0.1, 0.5, 0.9, 1.0]))
def test_brackets_hold_the_percentile(parts, p):
    merged = percentiles.Sketch()
    for part in parts:
        merged.merge(*percentiles.Sketch().add(np.array(part, float)).collapse().state()[:2], *percentiles.Sketch().add(np.array(part, float)).collapse().state()[2:])
    merged.collapse()
    values = np.sort(np.array([v for part in parts for v in part], float))
    assert merged.n == len(values)
    if merged.n:
        _, low, high = merged.percentile(p)
        place = (len(values) - 1) * p
        assert low <= values[int(np.floor(place))] and values[int(np.ceil(place))] <= high


@settings(max_examples=60, deadline=None)
@given(a=st.lists(st.floats(-1, 1), min_size=3, max_size=3), step=st.lists(st.floats(-0.05, 0.05), min_size=3, max_size=3))
def test_rows_within_reach_meet_in_a_cell(a, step):
    pair = np.array([a, np.add(a, step)])
    reach = 0.05 * (1 + 1e-9)
    key, row = clusters.place(pair, reach, 0.2)
    first, second = set(key[row == 0].tolist()), set(key[row == 1].tolist())
    assert first & second
