"""The anchors of repeated passages: minima of windows, the same however a text is cut."""

import numpy as np
import pytest

from pixsieve.llm import suffixes


@pytest.mark.parametrize("n", [51, 1000, 1 << suffixes.PLACE_BITS, (1 << suffixes.PLACE_BITS) + 1])
@pytest.mark.parametrize("kinds", [2, 1 << 47])
def test_smallest_of_a_window_is_the_leftmost(n, kinds):
    value = np.random.default_rng(n).integers(0, kinds, n).astype(np.uint64)
    plain = np.lib.stride_tricks.sliding_window_view(value, 51).argmin(axis=1) + np.arange(n - 50)
    assert (suffixes.smallest(value, 51) == plain).all()


def test_anchors_are_the_same_in_long_and_short_stretches():
    rng = np.random.default_rng(5)
    body = rng.integers(97, 123, 200_000).astype(np.uint8)
    long = suffixes.anchors(body, np.array([0, len(body)]), 100)
    short = suffixes.anchors(body[:90_000], np.array([0, 90_000]), 100)
    n = len(short[0]) - 1  # the last one is cut off
    assert all((a[:n] == b[:n]).all() for a, b in zip(long[:1] + long[3:4], short[:1] + short[3:4], strict=True))
