"""The masks of a round stay few however many codes there are."""

import pytest

from reelspark.llm import hamming


@pytest.mark.parametrize("codes", [0, 1, 2**10, 2**24 + 1, 2**26, 2**40])
def test_masks_stay_few(codes):
    width = hamming.BITS // hamming.segments_for(codes)
    assert width <= 16 and max(len(hamming._masks(width, r)) for r in range(width + 1)) <= 12_870
