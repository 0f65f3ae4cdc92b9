import math

import numpy as np
import pytest

from quillet.operators import similar


@pytest.mark.parametrize("t", [0.6, 0.8])
def test_contained_sets_of_all_sizes_share_a_block(t):
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values = np.random.default_rng(3).integers(1, 1 << 62, 130).astype(np.int64)
    for large in range(2, 131):
        small = math.ceil(round(t * large, 9))
        rows, keys = similar.block_keys(np.array([0, large, large + small]), np.concatenate([values[:large], values[large - small : large]]), *none, {large: 0, small: 0}, t)
        assert set(keys[rows == 0]) & set(keys[rows == 1]), (small, large)
