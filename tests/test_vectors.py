import numpy as np
import pytest

from intentlake.functions.vectors import pool_tokens


def test_pooling_of_tokens():
    tokens = np.array([[[3.0, 4.0], [1.0, 0.0], [9.0, 9.0]], [[0.0, 2.0], [0.0, 4.0], [6.0, 0.0]]])
    mask = np.array([[1, 1, 0], [1, 1, 1]])
    assert pool_tokens(tokens, mask, "last", False).tolist() == [[1, 0], [6, 0]]
    assert pool_tokens(tokens, mask, "mean", False).tolist() == [[2, 2], [2, 2]]
    assert pool_tokens(tokens, mask, "cls", False).tolist() == [[3, 4], [0, 2]]
    assert np.allclose(pool_tokens(tokens, mask, "cls"), [[0.6, 0.8], [0, 1]])
    assert np.allclose(pool_tokens(tokens, mask, "mean"), np.sqrt(0.5))
    assert pool_tokens(tokens * 0, mask).tolist() == [[0, 0], [0, 0]]
    with pytest.raises(ValueError):
        pool_tokens(tokens, mask, "max")
