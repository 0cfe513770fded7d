"""Distinct words and phrases of a block, against numpy's own."""

import numpy as np

from colloquy.llm.collocations import _distinct, _distinct_rows


def test_distinct_values():
    x = np.random.default_rng(1).integers(0, 50, 1000).astype(np.uint64)
    values, at, which, n = _distinct(x)
    assert (values == np.unique(x)).all() and (x[at] == values).all() and (values[which] == x).all() and (n == np.bincount(which)).all()
    assert [len(v) for v in _distinct(x[:0])] == [0, 0, 0, 0]


def test_distinct_rows_packed_or_not():
    rng = np.random.default_rng(2)
    for top, k in ((7, 2), (1 << 20, 3), (1 << 30, 3)):
        rows = rng.integers(0, top, (500, k)).astype(np.int32)[rng.integers(0, 500, 2000)]
        found, n = _distinct_rows(rows)
        expected, m = np.unique(rows, axis=0, return_counts=True)
        assert found.dtype == np.int32 and (found == expected).all() and (n == m).all()
    assert _distinct_rows(np.zeros((0, 2), np.int32))[0].shape == (0, 2)
