import numpy as np
import pytest

from tickframe.llm import exchange as X


@pytest.mark.parametrize("bits", [64, 62, 40])
@pytest.mark.parametrize("buckets", [1, 2, 3, 7, 1000, 48_000_001])
def test_pieces(bits, buckets):
    """Each key is in the range that whole numbers say, at both ends of ranges too; only ranges with keys are named."""
    rng = np.random.default_rng(buckets)
    edges = [((b << bits) // buckets + d) % (1 << bits) for b in rng.integers(0, buckets, 200).tolist() for d in (-1, 0, 1)]
    keys = np.sort(np.array([*edges, *(int(k) >> (64 - bits) for k in rng.integers(0, 2**64, 500, np.uint64)), 0, (1 << bits) - 1], np.uint64))
    got = X.pieces(keys, bits, buckets)
    assert [b for b, start, end in got for _ in range(start, end)] == [int(k) * buckets >> bits for k in keys]
    assert got[0][1] == 0 and got[-1][2] == len(keys) and all(a[2] == b[1] and a[0] < b[0] for a, b in zip(got, got[1:]))
    assert X.pieces(np.zeros(0, np.uint64), bits, buckets) == []
