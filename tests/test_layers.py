import numpy as np
import pytest
from pyspark.sql import functions as F

from timbral.functions import fixed, pvq


@pytest.mark.parametrize("n", [1, 2, 3, 4])
@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_pvq_is_a_bijection(n, k):
    seen = set()
    for i in range(pvq.count(n, k)):
        v = pvq.decode(i, n, k)
        assert sum(map(abs, v)) == k and pvq.encode(v) == i
        seen.add(tuple(v))
    assert len(seen) == pvq.count(n, k)
    with pytest.raises(ValueError):
        pvq.decode(pvq.count(n, k), n, k)


def test_band_transforms(spark):
    x = np.random.default_rng(1).normal(size=16)
    for stride in (1, 2, 4):
        assert np.allclose(pvq.haar(pvq.haar(x, stride), stride), x)
    assert np.isclose(np.sum(pvq.normalise(x) ** 2), 1)
    row = spark.range(1).select(pvq.noise(F.lit(12345)), pvq.band_energy(F.array(*map(F.lit, [3.0, 4.0, 1.0])), [0, 2, 3])).first()
    assert row[0] == (12345 * 1664525 + 1013904223) % 2**32 and np.allclose(row[1], [5, 1])


def test_fixed_point():
    a = np.array([-(1 << 31), -5, 0, 7, (1 << 31) - 1])
    for b in (-32768, -3, 0, 9, 32767):
        assert fixed.smulwb(a, b).tolist() == [int(x) * b >> 16 for x in a]
    assert fixed.wrap([1 << 31, -(1 << 31) - 1]).tolist() == [-(1 << 31), (1 << 31) - 1]
    assert fixed.shift_round([-1, 1, 3, -3], 1).tolist() == [0, 1, 2, -1]
    assert fixed.leading_zeros([0, 1, 2, 3, 1 << 30, (1 << 31) - 1, -1]).tolist() == [32, 31, 30, 30, 1, 1, 0]
    q = np.arange(0, 3900, 13)
    assert np.abs(fixed.log_to_linear(q) / 2 ** (q / 128) - 1)[q > 900].max() < 0.01
