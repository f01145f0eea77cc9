"""Quantiles against NumPy."""

import numpy as np
import pytest

from ridgeline.operators import quantiles as Q

@pytest.mark.parametrize("buckets", [2, 1024])
def test_quantiles(spark, monkeypatch, buckets):
    monkeypatch.setattr(Q, "BUCKETS", buckets)
    rng = np.random.default_rng(1)
    shares = [0.0, 0.05, 0.5, 0.9, 0.95, 1.0]
    for x in (rng.normal(size=501), np.repeat([3.0, -1.0, 3.0, 1e12], 40), np.array([7.5]), np.array([1.0, 1.0 + 2**-52])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
        assert np.allclose(Q.quantiles(df, "x", shares), np.quantile(x, shares), rtol=1e-12)
    assert Q.quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]
