import math

import numpy as np
import pytest

from strandflow.functions import mixture as mx


def normal(x, mean, cov):
    d = x - mean
    return -0.5 * (len(x) * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + d @ np.linalg.inv(cov) @ d)


def test_densities(spark):
    rng = np.random.default_rng(1)
    xs = rng.normal(size=(20, 3))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(xs)] + [(99, None)], "id long, x array<double>")
    means, logits = rng.normal(size=(2, 3)), [0.3, -1.0]
    diag = [mx.scales(rng.normal(size=3), 0.5) for _ in means]
    tri = [mx.triangle(rng.normal(size=6), 3) for _ in means]
    got = {r.id: r for r in df.select("id", mx.mixture_log_pdf(df.x, logits, means, diag).alias("d"), mx.mixture_log_pdf(df.x, logits, means, tri).alias("t"), mx.mixture_log_pdf(df.x, None, means[:1], tri[:1]).alias("one")).collect()}
    w = np.exp(logits) / np.exp(logits).sum()
    for i, x in enumerate(xs):
        for name, covs in (("d", [np.diag((s + 1e-8) ** 2) for s in diag]), ("t", [s @ s.T for s in tri])):
            assert math.isclose(got[i][name], math.log(sum(p * math.exp(normal(x, m, c)) for p, m, c in zip(w, means, covs))), rel_tol=1e-9)
        assert math.isclose(got[i].one, normal(x, means[0], tri[0] @ tri[0].T), rel_tol=1e-9)
    assert got[99].d is None
    assert np.allclose(mx.expectation(logits, means), w @ means)
    with pytest.raises(Exception, match="has not 3 values"):
        spark.sql("select array(1D, 2D) AS x").select(mx.component_log_pdf(mx.F.col("x"), means[0], diag[0])).collect()


def test_scales():
    assert np.allclose(mx.scales([0.0, 0.0], 4.0), 2 + 1e-5) and (mx.scales([-50.0]) > 0).all()
    t = mx.triangle([0, 5, 0, 6, 7, 0], 3)
    assert t[1, 0] == 5 and t[2, 0] == 6 and t[2, 1] == 7 and t[0, 1] == 0
    assert mx.scale_penalty([[1, 2], [3, 0]]) == 7.0
    with pytest.raises(ValueError):
        mx.triangle([1, 2], 2)
