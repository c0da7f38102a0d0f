"""Percentiles of all pairs by refined histograms equal NumPy's."""

import numpy as np
import pytest

from trawl.operators import pairs as P


@pytest.mark.parametrize("n,block,bins,few", [(300, 64, 4096, 100_000), (90, 16, 8, 40), (2, 512, 4096, 10)])
def test_pair_geometry(spark, monkeypatch, n, block, bins, few):
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "BINS", bins)
    monkeypatch.setattr(P, "FEW", few)
    g = np.random.default_rng(n)
    x = g.normal(size=(n, 6))
    x[n // 2 :] = x[: n - n // 2]  # ties
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(n + 1, None)], "id long, embedding array<double>").repartition(3)
    s = (x @ x.T)[np.triu_indices(n, 1)]
    got = P.pair_geometry(df, "id").first()
    assert got.n_pairs == len(s)
    assert [got.mean_cos, got.std_cos, got.p5, got.p95] == pytest.approx([s.mean(), s.std(), *np.percentile(s, [5, 95])], abs=2e-6)


def test_too_few_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    assert P.pair_geometry(df, "id").first().n_pairs == P.pair_geometry(df.limit(0), "id").first().n_pairs == 0
