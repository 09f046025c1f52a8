"""Coupling is judged over all series, not over the landmarks that the map is fitted on."""

import numpy as np
import pandas as pd
import pytest

from seriesloom.functions import geometry as gm
from seriesloom.plans import transport_queries as tq


@pytest.mark.parametrize("landmarks", [40, 800])
def test_all_series_are_coupled(spark, monkeypatch, landmarks):
    rng, n, units = np.random.default_rng(0), 150, ["a", "b", "c"]
    own, rows = rng.choice(units, n), []
    for i in range(n):
        z = rng.normal(size=2) + units.index(own[i])
        for k, u in enumerate(units):
            t = np.exp(np.sin(np.outer(z, np.arange(36) * (k + 1) / 7)).sum(0) + 0.2 * rng.normal(size=36))
            rows.append((f"s{i:03}", 1, own[i], u, [float(x) for x in t / t.sum()], 0.0, True, float(rng.random())))
    m = tq.cut(spark.createDataFrame(rows, "key string, vintage int, own string, unit string, t array<double>, entropy double, gated boolean, coupling double"))
    monkeypatch.setattr(tq, "multi", lambda *_: m)
    monkeypatch.setattr(tq, "LANDMARKS", landmarks)
    c, names = tq.coupling_matrix(spark, "")
    fitted, model, _, v = tq.coupling_model(spark, "")
    assert names == units and len(fitted) == min(n, landmarks)
    every = v.toPandas() if landmarks < n else fitted
    x = np.vstack(every.v)
    axes = gm.nystrom(model, x, k=30)[:, :20] if landmarks < n else model[3]
    want = np.zeros((3, 3))
    for b in range(3):
        u, _, _ = np.linalg.svd(x[:, 36 * b : 36 * b + 36] - x[:, 36 * b : 36 * b + 36].mean(0), full_matrices=False)
        for a, name in enumerate(units):
            mine = (every.own == name).to_numpy()
            for j, lam in enumerate(np.abs(model[4][:20])):
                want[a, b] += lam * max(abs(pd.Series(axes[mine, j]).rank().corr(pd.Series(u[mine, k]).rank())) for k in range(3))
    root = np.sqrt(np.diag(want))
    assert np.allclose(c, want / np.outer(root, root), atol=2e-3)


def test_the_network_uses_the_coupling_of_all(spark, monkeypatch):
    c = np.array([[1.0, 0.5, np.nan], [0.2, 1.0, np.nan], [np.nan, np.nan, np.nan]])
    monkeypatch.setattr(tq, "coupling_matrix", lambda *_: (c.copy(), ["a", "b", "c"]))
    got = tq.s10_coupling_network(spark, "").toPandas().set_index("unit")
    assert got.sent.tolist() == [0.5, 0.2, 0.0] and got.received.tolist() == [0.2, 0.5, 0.0] and np.allclose(got.net, [0.3, -0.3, 0])
