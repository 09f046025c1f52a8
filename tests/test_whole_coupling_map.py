"""The map of the coupling network is made of all series, not of landmarks."""

import numpy as np
import pandas as pd

from seriesloom.functions import geometry as gm
from seriesloom.operators import clouds as cl
from seriesloom.plans import transport_queries as tq


def test_map_of_all_points_is_that_of_the_whole_matrix(spark):
    x = np.random.default_rng(1).normal(size=(130, 6)) * [3, 2, 1, 1, 0.5, 0.5]
    points = spark.createDataFrame([(7 * i - 300, [float(v) for v in r], 0) for i, r in enumerate(x)], "id long, v array<double>, label long")
    ids, values, psi = cl.whole_map(points, 6, 10, side=300)  # blocks of 50 points
    _, want, vectors, *_ = gm.diffusion_map(gm.distances(x), 6, k=10)
    assert ids.tolist() == [7 * i - 300 for i in range(130)]
    assert np.allclose(values, want, atol=1e-9) and np.allclose(psi, vectors, atol=1e-6)


def test_leading_pairs_with_few_columns():
    a = np.random.default_rng(2).normal(size=(300, 300))
    a = a @ a.T / 300
    values, vectors = gm.leading_pairs(lambda x: a @ x, np.random.default_rng(3).normal(size=(300, 10)), 4, most=60)
    want, exact = np.linalg.eigh(a)
    assert np.allclose(values, want[::-1][:4]) and np.allclose(np.abs((vectors * exact[:, ::-1][:, :4]).sum(0)), 1)


def test_the_network_has_a_map_of_all_series(spark, monkeypatch):
    rng, n, units = np.random.default_rng(0), 150, ["a", "b", "c"]
    own, rows = rng.choice(units, n), []
    for i in range(n):
        z = rng.normal(size=2) + units.index(own[i])
        for k, u in enumerate(units):
            t = np.exp(np.sin(np.outer(z, np.arange(36) * (k + 1) / 7)).sum(0) + 0.2 * rng.normal(size=36))
            rows.append((f"s{i:03}", 1, own[i], u, [float(x) for x in t / t.sum()], 0.0, True, float(rng.random())))
    m = tq.cut(spark.createDataFrame(rows, "key string, vintage int, own string, unit string, t array<double>, entropy double, gated boolean, coupling double"))
    monkeypatch.setattr(tq, "multi", lambda *_: m)
    want = tq.coupling_matrix(spark, "")[0]  # of 150 series, below the bound of landmarks: the map of all
    whole = tq.s10_coupling_network(spark, "").toPandas().set_index("unit")
    monkeypatch.setattr(tq, "LANDMARKS", 40)
    got = tq.s10_coupling_network(spark, "").toPandas().set_index("unit")
    pairs = tq.s09_coupling_matrix(spark, "").toPandas()
    assert np.allclose(pairs.coupling.to_numpy().reshape(3, 3), want, atol=1e-5)
    assert np.allclose(got.loc[units, ["sent", "received", "net"]], whole.loc[units, ["sent", "received", "net"]], atol=1e-5)
    assert isinstance(pairs, pd.DataFrame) and not np.allclose(tq.coupling_matrix(spark, "")[0], want, atol=1e-2)  # landmarks alone differ


def test_axes_of_a_block_take_one_pass(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(90, 7)) * np.arange(1, 8)
    rows = spark.createDataFrame([("ab"[i % 2], [float(v) for v in r]) for i, r in enumerate(x)], "unit string, v array<double>")
    passes, collect = [], type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: passes.append(1) or collect(df))
    got = tq.block_axes(rows)
    assert len(passes) == 1
    for k, u in enumerate("ab"):
        own = x[k::2]
        want = np.linalg.svd(own - own.mean(0), full_matrices=False)[2][:3].T
        assert np.allclose(got[u][0], own.mean(0)) and np.allclose(np.abs((got[u][1] * want).sum(0)), 1)


def test_the_driver_has_no_rows_of_plans(spark, monkeypatch):
    t = np.random.default_rng(8).random((60, 2, 16))
    rows = [(f"s{i:02}", 1, "ab"[i % 2], "ab"[k], [float(x) for x in t[i, k] / t[i, k].sum()], 0.0, True, 0.5) for i in range(60) for k in range(2)]
    m = tq.cut(spark.createDataFrame(rows, "key string, vintage int, own string, unit string, t array<double>, entropy double, gated boolean, coupling double"))
    monkeypatch.setattr(tq, "multi", lambda *_: m)
    monkeypatch.setattr(tq, "LANDMARKS", 40)
    monkeypatch.setattr(tq, "landmark_rows", lambda *_: 1 / 0)
    assert np.allclose(np.diag(tq.coupling_matrix(spark, "", True)[0]), 1)
