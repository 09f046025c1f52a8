"""Barycenters of many units go with the job in groups of units, and members meet starts without a copy of either."""

import numpy as np

from seriesloom.functions import geometry as gm
from seriesloom.functions import transport as tr
from seriesloom.plans import transport_queries as tq


def test_groups_of_units_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    c = {(unit, k): tr.unit_max(gm.distances(np.cumsum(rng.normal(size=(40, 3)), 0))) for unit in ("a", "b", "c") for k in range(4)}
    rows = [(unit, k, unit, True, v.ravel().tolist()) for (unit, k), v in c.items()] + [("n", 0, None, True, c["a", 0].ravel().tolist()), ("f", 0, "a", False, None)]
    costs = spark.createDataFrame(rows, "key string, vintage int, unit string, ok boolean, c array<double>")
    whole = {r.unit: r for r in tq.barycenters(costs, 0.05, restarts=2, rounds=1).collect()}
    monkeypatch.setattr(tq, "UNITS", 1)
    few = {r.unit: r for r in tq.barycenters(costs, 0.05, restarts=2, rounds=1).collect()}
    assert set(whole) == set(few) == {"a", "b", "c"}
    for k, unit in enumerate("abc"):
        own = np.array([v for (u, _), v in c.items() if u == unit])
        found = []
        for r in range(2):
            b = tr.random_start(40, np.random.default_rng([k, r]))
            b = tr.squared(tr.pulled_back(tr.gw_plans(own, b, 0.05, tq.ROUND_STEPS, inner=10)[0], own) / 4 * 1600)
            found.append((tr.gw_plans(own, b, 0.05, tq.ROUND_STEPS, inner=10)[1].mean(), b))
        loss, b = min(found, key=lambda x: x[0])
        for got in (whole[unit], few[unit]):
            assert got.members == 4 and np.isclose(got.loss, loss, atol=1e-8) and np.allclose(got.b, b.ravel(), atol=1e-6)


def test_no_series_no_barycenters(spark):
    assert tq.barycenters(spark.createDataFrame([], "key string, vintage int, unit string, ok boolean, c array<double>")).count() == 0


def test_clouds_stay_beside_their_costs(spark, sf_dir):
    rows = tq.clouds_of(spark, sf_dir).filter("ok").limit(5).collect()
    assert len(rows) == 5 and tq.costs_of(spark, sf_dir).columns == ["key", "vintage", "c", "ok", "error", "unit"]
    for r in rows:
        v = np.array(r.cloud).reshape(-1, r.dim)
        assert np.array_equal(tq.supports(v).ravel(), r.c)


def test_pairs_that_leave_don_t_move_the_others(monkeypatch):
    rng = np.random.default_rng(9)
    c = np.array([tr.unit_max(gm.distances(np.cumsum(rng.normal(size=(40, 3)), 0))) for _ in range(24)])
    plain = [tr.gw_plans(x[None], c[0], 0.05, 200)[0][0] for x in c]
    kept, scalings = [], tr.scalings
    monkeypatch.setattr(tr, "SIDE", 8)
    monkeypatch.setattr(tr, "scalings", lambda x, *a: kept.append(x) or scalings(x, *a))
    t = tr.gw_plans(c, c[0], 0.05, 200)[0]
    assert np.allclose(t, plain, atol=1e-9) and len({id(x) for x in kept}) <= 12  # two for the whole stack, and for its last pairs
