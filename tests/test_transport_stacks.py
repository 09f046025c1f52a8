"""Plans of a stack are those of each pair alone, and a stack costs far less than its pairs one by one."""

import time

import numpy as np

from seriesloom.functions import geometry as gm
from seriesloom.functions import transport as tr


def clouds(k, n=40, seed=0):
    rng = np.random.default_rng(seed)
    return np.array([tr.unit_max(gm.distances(np.cumsum(rng.normal(size=(n, 3)), 0))) for _ in range(k)])


def test_no_plan_depends_on_its_stack():
    c, ref = clouds(12), clouds(2, seed=1)
    for steps, inner in ((15, 10), (60, 10)):
        t, loss, done = tr.gw_plans(c, ref[0], 0.008, steps, inner=inner)
        for x, y, z, d in zip(c, t, loss, done):
            one, value, settled = tr.gw_plans(x[None], ref[0], 0.008, steps, inner=inner)
            assert np.allclose(one[0], y, atol=1e-9) and np.isclose(value[0], z, atol=1e-9) and settled[0] == d
    a, b = tr.gw_plans(c, np.repeat(ref, 6, 0), steps=20)[0], [tr.gw_plans(x, r, steps=20)[0] for x, r in zip((c[:6], c[6:]), ref)]
    assert np.allclose(a, np.concatenate(b), atol=1e-9) and np.isclose(tr.objective(c[0], ref[0], a[0]), tr.gw_plans(c, ref[0], steps=20)[1][0])


def test_pairs_take_the_places_of_settled_ones(monkeypatch):
    c, ref = clouds(9), clouds(1, seed=2)[0]
    whole = tr.gw_plans(c, ref, 0.05)
    monkeypatch.setattr(tr, "SIDE", 2)
    few = tr.gw_plans(c, ref, 0.05)
    assert whole[2].all() and few[2].all() and np.allclose(whole[0], few[0], atol=1e-9) and np.allclose(whole[1], few[1], atol=1e-12)


def test_exact_plans_are_those_of_each_pair():
    c, ref = clouds(10), clouds(1, seed=3)[0]
    t, loss, done = tr.exact_plans(c, ref)
    for x, y, z, d in zip(c, t, loss, done):
        one, value, settled = tr.exact_plan(x, ref)
        assert settled and d and np.allclose(one, y) and np.isclose(value, z) and np.isclose(tr.objective(x, ref, y), z) and np.allclose(y.sum(0), 1 / 40)


def test_a_stack_of_exact_plans_costs_less_than_its_pairs():
    c, ref = clouds(60), clouds(1, seed=3)[0]
    start = time.process_time()
    for x in c[:6]:
        tr.exact_plan(x, ref, 30)
    one = (time.process_time() - start) / 6
    start = time.process_time()
    tr.exact_plans(c, ref, 30)
    assert (time.process_time() - start) / 60 < one / 2


def test_assignments_from_any_potentials():
    rng = np.random.default_rng(4)
    c = np.concatenate([rng.normal(size=(6, 9, 9)), np.round(rng.normal(size=(6, 9, 9)))])  # with ties
    plain, warm = tr.assignments(c)[0], tr.assignments(c, rng.normal(size=(12, 9)))[0]
    total = lambda j: np.take_along_axis(c, j[:, :, None], 2).sum((1, 2))
    assert np.allclose(total(plain), total(warm)) and (np.sort(warm, 1) == np.arange(9)).all()


def test_marginals_that_settle_slowly_are_right():
    x, zero = -20 * clouds(6), np.zeros((6, 40))
    x[:3, :20, 20:] -= 8  # halves that hardly meet
    p = np.full(40, 1 / 40)
    slow = tr.scalings(x.copy(), p, p, zero, zero, 5000, 1e-9)[0]
    t, f, g, done = tr.balanced(x.copy(), p, p, zero, zero)
    assert done.all() and np.abs(t.sum(2) - p).max() < 2e-9 and np.abs(t.sum(1) - p).max() < 1e-12
    assert np.allclose(t, np.exp(x + f[:, :, None] + g[:, None]), atol=1e-12)
    right = np.abs(slow.sum(2) - p).max(1) < 2e-9
    assert 3 <= right.sum() < 6 and np.allclose(t[right], slow[right], atol=1e-7)


def test_every_plan_has_its_marginals():
    i, rng = np.arange(40), np.random.default_rng(7)
    ring, halves = np.c_[np.cos(0.7 * i), np.sin(0.7 * i)] * (1 + i[:, None] / 40), np.where(i[:, None] < 20, 0, 5)
    c = np.array([tr.unit_max(gm.distances(v + 0.05 * rng.normal(size=(40, 2)))) for v in [ring, halves] * 15])
    t = tr.gw_plans(c, tr.random_start(40, np.random.default_rng(6)), 0.004, 60, inner=10)[0]
    assert np.abs(t.sum(2) - 1 / 40).max() < 2e-8 and np.abs(t.sum(1) - 1 / 40).max() < 1e-12


def test_fallbacks_of_a_stack_are_those_of_each_pair():
    c, ref = clouds(24), clouds(1, seed=3)[0]
    c[5] = 0.0
    start = time.process_time()
    t, status = tr.robust_plans(c, ref, 0.02)
    stack = time.process_time() - start
    assert status == ["ok"] * 5 + ["uniform"] + ["ok"] * 18 and np.allclose(t.sum((1, 2)), 1)
    start = time.process_time()
    for i in range(4, 8):
        one, own = tr.robust_plan(c[i], ref, 0.02)
        assert own == status[i] and np.allclose(one, t[i], atol=1e-9)
    assert stack / 24 < (time.process_time() - start) / 4
    kept, how = tr.plans_or_exact(c[:4], ref, 0.02)
    assert how == ["entropic"] * 4 and np.allclose(kept[2], tr.plan_or_exact(c[2], ref, 0.02)[0], atol=1e-9)
