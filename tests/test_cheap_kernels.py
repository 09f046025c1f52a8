"""Kernels that do less arithmetic for the same result, against the plain formulas."""

import time

import numpy as np

from seriesloom.functions import forecasting as fo
from seriesloom.functions import geometry as gm
from seriesloom.functions import statistics as st
from seriesloom.functions import topology as tp


def test_dependence_equals_the_plain_formula():
    rng = np.random.default_rng(0)
    odd = np.ones(80)
    odd[40] = 2
    for x in (rng.normal(size=120), np.round(rng.normal(size=90)), odd, np.r_[rng.normal(size=60), 1e6]):

        def gram(v):
            d2 = np.square(v[:, None] - v)
            k = np.exp(-d2 / np.median(d2[d2 > 0]))
            return k - k.mean(0) - k.mean(1)[:, None] + k.mean()

        a, b, n = gram(x[:-1]), gram(x[1:]), len(x) - 1
        stat, draw = (a * b).mean(), np.random.default_rng(1)
        null = np.array([(a * b[np.ix_(p, p)]).mean() for p in (draw.permutation(n) for _ in range(60))])
        got, p = st.hsic(x[:-1], x[1:], np.random.default_rng(1), 60)
        assert np.isclose(got, stat, rtol=1e-10) and np.isclose(p, (1 + (null >= stat * (1 - 1e-9)).sum()) / 61)
        f = st.kernel_factor(x, 1.0)
        assert f.shape[1] < 45 and np.allclose(f @ f.T, np.exp(-np.square(x[:, None] - x)), atol=1e-13)


def test_penalties_of_all_folds_are_one_stack(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 3)) * [1, 10, 0.1]
    y = x @ [1.0, 0.02, -3] + rng.normal(size=90)
    for embargo in (0, 2):
        grid, loss = fo.GRID * x.var(0).mean(), np.zeros(len(fo.GRID))
        cuts = np.linspace(45, 90, 6).astype(int)
        for a, b in zip(cuts, cuts[1:]):
            for k, lam in enumerate(grid):
                beta, c = fo.ridge(x[:a], y[:a], lam)
                loss[k] += np.square(y[a + embargo : b] - x[a + embargo : b] @ beta - c).sum()
        with monkeypatch.context() as m:
            solves, solve = [], np.linalg.solve
            m.setattr(np.linalg, "solve", lambda *a: solves.append(1) or solve(*a))
            assert fo.choose_penalty(x, y, embargo=embargo) == (grid[loss.argmin()], False) and len(solves) == 1
    assert fo.choose_penalty(x, y, embargo=9) == (grid[0], False) and fo.choose_penalty(x[:8], y[:8])[1]


def test_loops_cost_few_sorts_of_the_pairs():
    rng = np.random.default_rng(3)
    d = gm.distances(rng.normal(size=(150, 3)))
    pairs = d[np.triu_indices(150, 1)]

    def cheapest(f):
        took = []
        for _ in range(7):
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    assert cheapest(lambda: tp.loop_bars(d)) < 14 * cheapest(lambda: np.argsort(pairs, kind="stable"))
