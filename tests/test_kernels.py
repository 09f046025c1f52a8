import itertools
import math

import numpy as np

from seriesloom.functions import clustering as cu
from seriesloom.functions import descriptors as de
from seriesloom.functions import embedding as em
from seriesloom.functions import forecasting as fo
from seriesloom.functions import generators as ge
from seriesloom.functions import geometry as gm
from seriesloom.functions import statistics as st
from seriesloom.functions import topology as tp
from seriesloom.functions import transport as tr


def test_delay_vectors_and_parameters():
    assert em.delay_vectors(np.arange(10), 2, 3).tolist() == [[i, i + 2, i + 4] for i in range(4)]
    x = np.random.default_rng(0).normal(size=400)
    code = np.minimum((8 * (x - x.min()) / (x.max() - x.min())).astype(int), 7)
    joint = np.histogram2d(code[:-3], code[3:], bins=[np.arange(9) - 0.5] * 2)[0] / 397
    mi = sum(joint[i, j] * math.log(joint[i, j] / (joint[i].sum() * joint[:, j].sum())) for i in range(8) for j in range(8) if joint[i, j])
    assert np.isclose(em.average_mutual_information(x, 5, 8, bias=False)[2], mi)
    assert em.first_minimum([5, 4, 3, 4, 2]) == 3
    assert em.first_minimum([3, 2, 1]) == 3 and em.first_minimum([3, 2, 1], fallback=3) == 3
    tau, dim, v = em.embed(ge.family("lorenz_sigma10", 3000, 1)[::5])
    assert dim in (2, 3, 4) and np.allclose(v.std(1), 1)
    assert (em.row_standard(np.ones((2, 3))) == 0).all()


def test_dimensions_follow_the_calibration():
    rng = np.random.default_rng(0)
    got = [gm.kernel_sum_dimension(gm.distances(ge.sphere(k, 60, 400, rng)))[0] for k in (5, 7, 9, 11)]
    assert np.allclose(got, [3.861, 4.635, 5.137, 5.508], atol=0.2)  # published readings of this estimator
    flat = np.c_[np.sort(rng.random(300)), np.zeros(300)]
    assert abs(gm.two_nn(gm.distances(flat)) - 1) < 0.25
    line = 1 / np.mean([math.log(20 / j) for j in range(5, 20)])  # leaving out the four nearest lifts the reading on a line
    assert abs(gm.levina_bickel(gm.distances(flat)) - line) < 0.25
    assert gm.knee([10, 5, 1, 0.9, 0.8, 0.7, 0.6]) in (2, 3)


def test_diffusion_map_and_extension():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(80, 3))
    d = gm.distances(v)
    for options in ({}, {"theiler": 2}, {"bandwidth": "median", "zero_diagonal": True, "matrix": "markov"}):
        values = gm.diffusion_map(d, 5, **options)[1]
        assert (values <= 1 + 1e-9).all() and (np.diff(values) <= 1e-12).all()
    _, values, psi, sigma, q = gm.diffusion_map(d, 3, k=10)
    model = (v, sigma, q, psi, values)
    out = gm.nystrom(model, v, k=11)  # the points themselves, counting themselves as a neighbour
    assert np.corrcoef(out[:, 0], psi[:, 0])[0, 1] > 0.999
    assert np.allclose(gm.nystrom(model, v, scale="psi") * values, gm.nystrom(model, v))
    f = gm.farthest_points(v, 10)
    assert len(set(f)) == 10 and f[0] == 0
    ring = np.c_[np.cos(np.linspace(0, 2 * np.pi, 60)[:-1]), np.sin(np.linspace(0, 2 * np.pi, 60)[:-1])]
    assert abs(gm.curvature(ring, 2) - math.pi / 2 / math.sqrt(2)) < 0.02 and abs(gm.curvature(ring, 2, "diameter") - math.pi / 2) < 0.05
    assert gm.smacof(gm.distances(ring)).shape == (59, 2)
    assert np.allclose(gm.distances(gm.classical_mds(gm.distances(ring))), gm.distances(ring), atol=1e-6)


def test_transport():
    rng = np.random.default_rng(2)
    a, b = (tr.unit_max(gm.distances(rng.normal(size=(n, 2)))) for n in (12, 9))
    t, loss, _ = tr.gw_plan(a, b, 0.02)
    assert np.allclose(t.sum(1), 1 / 12, atol=1e-5) and np.allclose(t.sum(0), 1 / 9, atol=1e-5)
    brute = sum((a[i, k] - b[j, m]) ** 2 * t[i, j] * t[k, m] for i, k in itertools.product(range(12), repeat=2) for j, m in itertools.product(range(9), repeat=2))
    assert np.isclose(loss, brute)
    assert loss < tr.objective(a, b, np.full((12, 9), 1 / 108))
    p = rng.permutation(12)
    assert np.isclose(tr.gw_plan(a[np.ix_(p, p)], b, 0.02)[1], loss, rtol=1e-3)
    assert tr.robust_plan(np.zeros((3, 3)), b[:3, :3])[1] == "uniform"
    bary, obj = tr.barycenter([a, a], 12, 0.01, rounds=3, restarts=1)
    assert np.allclose(bary, bary.T) and obj < 0.05


def brute_loops(d):
    """Bars of loops by plain reduction of the boundary matrix."""
    n, limit = len(d), d.max(1).min()
    edges = sorted((d[a, b], a, b) for a, b in itertools.combinations(range(n), 2) if d[a, b] <= limit)
    place = {(a, b): k for k, (_, a, b) in enumerate(edges)}
    pivots, bars = {}, []
    for t, a, b, c in sorted((max(d[a, b], d[a, c], d[b, c]), a, b, c) for a, b, c in itertools.combinations(range(n), 3)):
        column = {place[e] for e in ((a, b), (a, c), (b, c)) if e in place} if t <= limit else set()
        while column and max(column) in pivots:
            column = column ^ pivots[max(column)]
        if column:
            pivots[max(column)] = column
            if t > edges[max(column)][0]:
                bars.append(t - edges[max(column)][0])
    return sorted(bars)


def test_loops_equal_plain_reduction():
    rng = np.random.default_rng(0)
    for k in range(30):
        v = rng.normal(size=(rng.integers(5, 24), 2))
        v = np.unique(np.round(v * 2) if k % 3 == 0 else v, axis=0)  # many equal distances every third time
        if len(v) >= 4:
            b = tp.loop_bars(gm.distances(v))
            assert np.allclose(sorted(b[:, 1] - b[:, 0]), brute_loops(gm.distances(v)))


def test_exact_transport():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 6):
        c = rng.normal(size=(n, n))
        assert np.isclose(c[np.arange(n), tr.assignment(c)].sum(), min(c[np.arange(n), list(p)].sum() for p in itertools.permutations(range(n))))
    a = tr.unit_max(gm.distances(rng.normal(size=(15, 2))))
    p = rng.permutation(15)
    t, loss, done = tr.exact_plan(a[np.ix_(p, p)], a)
    assert done and np.allclose(t.sum(0), 1 / 15) and np.allclose(t.sum(1), 1 / 15) and loss <= tr.gw_plan(a[np.ix_(p, p)], a, 0.02)[1] + 1e-9
    stack = np.array([tr.unit_max(gm.distances(rng.normal(size=(15, 2)))) for _ in range(5)])
    t, loss, _ = tr.gw_plans(stack, a, 0.02)
    for x, y, z in zip(stack, t, loss):
        assert np.isclose(tr.gw_plan(x, a, 0.02)[1], z, atol=1e-6) and np.allclose(y.sum(1), 1 / 15, atol=1e-5)
    assert tr.plan_or_exact(a, a, 0.02)[1] == "entropic" and tr.pair_distances(stack[:2]).shape == (2, 2)
    b, loss, eps = tr.pair_barycenter(stack[:2], 15, rounds=2, restarts=1)
    assert eps == 0.01 and np.allclose(b, b.T) and (np.diag(b) == 0).all()
    cloud = rng.normal(size=(15, 2))
    y = tr.projected_states(cloud, np.eye(15) / 15, cloud, cloud)
    assert np.allclose(y, cloud) and (tr.projected_states(cloud, np.zeros((15, 15)), cloud, cloud) == 0).all()


def test_domains_cover_new_points():
    rng = np.random.default_rng(6)
    blobs = np.vstack([rng.normal(size=(40, 3)) * 0.2 + c for c in ([0, 0, 0], [6, 0, 0], [0, 6, 0])])
    m = cu.Domains(blobs, np.random.default_rng(1), reps=3)
    found = m.assign(np.vstack([rng.normal(size=(10, 3)) * 0.2 + c for c in ([0, 0, 0], [6, 0, 0], [0, 6, 0])]))
    if m.count == 3:
        assert cu.adjusted_rand(found, np.repeat([0, 1, 2], 10)) == 1
    assert len(found) == 30 and cu.leading_gap([0.9, 0.88, 0.2, 0.1]) == (3, 0.88 / 0.2)


def test_remaining_statistics():
    rng = np.random.default_rng(7)
    t, p, always = st.paired_t([2.0, 3, 4, 5.5], [1, 2, 3, 4])
    assert np.isclose(t, 9.0) and p < 0.01 and always
    pts = rng.normal(size=(400, 2)) @ np.diag([3.0, 1.0])
    (a, b), (c, e), _ = st.ellipse_intervals(pts, rng, 300)
    major, minor, _ = st.ellipse(pts)
    assert a < major < b and c < minor < e and st.ellipse_intervals(pts[:2], rng) == [(0.0, 0.0)] * 3
    x = rng.normal(size=400)
    assert st.unit_root(x)[1] < 0.01 < 0.1 < st.unit_root(np.cumsum(x))[1] and math.isnan(st.unit_root(np.ones(50))[0])
    d = gm.distances(rng.random((300, 2)))
    assert abs(gm.gated_correlation_dimension(d)[0] - 2) < 0.4
    assert gm.spectrum_profile([1, 0.9, 0.8, 0.1, 0.09, 0.08])[0] == 3 and gm.spectral_diagnosis([5, 1, 1, 1], 100, 4)[0] == "split"
    coords, values, pick = gm.landmark_map(rng.normal(size=(60, 3)), 3, landmarks=30)
    assert coords.shape == (60, 3) and len(pick) == 30
    assert np.isclose(gm.matrix_distances([np.eye(3), np.zeros((3, 3))])[0, 1], 0) and np.isclose(gm.median_scaled(rng.normal(size=(9, 2)))[0, 0], 0)
    plans = rng.dirichlet(np.ones(6), 5)
    assert np.allclose(gm.gram_hellinger(plans), gm.distances(np.sqrt(plans)), atol=1e-7)
    b = de.bundle(x, em.embed(x)[2], 1, 3)
    assert list(b) == de.SLOTS and len(b) == 16 and np.isfinite(b["loop_score"])


def test_topology():
    th = np.linspace(0, 2 * np.pi, 41)[:-1]
    ring = np.c_[np.cos(th), np.sin(th)]
    bars = tp.loop_bars(gm.distances(ring))
    life = bars[:, 1] - bars[:, 0]
    assert tp.loops(gm.distances(ring)) == 1 and np.isclose(life.max(), math.sqrt(3) - 2 * math.sin(math.pi / 40), atol=0.1)
    rng = np.random.default_rng(3)
    v = rng.random((30, 2))
    d = gm.distances(v)
    parent = list(range(30))
    find = lambda i: i if parent[i] == i else find(parent[i])
    kruskal = []
    for i, j in sorted(itertools.combinations(range(30), 2), key=lambda e: d[e]):
        if find(i) != find(j):
            parent[find(i)] = find(j)
            kruskal.append(d[i, j])
    assert np.allclose(tp.component_bars(d), kruskal)


def test_distributions_and_tests():
    assert np.isclose(st.normal_quantile(0.975), 1.959964, atol=1e-5)
    assert np.isclose(st.student_two_sided(2.228139, 10), 0.05, atol=1e-6) and np.isclose(st.f_upper(3.4928, 2, 20), 0.05, atol=1e-4)
    assert np.isclose(st.sign_test(9, 10), 22 / 1024) and np.isclose(st.sign_test(5, 10), 1.0)
    rng = np.random.default_rng(4)
    x = rng.normal(size=101)
    s = st.phase_randomised(x, rng)
    assert np.allclose(np.abs(np.fft.rfft(s)), np.abs(np.fft.rfft(x)))
    y = np.r_[0, x[:-1]] + 0.1 * rng.normal(size=101)
    assert st.granger(x, y)[1] < 1e-6 and st.granger(y, x)[1] > 0.001
    lo, hi = st.bca_interval(x.mean(), [x[st.stationary_index(101, 4, rng)].mean() for _ in range(300)], (x.sum() - x) / 100)
    assert lo < x.mean() < hi
    a = rng.normal(size=(20, 3))
    q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    assert st.procrustes(a, 2 * a @ q + 1) < 1e-9
    assert st.hsic(x[:60], x[:60], rng, 50)[1] < 0.05
    assert np.isclose(st.adjusted_mutual_information([[5, 0], [0, 5]]), 1)


def test_descriptors_clusters_and_forecasts():
    assert de.permutation_entropy(np.arange(50.0), 3) == 0
    assert de.permutation_entropy(np.random.default_rng(0).random(5000), 3) > 0.99
    x = np.random.default_rng(1).normal(size=400)
    assert de.nearest_information(x[:300], x[100:]) < 0.15 and de.nearest_information(x[:300], x[:300]) > 1
    assert 0.3 < de.hurst(x) < 0.7 and de.spectral_entropy(x) > 0.8
    blobs = np.r_[np.random.default_rng(2).normal(size=(20, 2)), np.random.default_rng(3).normal(size=(20, 2)) + 9]
    truth = [0] * 20 + [1] * 20
    rng = np.random.default_rng(5)
    assert cu.adjusted_rand(cu.ward(blobs, 2), truth) == 1 == cu.adjusted_rand(cu.kmeans(blobs, 2, rng), truth) == cu.adjusted_rand(cu.spectral(gm.distances(blobs), 2, rng), truth)
    assert fo.walk(100, 6, 60, 12, 5)[:3] == [(60, 70, 82), (72, 82, 94), (84, 94, 100)]
    z = rng.normal(size=(50, 2))
    beta, c = fo.ridge(z, z @ [1.0, -2.0] + 3, 1e-9)
    assert np.allclose(beta, [1, -2]) and np.isclose(c, 3)
    y = ge.family("ar1_phi095", 400, 7)
    assert abs(fo.autoregression(y, 1) - 0.95 * y[-1]) < 0.5
    mse = {}
    for m, _, _, a, p, _ in fo.ladder(y[:250]):
        mse.setdefault(m, []).append((a - p) ** 2)
    assert np.mean(mse["ridge"]) < np.mean(mse["shrunk"]) and np.mean(mse["ridge"]) < np.mean(mse["placebo"])
