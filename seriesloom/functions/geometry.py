"""Distances, diffusion maps, extensions, landmarks, curvature and dimension of point clouds (plain NumPy)."""

import numpy as np


def distances(a, b=None):
    b = a if b is None else b
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
    d = np.sqrt(np.maximum(d2, 0))
    if b is a:
        np.fill_diagonal(d, 0.0)
    return d


def signed(vectors):
    """Eigenvectors with their largest component positive."""
    return vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] + 1e-300)


def diffusion_map(d, n=5, bandwidth="knn", k=10, alpha=1.0, theiler=0, zero_diagonal=False, matrix="symmetric", late_window=False, keep_self=False):
    """Diffusion map of a distance matrix: (coordinates lambda*psi, eigenvalues, right vectors psi, sigma, q).

    bandwidth knn: exp(-d^2 / (s_i s_j)) with the k-th neighbour's distance; median: exp(-d^2 / 2 s^2) with
    the median distance; a number: that width. ``theiler`` leaves out pairs near in time (from the kernel only if
    ``late_window``; ``keep_self`` keeps the diagonal). ``matrix`` symmetric uses D^-1/2 K D^-1/2, markov the
    symmetrised row-stochastic matrix, lower its lower triangle alone. The trivial pair is dropped.
    """
    size = len(d)
    d = d.copy()
    near = np.abs(np.subtract.outer(np.arange(size), np.arange(size))) <= theiler if theiler else None
    if theiler and not late_window:
        d[near] = np.inf
    if bandwidth == "knn":
        sigma = np.maximum(np.partition(d, min(k, size - 1), axis=1)[:, min(k, size - 1)], 1e-12)
        sigma = np.where(np.isfinite(sigma), sigma, np.nanmax(np.where(np.isfinite(sigma), sigma, np.nan)))
        kernel = np.exp(-(d**2) / np.outer(sigma, sigma))
    else:
        off = d[~np.eye(size, dtype=bool) & np.isfinite(d)]
        width = np.median(off) if bandwidth == "median" else float(bandwidth)
        sigma = np.full(size, width)
        kernel = np.exp(-(d**2) / (2 * width**2 + 1e-300))
    if theiler and late_window:
        kernel[near] = 0.0
    if keep_self:
        np.fill_diagonal(kernel, 1.0)
    elif zero_diagonal or theiler:
        np.fill_diagonal(kernel, 0.0)
    q = np.maximum(kernel.sum(1), 1e-12)
    kernel = kernel / np.outer(q**alpha, q**alpha)
    rows = kernel.sum(1)
    rows = np.maximum(rows, 1e-12 * np.median(rows) + 1e-300)
    if matrix in ("markov", "lower"):
        p = kernel / rows[:, None]
        values, vectors = np.linalg.eigh((p + p.T) / 2 if matrix == "markov" else p)
        scale = np.ones(size)
    else:
        scale = 1 / np.sqrt(rows)
        values, vectors = np.linalg.eigh(kernel * np.outer(scale, scale))
    order = np.argsort(-values)[1 : n + 1]
    psi = signed(vectors[:, order] * scale[:, None])
    return psi * values[order], values[order], psi, sigma, q


def leading_pairs(apply, start, n, tol=1e-9, rounds=300, most=400):
    """Largest n eigenvalues and unit vectors of a symmetric operator that is known by its product with a few columns: the
    space grows by the residuals of the best pairs and is drawn together to these when it has ``most`` columns."""
    wide = start.shape[1]
    q = np.linalg.qr(start)[0]
    aq = apply(q)
    for _ in range(rounds):
        t = q.T @ aq
        values, y = np.linalg.eigh((t + t.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        if q.shape[1] + wide > max(most, 4 * wide):
            q, aq = q @ y[:, : 2 * wide], aq @ y[:, : 2 * wide]
            values, y = values[: 2 * wide], np.eye(2 * wide)
        x = q @ y[:, :wide]
        rest = aq @ y[:, :wide] - x * values[:wide]
        size = np.linalg.norm(rest, axis=0)
        if (size[:n] < tol).all():
            return values[:n], x[:, :n]
        new = (rest[:, size >= tol] / size[size >= tol])[:, : len(q) - q.shape[1]]  # no more than there are directions left
        for _ in range(2):
            new = np.linalg.qr(new - q @ (q.T @ new))[0]
        q, aq = np.hstack([q, new]), np.hstack([aq, apply(new)])
    raise ValueError("the leading pairs don't settle")


def nystrom(model, new, k=10, alpha=1.0, scale="lambda_psi"):
    """Extension of a fitted map (points, sigma, q, psi, values) to new points; scale psi divides by the eigenvalue."""
    points, sigma, q, psi, values = model
    d = distances(new, points)
    own = np.maximum(np.partition(d, min(k - 1, d.shape[1] - 1), axis=1)[:, min(k - 1, d.shape[1] - 1)], 1e-12)
    kernel = np.exp(-(d**2) / np.outer(own, sigma))
    kernel = kernel / (np.maximum(kernel.sum(1), 1e-12) ** alpha)[:, None] / q**alpha
    p = kernel / np.maximum(kernel.sum(1), 1e-300)[:, None]
    out = p @ psi
    return out / values if scale == "psi" else out


def farthest_points(v, n, first=0):
    """Greedy farthest-point sampling; ties and the start go to the lowest index."""
    n = min(n, len(v))
    picked, best = [first], ((v - v[first]) ** 2).sum(1)
    while len(picked) < n:
        best[picked] = -1.0
        picked.append(int(best.argmax()))
        best = np.minimum(best, ((v - v[picked[-1]]) ** 2).sum(1))
    return np.array(picked)


def principal_spectrum(v):
    """Variances along the principal axes, largest first."""
    return np.linalg.svd(v - v.mean(0), compute_uv=False) ** 2 / max(len(v) - 1, 1)


def classical_mds(d, n=2):
    size = len(d)
    j = np.eye(size) - 1 / size
    values, vectors = np.linalg.eigh(-j @ (d**2) @ j / 2)
    order = np.argsort(-values)[:n]
    return signed(vectors[:, order]) * np.sqrt(np.maximum(values[order], 0))


def smacof(d, n=2, steps=200):
    """Metric multidimensional scaling by majorisation, started at the classical solution."""
    x = classical_mds(d, n)
    for _ in range(steps):
        e = distances(x)
        with np.errstate(divide="ignore", invalid="ignore"):
            b = -np.where(e > 1e-12, d / e, 0.0)
        np.fill_diagonal(b, 0.0)
        b[np.arange(len(d)), np.arange(len(d))] = -b.sum(1)
        new = b @ x / len(d)
        if np.abs(new - x).max() < 1e-9:
            break
        x = new
    return x


def geodesics(d, k):
    """Shortest paths over the undirected k-nearest-neighbour graph: every point in turn as a stopover, on whole matrices."""
    size = len(d)
    near = np.argsort(d, axis=1, kind="stable")[:, 1 : k + 1]
    rows = np.repeat(np.arange(size), near.shape[1])
    out = np.full((size, size), np.inf)
    out[rows, near.ravel()] = d[rows, near.ravel()]
    out = np.minimum(out, out.T)
    np.fill_diagonal(out, 0.0)
    step = np.empty_like(out)
    for m in range(size):
        np.add(out[:, m, None], out[m], out=step)
        np.minimum(out, step, out=out)
    return out


def curvature(v, k=12, how="median"):
    """Geodesic over straight distance: the median of ratios over reachable pairs, or the ratio of diameters."""
    d = distances(v)
    g = geodesics(d, k)
    if how == "diameter":
        return float(np.where(np.isfinite(g), g, 0).max() / d.max()) if d.max() > 0 else float("nan")
    i, j = np.triu_indices(len(v), 1)
    ok = np.isfinite(g[i, j]) & (d[i, j] > 1e-12)
    return float(np.median(g[i, j][ok] / d[i, j][ok])) if ok.any() else float("nan")


def kernel_log_sums(squares, size, eps, chunk=1 << 15):
    """ln of the kernel sums over all ordered pairs of ``size`` points, themselves included, from the squared distances
    of unordered pairs: chunks stay in cache, and widths at which a chunk no longer counts are skipped."""
    out = np.full(len(eps), float(size))
    for i in range(0, len(squares), chunk):
        u = squares[i : i + chunk]
        least, buffer = u.min(), np.empty_like(u)
        for k in range(len(eps) - 1, -1, -1):
            if least > 60 * eps[k]:  # below 1e-26 each, and so at all smaller widths
                break
            np.multiply(u, -1 / eps[k], out=buffer)
            np.exp(buffer, out=buffer)
            out[k] += 2 * buffer.sum()
    return np.log(out)


def kernel_sum_dimension(d, n=40):
    """2 * the largest slope of ln S(eps) over ln eps, S the sum of exp(-d^2/eps) over all pairs, and its width."""
    flat = np.concatenate([d[i, i + 1 :] for i in range(len(d) - 1)]) if len(d) > 1 else np.zeros(0)
    eps = np.geomspace(flat[flat > 0].min() ** 2 / 10, flat.max() ** 2 * 10, n)
    slope = np.gradient(kernel_log_sums(np.square(flat), len(d), eps), np.log(eps))
    best = slope.argmax()
    med = np.median(flat)
    return 2 * float(slope[best]), float(np.clip(np.sqrt(eps[best] / 2), 0.15 * med, med))


def two_nn(d):
    r = np.partition(d + np.diag(np.full(len(d), np.inf)), 1, axis=1)[:, :2]
    ok = r[:, 0] > 1e-10
    return float(ok.sum() / np.log(r[ok, 1] / r[ok, 0]).sum()) if ok.sum() >= 10 else float("nan")


def levina_bickel(d, k1=5, k2=20):
    r = np.sort(d, axis=1)[:, 1:]
    k2 = min(k2, r.shape[1])
    top = r[:, k2 - 1]
    ok = (top > 1e-10) & (r[:, k1 - 1] > 0)
    return float(np.mean(1 / np.log(top[ok, None] / r[ok, k1 - 1 : k2 - 1]).mean(1)))


def correlation_dimension(d, n=40, window=8, lo=0.005, hi=0.25, spread=0.12, theiler=0):
    """Flattest run of slopes of ln C(r) over ln r where C is between lo and hi; NaN if it spreads too much. Pairs nearer
    in time than ``theiler`` are left out."""
    off = np.sort(d[np.triu_indices(len(d), 1 + theiler)])
    off = off[off > 0]
    if len(off) < n:
        return float("nan")
    r = np.geomspace(np.percentile(off, 0.5), np.percentile(off, 90), n)
    c = np.searchsorted(off, r, "right") / len(off)
    slope = np.gradient(np.log(np.maximum(c, 1e-300)), np.log(r))
    best = (np.inf, float("nan"))
    for i in range(n - window + 1):
        part = slice(i, i + window)
        if c[i] >= lo and c[i + window - 1] <= hi:
            best = min(best, (slope[part].std(), slope[part].mean()))
    return float(best[1]) if best[0] <= spread else float("nan")


def gated_correlation_dimension(d, n=40, window=8, theiler=0):
    """Slope of the straightest run of ln C(r) over ln r, if its R^2 passes the gate (0.92 below 300 points, else 0.95)
    and the slope is between 1 and 20; NaN otherwise. Also the R^2."""
    off = np.sort(d[np.triu_indices(len(d), 1 + theiler)])
    off = off[off > 0]
    if len(off) < n:
        return float("nan"), 0.0
    r = np.geomspace(np.percentile(off, 0.5), np.percentile(off, 90), n)
    c = np.searchsorted(off, r, "right") / len(off)
    x, y = np.log(r), np.log(np.maximum(c, 1e-300))
    xs, ys = (np.lib.stride_tricks.sliding_window_view(v, window) for v in (x, y))
    xs, ys = xs - xs.mean(1, keepdims=True), ys - ys.mean(1, keepdims=True)
    sxy, sxx, syy = (xs * ys).sum(1), (xs * xs).sum(1), np.maximum((ys * ys).sum(1), 1e-300)
    r2 = sxy**2 / (sxx * syy)
    best = int(r2.argmax())
    slope = float(sxy[best] / sxx[best])
    good = r2[best] >= (0.92 if len(d) < 300 else 0.95) and 1 <= slope <= 20
    return slope if good else float("nan"), float(r2[best])


def spectrum_profile(values):
    """Dimensions suggested by a falling spectrum: (place of a jump in the ratio of neighbours above twice the median ratio
    and 1.5, or 0; place of the sharpest bend of ln values)."""
    y = np.asarray([v for v in values if v > 1e-12], float)
    if len(y) < 4:
        return 0, len(y)
    ratio = y[:-1] / y[1:]
    jump = np.flatnonzero((ratio > 2 * np.median(ratio)) & (ratio > 1.5))
    return int(jump[0]) + 1 if len(jump) else 0, int(np.diff(np.log(y), 2).argmin()) + 2


def spectral_diagnosis(values, points, features):
    """split (a leading gap), high_dim (most values above the edge of pure noise) or weak, and the share above the edge
    (Marchenko-Pastur, from the median value as noise level)."""
    y = np.sort(np.asarray(values, float))[::-1]
    y = y[y > 0]
    if len(y) < 3:
        return "weak", 0.0
    edge = np.median(y) * (1 + np.sqrt(features / max(points, 1))) ** 2
    share = float((y > edge).mean())
    if y[0] / y[1] > 2:
        return "split", share
    return ("high_dim" if share > 0.3 else "weak"), share


def median_scaled(v):
    """Distances over the median of the positive ones."""
    d = distances(v)
    pos = d[d > 0]
    return d / np.median(pos) if len(pos) else d


def gram_hellinger(t):
    """Hellinger distances between rows of total mass 1 from inner products of their roots."""
    r = np.sqrt(t)
    d = np.sqrt(np.clip(2 - 2 * r @ r.T, 0, None))
    np.fill_diagonal(d, 0.0)
    return (d + d.T) / 2


def matrix_distances(mats):
    """Frobenius distances between upper triangles of square matrices, shorter ones padded with zeros."""
    flat = [m[np.triu_indices(len(m), 1)] for m in mats]
    width = max(map(len, flat), default=0)
    return distances(np.array([np.pad(f, (0, width - len(f))) for f in flat])) * np.sqrt(2)


def cost_matrix_map(d, n=5):
    """Diffusion map of a cost matrix: Euclidean coordinates by classical scaling first (all positive axes)."""
    x = classical_mds(d, len(d) - 1)
    return diffusion_map(distances(x[:, np.abs(x).max(0) > 1e-12]), n)


def landmark_map(v, n=5, landmarks=800, k=10, seed=0, d_of=distances):
    """Diffusion map of up to ``landmarks`` points as they are; of more, the map of farthest-point landmarks extended to
    all: (coordinates, eigenvalues, landmark rows)."""
    pick = np.arange(len(v)) if len(v) <= landmarks else farthest_points(v, landmarks, int(np.random.default_rng(seed).integers(len(v))))
    coords, values, psi, sigma, q = diffusion_map(d_of(v[pick]), n, k=k)
    return (coords if len(pick) == len(v) else nystrom((v[pick], sigma, q, psi, values), v, k)), values, pick


def series_map(v, n=5, version="dense", tau=1):
    """Map of a delay cloud: dense over all points with its delay as Theiler window, or (first) over 200 farthest points."""
    if version == "dense":
        return diffusion_map(distances(v), n, theiler=tau)
    return diffusion_map(distances(v[farthest_points(v, 200)]), n)


def knee(values, weighted=False):
    """Knee of a falling spectrum by two fitted lines: least summed squares, or least weighted RMSE."""
    y = np.asarray([v for v in values if v > 0], float)
    n, x = len(y), np.arange(1.0, len(y) + 1)
    if n < 4:
        return n
    rss = lambda a: np.square(y[a] - np.polyval(np.polyfit(x[a], y[a], 1), x[a])).sum()
    cost = []
    for c in range(2, n - 1):
        left, right = rss(slice(0, c)), rss(slice(c, n))
        cost.append(c / n * np.sqrt(left / c) + (n - c) / n * np.sqrt(right / (n - c)) if weighted else left + right)
    return int(np.argmin(cost)) + 2


def heat_kernel_dimension(values, n=80):
    """-2 dlnZ/dlnt on its flattest stretch, Z(t) the sum of exp(-t mu) over mu = -ln eigenvalue."""
    mu = -np.log(np.clip(np.asarray(values, float), 1e-12, 1 - 1e-12))
    t = np.geomspace(0.1 / mu.max(), 10 / max(mu.min(), 1e-9), n)
    z = np.exp(-np.outer(t, mu)).sum(1)
    slope = -2 * np.gradient(np.log(np.maximum(z, 1e-300)), np.log(t))
    w = 8
    spread = [slope[i : i + w].std() / (abs(slope[i : i + w].mean()) + 1e-9) if slope[i : i + w].mean() > 0.2 else np.inf for i in range(n - w)]
    i = int(np.argmin(spread))
    return float(slope[i : i + w].mean())
