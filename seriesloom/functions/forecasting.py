"""Forecast models for walk-forward evaluation (plain NumPy)."""

import numpy as np

GRID = np.geomspace(1e-4, 1e4, 13)


def ridge(x, y, lam):
    """Centred ridge: (coefficients, intercept)."""
    mx, my = x.mean(0), y.mean()
    z = x - mx
    beta = np.linalg.solve(z.T @ z + lam * np.eye(x.shape[1]), z.T @ (y - my))
    return beta, my - mx @ beta


def choose_penalty(x, y, folds=5, embargo=0):
    """Penalty by expanding folds: (value, whether it is a fallback). The fits of all folds and penalties are one stack."""
    n, d = x.shape
    grid = GRID * max(x.var(0).mean(), 1e-12)
    if n < folds + 5:
        return float(np.median(GRID)), True
    cuts = np.linspace(n // 2, n, folds + 1).astype(int)
    parts = [(a, b) for a, b in zip(cuts, cuts[1:]) if a + embargo < b]
    if not parts:
        return float(grid[0]), False
    means = [(x[:a].mean(0), y[:a].mean()) for a, _ in parts]
    gram, right = np.empty((len(parts), d, d)), np.empty((len(parts), d))
    for k, ((a, _), (mx, my)) in enumerate(zip(parts, means)):
        z = x[:a] - mx
        gram[k], right[k] = z.T @ z, z.T @ (y[:a] - my)
    beta = np.linalg.solve(gram[:, None] + (grid[:, None, None] * np.eye(d)), np.broadcast_to(right[:, None, :, None], (len(parts), len(grid), d, 1)))[..., 0]
    loss = np.zeros(len(grid))
    for (a, b), (mx, my), w in zip(parts, means, beta):
        loss += np.square((y[a + embargo : b] - my)[:, None] - (x[a + embargo : b] - mx) @ w.T).sum(0)
    return float(grid[loss.argmin()]), False


def walk(n, horizon=1, init=None, step=12, embargo=None):
    """Folds (train_end, test_start, test_end)."""
    init = max(int(0.4 * n), 60) if init is None else init
    embargo = horizon - 1 if embargo is None else embargo
    out = []
    while init < n - horizon - embargo:
        start = init + embargo + horizon - 1
        if start < min(start + step, n):
            out.append((init, start, min(start + step, n)))
        init += step
    return out


def autoregression_fit(y, p):
    """Coefficients (constant first) and residual sum of squares of AR(p)."""
    n = len(y)
    a = np.ones((n - p, p + 1))
    for k in range(p):
        a[:, k + 1] = y[p - k - 1 : n - k - 1]
    beta = np.linalg.lstsq(a, y[p:], rcond=None)[0]
    return beta, np.square(y[p:] - a @ beta).sum()


def autoregression_order(y, top=12):
    """Order of least BIC; None for short series."""
    n = len(y)
    best = (np.inf, None)
    for p in range(1, min(top, (n - 1) // 3) + 1):
        rss = autoregression_fit(y, p)[1]
        best = min(best, ((n - p) * np.log(max(rss, 1e-300) / (n - p)) + (p + 1) * np.log(n - p), p), key=lambda b: b[0])
    return best[1]


def autoregression(y, horizon, p=None):
    """Forecast by AR(p), p of least BIC unless given; the mean for short series."""
    p = autoregression_order(y) if p is None else p
    if p is None:
        return float(y.mean()) if len(y) else float("nan")
    beta = autoregression_fit(y, p)[0]
    past = list(y)
    for _ in range(horizon):
        past.append(beta[0] + sum(beta[k + 1] * past[-k - 1] for k in range(p)))
    return float(past[-1])


def ladder(y, horizon=1, lags=4, seed=0):
    """Predictions of every model at every test point: (model, fold, t, y, prediction, base)."""
    n = len(y)
    x = np.column_stack([y[np.maximum(np.arange(n) - k, 0)] for k in range(lags)])
    rng = np.random.default_rng(seed)
    noise = rng.normal(size=(n, lags))
    out = []
    for f, (end, a, b) in enumerate(walk(n, horizon)):
        rows = np.arange(0, end - horizon)
        models = {}
        for name, feats, lam in (("ridge", x, None), ("placebo", noise, None), ("shrunk", x, 1e8)):
            lam = choose_penalty(feats[rows], y[rows + horizon], embargo=horizon - 1)[0] if lam is None else lam
            models[name] = (feats, *ridge(feats[rows], y[rows + horizon], lam))
        m = x[rows].mean(0)
        axes = np.linalg.svd(x[rows] - m, full_matrices=False)[2][:2]
        scores = (x - m) @ axes.T
        models["pca_ridge"] = (scores, *ridge(scores[rows], y[rows + horizon], choose_penalty(scores[rows], y[rows + horizon])[0]))
        # the order is chosen once a fold, on its training values; the fit is renewed at every origin
        order = autoregression_order(y[:end])
        points = {name: feats[a - horizon : b - horizon] @ beta + c for name, (feats, beta, c) in models.items()}
        for t in range(a, b):
            base, now = float(y[: t - horizon + 1].mean()), float(y[t])
            for name, guess in points.items():
                out.append((name, f, t, now, float(guess[t - a]), base))
            out.append(("random_walk", f, t, now, float(y[max(t - horizon, 0)]), base))
            o = t - horizon + 1
            out.append(("rolling_mean", f, t, now, float(y[max(o - 12, 0) : o].mean()), base))
            out.append(("autoregression", f, t, now, autoregression(y[:o], horizon, order), base))
    return out
