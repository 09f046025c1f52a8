"""Known systems for tests of the estimators (plain NumPy)."""

import numpy as np


def runge_kutta(f, state, dt, steps, burn=1000):
    out = np.empty((steps, len(state)))
    s = np.asarray(state, float)
    for i in range(-burn, steps):
        a = f(s)
        b = f(s + dt / 2 * a)
        c = f(s + dt / 2 * b)
        e = f(s + dt * c)
        s = s + dt / 6 * (a + 2 * b + 2 * c + e)
        if i >= 0:
            out[i] = s
    return out


def lorenz(n, rng, dt=0.02):
    return runge_kutta(lambda s: np.array([10 * (s[1] - s[0]), s[0] * (28 - s[2]) - s[1], s[0] * s[1] - 8 / 3 * s[2]]), rng.normal(size=3) + [1, 1, 20], dt, n)


def rossler(n, rng, dt=0.05):
    return runge_kutta(lambda s: np.array([-s[1] - s[2], s[0] + 0.2 * s[1], 0.2 + s[2] * (s[0] - 5.7)]), rng.normal(size=3) * 0.1 + 1, dt, n)


def torus(n, rng):
    t = np.arange(n) * 0.05
    a, b = t + rng.random(), np.sqrt(2) * t + rng.random()
    return np.column_stack([(2 + np.cos(b)) * np.cos(a), (2 + np.cos(b)) * np.sin(a), np.sin(b)])


def recursion(step, x, n, burn=200):
    out = []
    for i in range(n + burn):
        x = step(x)
        if i >= burn:
            out.append(x[0] if isinstance(x, tuple) else x)
    return np.array(out)


def euler(f, state, dt, steps, drop=2000):
    """First coordinate along explicit steps of a flow, without the first ``drop``."""
    out = np.empty(steps)
    for i in range(-drop, steps):
        state = [s + dt * v for s, v in zip(state, f(*state))]
        if i >= 0:
            out[i] = state[0]
    return out


def lorenz_flow(sigma, rho, beta=8 / 3):
    return lambda x, y, z: (sigma * (y - x), x * (rho - z) - y, x * y - beta * z)


def rossler_flow(a, b, c):
    return lambda x, y, z: (-y - z, x + a * y, b + z * (x - c))


# The twelve families with delay and dimension of their embedding.
FAMILIES = {
    "lorenz_sigma10": (8, 3), "lorenz_sigma14": (8, 3), "rossler_chaotic": (12, 3), "rossler_near_periodic": (12, 3), "henon": (1, 2), "logistic_r37": (1, 2),
    "logistic_r399": (1, 2), "ar1_phi05": (4, 5), "ar1_phi095": (4, 5), "random_walk": (4, 5), "white_noise": (4, 5), "torus_2d": (6, 3),
}


def family(name, n, seed):
    """A scalar series of a family; the same seed gives the same series."""
    rng = np.random.default_rng(seed)
    near = lambda *at, by=0.1: [a + by * e for a, e in zip(at, rng.normal(size=len(at)))]
    if name.startswith("lorenz"):
        return euler(lorenz_flow(float(name[-2:]), 28.0), near(1.0, 1.0, 1.0), 0.01, n)
    if name.startswith("rossler"):
        return euler(rossler_flow(0.2, 0.2, 5.7) if name.endswith("chaotic") else rossler_flow(0.1, 0.1, 4.0), near(1.0, 1.0, 0.0), 0.05, n)
    if name == "henon":
        return recursion(lambda s: (1 - 1.4 * s[0] ** 2 + s[1], 0.3 * s[0]), tuple(near(0.1, 0.1, by=0.05)), n, 1000)
    if name.startswith("logistic"):
        r = 3.7 if name.endswith("r37") else 3.99
        return recursion(lambda x: r * x * (1 - x), float(np.clip(near(0.4, by=0.05)[0], 0.01, 0.99)), n, 1000)
    if name.startswith("ar1"):
        return recursion_linear(rng.normal(size=n + 500), 0.5 if name.endswith("phi05") else 0.95)[500:]
    if name == "random_walk":
        return np.cumsum(rng.normal(size=n))
    if name == "torus_2d":
        t = np.arange(n) * 0.05
        return np.cos(t) + np.cos(np.pi * t) + 0.01 * rng.normal(size=n)
    return rng.normal(size=n)


def recursion_linear(e, phi):
    out = np.empty(len(e))
    x = 0.0
    for i, v in enumerate(e):
        x = phi * x + v
        out[i] = x
    return out


def sphere(dim, ambient, n, rng):
    """Points of a dim-sphere in a random subspace."""
    p = rng.normal(size=(n, dim + 1))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    return p @ np.linalg.qr(rng.normal(size=(ambient, dim + 1)))[0].T
