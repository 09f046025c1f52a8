"""Entropic Gromov-Wasserstein transport between distance matrices, and barycenters (plain NumPy)."""

import numpy as np


def unit_max(c):
    top = np.abs(c).max()
    if not np.isfinite(top) or top < 1e-12:
        raise ValueError("a cost matrix must be finite and not zero")
    return c / top


def sinkhorn(cost, p, q, eps, steps=200, tol=1e-9):
    """Entropic plan of a cost, in the log domain."""
    f, g, lp, lq = np.zeros(len(p)), np.zeros(len(q)), np.log(p), np.log(q)

    def soft(m, axis):
        top = m.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(m - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for _ in range(steps):
        f = eps * (lp - soft((g[None] - cost) / eps, 1))
        g = eps * (lq - soft((f[:, None] - cost) / eps, 0))
        t = np.exp((f[:, None] + g[None] - cost) / eps)
        if np.abs(t.sum(1) - p).max() < tol:
            break
    return t


def objective(a, b, t):
    """Gromov-Wasserstein loss of a plan in O(n^3)."""
    p, q = t.sum(1), t.sum(0)
    return float(p @ (a * a) @ p + q @ (b * b) @ q - 2 * np.sum((a @ t @ b.T) * t))


#: Most pairs that are solved side by side.
SIDE = 64


def scalings(exponent, p, q, f, g, steps, tol):
    """Entropic plans of a stack, from warm potentials f and g: (plans, f, g). ``exponent`` is their sum less the cost;
    all are in units of eps, and the exponent is overwritten. The kernel is taken after the potentials are drawn in, so
    its scalings stay near 1; where they don't, a plan is not finite or its mass is not 1. A pair is left alone once its
    marginals are right."""
    whole = kernel = np.exp(exponent, out=exponent)
    u, v = np.ones_like(f), np.ones_like(g)
    y, open_, kv = v, None, np.empty((*f.shape, 1))
    with np.errstate(all="ignore"):
        for k in range(steps):
            x = p / np.matmul(kernel, y[:, :, None], out=kv)[:, :, 0]
            y = q / (x[:, None] @ kernel)[:, 0]
            if k % 10 == 9 and k + 1 < steps:
                go = ~(np.abs(x * np.matmul(kernel, y[:, :, None], out=kv)[:, :, 0] - p).max(1) < tol)
                if go.all():
                    continue
                open_ = np.arange(len(f)) if open_ is None else open_
                u[open_], v[open_] = x, y
                open_, kernel, x, y, kv = open_[go], kernel[go], x[go], y[go], kv[go]
                if not len(open_):
                    break
        if open_ is None:
            u, v = x, y
        else:
            u[open_], v[open_] = x, y
        whole *= u[:, :, None]
        whole *= v[:, None]
        return whole, f + np.log(u), g + np.log(v)


def balanced(exponent, p, q, f, g, rounds=60, tol=1e-9):
    """As ``scalings``, to the end: (plans, f, g, converged). Rows are scaled exactly and the potentials of the columns
    found by Newton steps of bounded length, so plans whose marginals settle slowly cost little more than others."""
    t, f, g = np.exp(exponent, out=exponent), f.copy(), g.copy()
    m, own = t.shape[2], np.arange(len(t))
    done, now = np.zeros(len(t), bool), t
    with np.errstate(all="ignore"):
        for k in range(rounds + 1):
            x = p / now.sum(2)
            now *= x[:, :, None]
            f[own] += np.log(x)
            columns = now.sum(1)
            off = np.abs(columns - q).max(1)
            go = ~(off < tol) & np.isfinite(off)
            if not go.all() or k == rounds:
                x = q / columns
                now *= x[:, None]
                g[own] += np.log(x)
                t[own], done[own] = now, off < tol
                if k == rounds or not go.any():
                    return t, f, g, done
                own, now, columns = own[go], now[go] / x[go][:, None], columns[go]
                g[own] -= np.log(x[go])
            h = np.swapaxes(now, 1, 2) @ (now / -p[:, None]) + 1 / m**2
            h[:, np.arange(m), np.arange(m)] += columns + 1e-15
            step = np.linalg.solve(h, (q - columns)[:, :, None])[:, :, 0]
            step /= np.maximum(np.ptp(step, axis=1) / 2, 1)[:, None]
            now *= np.exp(step)[:, None]
            g[own] += step


def gw_plans(a, b, eps=0.008, steps=1000, tol=1e-9, p=None, q=None, inner=50):
    """Entropic plans of a stack of cost matrices against one (or a stack of) reference: (plans, losses, converged).

    Projected mirror descent on the squared loss from the product plan, SIDE pairs at once; a pair makes room for the
    next when its plan has settled or its steps are used up, so no plan depends on the rest of the stack. Potentials stay
    warm from step to step, so few inner rounds suffice and the marginals settle with the plan. Uniform marginals unless
    both are given.
    """
    a, b = np.asarray(a, float), np.asarray(b, float)
    k, n, m, single = len(a), a.shape[1], b.shape[-1], b.ndim == 2
    if p is None or q is None:
        p, q = np.full(n, 1 / n), np.full(m, 1 / m)
    # two more rows carry the terms of rows and columns into the product: ones, and what is added to each column
    turned, column = np.concatenate([np.swapaxes(b, -1, -2) * (4 / eps), np.ones((*b.shape[:-2], 1, m)), np.zeros((*b.shape[:-2], 1, m))], -2), np.square(b) @ q * (-2 / eps)
    of = lambda x, own: x if single else x[own]

    def fixed(own):  # what stays of a pair, in units of eps
        return a[own], of(turned, own), np.square(a[own]) @ p * (-2 / eps), of(column, own)

    def exponent(plan, f, g, c, r, rows, columns, half, out):  # potentials less the cost
        np.matmul(c, plan, out=half[:, :, :m])
        np.add(f, rows, out=half[:, :, m])
        if single:
            np.matmul(half.reshape(-1, m + 2), r, out=out.reshape(-1, m))
            out += (g + columns)[:, None]
        else:
            half[:, :, m + 1] = 1
            np.add(g, columns, out=r[:, m + 1])
            np.matmul(half, r, out=out)
        return out

    def wide(x):  # room for the product of costs and plan, and for the terms of the rows
        return np.zeros((*x.shape[:-1], m + 2))

    def saved(plan, new, f, g, parts, steps, tol):  # what can't be scaled is solved in the log domain
        bad = np.flatnonzero(~(np.isfinite(f).all(1) & np.isfinite(g).all(1) & (np.abs((new @ np.ones(m)).sum(1) - 1) < 1e-3)))
        for i in bad:
            c, r, rows, columns = parts
            cost = (c[i] @ plan[i] @ (r if single else r[i])[:m] + rows[i][:, None] + (columns if single else columns[i])) * -eps
            new[i] = sinkhorn(cost, p, q, eps, steps, tol)
            f[i], g[i] = 0.0, 0.0

    t, f, g = np.broadcast_to(np.outer(p, q), (k, n, m)).copy(), np.zeros((k, n)), np.zeros((k, m))
    done, used, own, next_ = np.zeros(k, bool), np.zeros(k, int), np.arange(min(SIDE, k)), min(SIDE, k)

    def started(own):
        now, parts = t[own], fixed(own)
        return now, -exponent(now, f[own], g[own], *parts, wide(now), np.empty_like(now)).max(2), g[own], parts

    now, f1, g1, parts = started(own)
    half, out, live = wide(now), np.empty_like(now), np.ones(len(own), bool)
    while live.any():
        new, f1, g1 = scalings(exponent(now, f1, g1, *parts, half, out), p, q, f1, g1, inner, tol)
        saved(now, new, f1, g1, parts, inner, tol)
        used[own] += 1
        now -= new
        moved = now.reshape(len(own), -1)
        settled = np.sqrt(np.matmul(moved[:, None], moved[:, :, None])[:, 0, 0]) < tol
        now, out = new, now
        gone = np.flatnonzero(live & (settled | (used[own] >= steps)))
        if not len(gone):
            continue
        at = own[gone]
        t[at], f[at], g[at], done[at] = now[gone], f1[gone], g1[gone], settled[gone]
        more = np.arange(next_, min(next_ + len(gone), k))
        if len(more):  # only their places are written anew
            next_ += len(more)
            i = gone[: len(more)]
            own[i] = more
            now[i], f1[i], g1[i], first = started(more)
            for x, y in zip(parts[::2] if single else parts, first[::2] if single else first):
                x[i] = y
        live[gone[len(more) :]] = False
        if live.sum() < 0.75 * len(live):  # places that no pair takes any more
            own, now, f1, g1, parts = own[live], now[live], f1[live], g1[live], (parts[0][live], of(parts[1], live), parts[2][live], of(parts[3], live))
            half, out, live = half[live], out[live], live[live]
    off = np.flatnonzero(np.abs(t.sum(2) - p).max(1) > 1e-8)
    for i in range(0, len(off), SIDE):  # marginals of plans that had not settled
        own = off[i : i + SIDE]
        parts, now = fixed(own), t[own]
        x = exponent(now, f[own], g[own], *parts, wide(now), np.empty_like(now))
        new, f1, g1, right = balanced(x.copy(), p, q, f[own], g[own])
        if not right.all():
            new[~right], f1[~right], g1[~right] = scalings(x[~right], p, q, f[own][~right], g[own][~right], 5000, 1e-9)
        saved(now, new, f1, g1, parts, 5000, 1e-9)
        t[own] = new
    rows, columns = t.sum(2), t.sum(1)
    squares = np.einsum("kij,ki,kj->k", np.square(a), rows, rows, optimize=True) + (columns @ np.square(b) * columns if single else np.matmul(columns[:, None], np.square(b))[:, 0] * columns).sum(1)
    return t, squares - 2 * np.einsum("kij,kij->k", np.matmul(np.matmul(a, t), np.swapaxes(b, -1, -2)), t), done


def gw_plan(a, b, eps=0.008, steps=1000, tol=1e-9, p=None, q=None):
    """Entropic plan of one pair: (plan, loss, converged)."""
    t, loss, done = gw_plans(np.asarray(a)[None], b, eps, steps, tol, p, q)
    return t[0], float(loss[0]), bool(done[0])


def assignments(cost, v=None):
    """Cheapest one-to-one assignments of a stack of square costs: (columns of the rows, potentials of the columns).

    Shortest augmenting paths, each search run over the whole stack at once. Any potentials ``v`` will do as a start; near
    the right ones most rows take their column at sight.
    """
    k, n = cost.shape[:2]
    every = np.arange(k)
    v = np.zeros((k, n)) if v is None else v.copy()
    reduced = cost - v[:, None]
    wish = reduced.argmin(2)
    u = np.take_along_axis(reduced, wish[:, :, None], 2)[:, :, 0]
    row_of, column_of = np.full((k, n), -1), np.full((k, n), -1)
    for i in range(n):
        own = every[row_of[every, wish[:, i]] < 0]
        row_of[own, wish[own, i]], column_of[own, i] = i, wish[own, i]
    while len(some := np.flatnonzero((column_of < 0).any(1))):
        start = (column_of[some] < 0).argmax(1)
        size = len(some)
        far, way, closed = np.full((size, n), np.inf), np.zeros((size, n), int), np.zeros((size, n), bool)
        row, least, sink = start.copy(), np.zeros(size), np.zeros(size, int)
        on = np.arange(size)
        while len(on):
            r, at, shut = row[on], some[on], closed[on]
            now = cost[at, r] - v[at] + (least[on] - u[at, r])[:, None]
            better = (now < far[on]) & ~shut
            d = np.where(better, now, far[on])
            far[on], way[on] = d, np.where(better, r[:, None], way[on])
            j = np.where(shut, np.inf, d).argmin(1)
            least[on], closed[on, j], sink[on] = d[np.arange(len(on)), j], True, j
            row[on] = row_of[at, j]
            on = on[row[on] >= 0]
        x, y = np.nonzero(closed)
        grow = least[x] - far[x, y]
        v[some[x], y] -= grow
        taken = row_of[some[x], y] >= 0
        u[some[x[taken]], row_of[some[x[taken]], y[taken]]] += grow[taken]
        u[some, start] += least
        on, j = np.arange(size), sink
        while len(on):
            at, r = some[on], way[on, j]
            row_of[at, j] = r
            column_of[at, r], j = j, column_of[at, r]
            go = r != start[on]
            on, j = on[go], j[go]
    return column_of, v


def assignment(cost):
    """Columns of the cheapest one-to-one assignment of rows."""
    return assignments(np.asarray(cost, float)[None])[0][0]


def exact_plans(a, b, steps=200, tol=1e-9, start=None):
    """Plans without entropy by conditional gradients, of a stack of cost matrices against one (or a stack of) reference:
    (plans, losses, converged). Marginals are uniform and of one size, so each direction is an assignment; the step along
    it minimises the quadratic loss exactly. A pair leaves the stack when it can't go further."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    k, n = a.shape[:2]
    if b.shape[-1] != n:
        raise ValueError("both matrices must have one size")
    b = np.broadcast_to(b, (k, n, n))
    t = np.full((k, n, n), 1 / n**2) if start is None else np.array(start, float)
    squares = [(x * x).sum(2) / n for x in (a, b)]
    const = squares[0][:, :, None] + squares[1][:, None]
    p, q = t.sum(2), t.sum(1)
    fixed = np.einsum("kij,ki,kj->k", a * a, p, p, optimize=True) + np.einsum("kij,ki,kj->k", b * b, q, q, optimize=True)
    turned = b.transpose(0, 2, 1)
    dot = lambda x, y: np.einsum("kij,kij->k", x, y)
    pulled = a @ t @ turned
    loss, done, v, own = fixed - 2 * dot(pulled, t), np.zeros(k, bool), np.zeros((k, n)), np.arange(k)
    for _ in range(steps):
        grad = 2 * (const[own] - 2 * pulled[own])
        pick, v[own] = assignments(grad, v[own])
        way = -t[own]
        way[np.arange(len(own))[:, None], np.arange(n), pick] += 1 / n
        moved = a[own] @ way @ turned[own]
        slope, curve = dot(grad, way), -2 * dot(moved, way)
        with np.errstate(divide="ignore", invalid="ignore"):
            gamma = np.where(curve > 0, np.minimum(1.0, -slope / (2 * curve)), (slope + curve < 0).astype(float))
        stop = (slope > -tol) | (gamma <= 0)
        gamma[stop] = 0.0
        t[own] += gamma[:, None, None] * way
        pulled[own] += gamma[:, None, None] * moved
        new = np.where(stop, loss[own], fixed[own] - 2 * dot(pulled[own], t[own]))
        stop |= np.abs(loss[own] - new) <= tol * np.maximum(np.abs(loss[own]), 1e-300)
        loss[own], done[own] = new, stop
        own = own[~stop]
        if not len(own):
            break
    return t, loss, done


def exact_plan(a, b, steps=200, tol=1e-9, start=None):
    """Plan of one pair without entropy: (plan, loss, converged)."""
    t, loss, done = exact_plans(np.asarray(a)[None], b, steps, tol, None if start is None else np.asarray(start)[None])
    return t[0], float(loss[0]), bool(done[0])


def robust_plans(a, b, eps=0.008, steps=200):
    """Plans of a stack with fallbacks: (plans, statuses); a wider eps, then the product plan; floored and renormalised."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    t, status = np.full((len(a), a.shape[1], b.shape[-1]), 1 / (a.shape[1] * b.shape[-1])), ["uniform"] * len(a)
    top = np.abs(a).max((1, 2))
    left = np.flatnonzero(np.isfinite(top) & (top >= 1e-12))
    for e, name in ((eps, "ok"), (max(10 * eps, 0.1), "wide")):
        if len(left):
            x = gw_plans(a[left] / top[left, None, None], b if b.ndim == 2 else b[left], e, steps)[0]
            good = np.isfinite(x).all((1, 2)) & (x.sum((1, 2)) > 0)
            x = np.maximum(x[good], 1e-15)
            t[left[good]] = x / x.sum((1, 2), keepdims=True)
            for i in left[good]:
                status[i] = name
            left = left[~good]
    return t, status


def robust_plan(a, b, eps=0.008, steps=200):
    """Such a plan of one pair: (plan, status)."""
    t, status = robust_plans(np.asarray(a)[None], b, eps, steps)
    return t[0], status[0]


def plans_or_exact(a, b, eps=0.008, steps=2000):
    """Entropic plans of a stack, or the exact ones where they fail: (plans, statuses)."""
    b = np.asarray(b, float)
    t = gw_plans(a, b, eps, steps)[0]
    bad = np.flatnonzero(~(np.isfinite(t).all((1, 2)) & (np.abs(t.sum((1, 2)) - 1) < 1e-3)))
    if len(bad):
        t[bad] = exact_plans(np.asarray(a)[bad], b if b.ndim == 2 else b[bad])[0]
    return t, ["exact" if i in bad else "entropic" for i in range(len(t))]


def plan_or_exact(a, b, eps=0.008, steps=2000):
    """Such a plan of one pair: (plan, status)."""
    t, status = plans_or_exact(np.asarray(a)[None], b, eps, steps)
    return t[0], status[0]


def pair_distances(mats):
    """Exact distances of all pairs of a small set of cost matrices: root of the loss, not below 0."""
    d = np.zeros((len(mats), len(mats)))
    for i in range(len(mats)):
        for j in range(i):
            d[i, j] = d[j, i] = np.sqrt(max(exact_plan(mats[i], mats[j])[1], 0.0))
    return d


def random_start(n, rng):
    """Symmetric start of a barycenter: distances of random points, over their largest."""
    x = rng.normal(size=(n, 3))
    return unit_max(np.sqrt(np.square(x[:, None] - x[None]).sum(-1)))


def pulled_back(t, c):
    """Sum over a stack of T' C T: the part of a barycenter step that adds up over members."""
    return (t.transpose(0, 2, 1) @ c @ t).sum(0)


def squared(b):
    """Symmetric with an empty diagonal."""
    b = (b + b.T) / 2
    np.fill_diagonal(b, 0.0)
    return b


def barycenter(costs, n, eps=0.02, rounds=8, seed=0, restarts=2, weights=None, exact=False, tol=1e-5, steps=60):
    """Frechet mean of distance matrices: (matrix, objective), the best of a few random starts; ``exact`` uses plans
    without entropy (matrices of size n), started at the product plan."""
    rng = np.random.default_rng(seed)
    weights = np.full(len(costs), 1 / len(costs)) if weights is None else np.asarray(weights) / np.sum(weights)
    costs = np.asarray(costs, float)

    def solve(b):
        if exact:
            return exact_plans(costs, b)[:2]
        return gw_plans(costs, b, eps, steps, inner=10)[:2]

    best = (np.inf, None)
    for r in range(restarts):
        b = costs[0].copy() if r == 0 and costs.shape[1] == n else random_start(n, rng)
        for _ in range(rounds):
            t = solve(b)[0]
            new = squared(sum(w * x.T @ c @ x for w, x, c in zip(weights, t, costs)) * n * n)
            still = np.abs(new - b).max() < tol
            b = new
            if still:
                break
        best = min(best, (float(weights @ solve(b)[1]), b), key=lambda x: x[0])
    return best[1], best[0]


def pair_barycenter(costs, n, ladder=(0.01, 0.05, 0.1, 0.5), **options):
    """Barycenter by the first eps of a ladder whose result is finite: (matrix, objective, eps)."""
    for eps in ladder:
        try:
            b, loss = barycenter(costs, n, eps, **options)
        except (ValueError, FloatingPointError):
            continue
        if np.isfinite(b).all() and np.isfinite(loss):
            return b, loss, eps
    raise ValueError("no eps gives a finite barycenter")


def projected_states(series_rows, plan, coords, supports):
    """Barycentric coordinates of states: each state's nearest support names a row of the plan; its normalised row
    averages the reference's coordinates (a row without mass gives zeros)."""
    d2 = np.square(series_rows[:, None] - supports[None]).sum(-1)
    row = plan[d2.argmin(1)]
    mass = row.sum(1, keepdims=True)
    return np.where(mass > 0, row / np.where(mass > 0, mass, 1.0) @ coords, 0.0)


def sensitivity(t, left, right, values):
    """(left' T right) * value / sum of values, by mode of the right."""
    return (left.T @ t @ right) * values / values.sum()


def mediated_sensitivity(t_a, t_b, modes_a, modes_b, values):
    """Modes of two members pushed to their common reference and compared there, as a mean over its supports."""
    push = lambda t, m: (t.T @ m) / np.maximum(t.sum(0), 1e-300)[:, None]
    a, b = push(t_a, modes_a), push(t_b, modes_b)
    return (a.T @ b) / len(a) * values / values.sum()


def asymmetry(s, r, how="frobenius"):
    """Difference of two sensitivity slices of opposite direction."""
    if how == "max":
        return float(np.abs(s - r.T).max())
    if how == "gauge":
        return float(abs(np.linalg.norm(s) - np.linalg.norm(r)) / (np.linalg.norm(s) + np.linalg.norm(r) + 1e-300))
    return float(np.linalg.norm(s - r.T) / (np.linalg.norm(s) + np.linalg.norm(r) + 1e-300))
