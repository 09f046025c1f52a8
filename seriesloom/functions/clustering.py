"""Clustering of small sets (plain NumPy)."""

import numpy as np

from seriesloom.functions.geometry import diffusion_map, distances, nystrom


def ward(v, k):
    """Labels of k clusters by Ward's criterion (Lance-Williams updates)."""
    n = len(v)
    d = distances(v) ** 2
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    alive = np.ones(n, bool)
    for _ in range(n - k):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        others = alive.copy()
        others[[i, j]] = False
        s = size[others]
        new = ((size[i] + s) * d[i, others] + (size[j] + s) * d[j, others] - s * d[i, j]) / (size[i] + size[j] + s)
        d[i, others] = d[others, i] = new
        d[j], d[:, j] = np.inf, np.inf
        alive[j] = False
        size[i] += size[j]
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def kmeans(v, k, rng, rounds=100, starts=10):
    """Labels of the best of several k-means runs with distance-weighted starts."""
    best = (np.inf, None)
    for _ in range(starts):
        c = v[[rng.integers(len(v))]]
        while len(c) < k:
            w = np.square(distances(v, c)).min(1)
            c = np.vstack([c, v[rng.choice(len(v), p=w / w.sum()) if w.sum() > 0 else rng.integers(len(v))]])
        for _ in range(rounds):
            lab = distances(v, c).argmin(1)
            new = np.array([v[lab == i].mean(0) if (lab == i).any() else c[i] for i in range(k)])
            if np.allclose(new, c):
                break
            c = new
        best = min(best, (np.square(v - c[lab]).sum(), lab), key=lambda x: x[0])
    return best[1]


def spectral(d, k, rng):
    """Labels from the leading eigenvectors of a Gaussian affinity with the median distance as width."""
    a = np.exp(-(d**2) / (2 * np.median(d[d > 0]) ** 2))
    s = 1 / np.sqrt(a.sum(1))
    vec = np.linalg.eigh(a * np.outer(s, s))[1][:, -k:]
    return kmeans(vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12), k, rng)


def adjusted_rand(a, b):
    t = np.zeros((max(a) + 1, max(b) + 1))
    np.add.at(t, (np.asarray(a), np.asarray(b)), 1)
    c2 = lambda x: (x * (x - 1) / 2).sum()
    i, r, c, n = c2(t), c2(t.sum(1)), c2(t.sum(0)), c2(np.array([len(a)]))
    return float((i - r * c / n) / ((r + c) / 2 - r * c / n)) if (r + c) / 2 != r * c / n else 1.0


def distinct_cover(v, least):
    """Greedy cover in order: keep a point if its distance to all kept ones exceeds the least."""
    kept = [0] if len(v) else []
    for i in range(1, len(v)):
        if np.sqrt(np.square(v[kept] - v[i]).sum(1)).min() > least:
            kept.append(i)
    return np.array(kept)


def leading_gap(values, first=15):
    """Clusters that a falling spectrum (without its trivial value) suggests: the place of the largest ratio of neighbours
    plus 2, and that ratio."""
    v = np.asarray(values, float)
    ratio = (v[:-1] / np.maximum(v[1:], 1e-10))[:first]
    at = int(ratio.argmax())
    return at + 2, float(ratio[at])


WIDTHS = (3, 5, 7, 10, 15, 20, 30, 50)


def persistent_count(d, widths=WIDTHS, n=20):
    """Cluster count that persists over bandwidths: (rows of width, count, gap; count with the largest sum of gaps; the
    width in the middle of its longest run; length of that run)."""
    rows = []
    for k in sorted({min(w, len(d) // 4) for w in widths if min(w, len(d) // 4) >= 2}):
        values = diffusion_map(d, n, k=k)[1]
        if len(values) >= 3:
            rows.append((k, *leading_gap(values)))
    if not rows:
        return [], 2, 10, 0
    weight: dict[int, float] = {}
    for _, c, g in rows:
        weight[c] = weight.get(c, 0.0) + g
    best = max(weight, key=lambda c: (weight[c], -c))
    runs, start = [], None
    for i, (_, c, _) in enumerate([*rows, (0, -1, 0.0)]):
        if c == best and start is None:
            start = i
        elif c != best and start is not None:
            runs.append((start, i))
            start = None
    a, b = max(runs, key=lambda r: r[1] - r[0])
    return rows, best, rows[(a + b) // 2 if (a + b) // 2 < b else b - 1][0], b - a


def stable_count(d, rng, reps=20, share=0.7, widths=(5, 10, 15, 20, 30)):
    """Count that most subsamples and bandwidths agree on, and the share of them."""
    n = len(d)
    size = max(20, int(n * share))
    found = []
    for k in [w for w in widths if w < min(30, n // 5) or w == 5]:
        for _ in range(reps):
            s = np.sort(rng.permutation(n)[:size])
            values = diffusion_map(d[np.ix_(s, s)], 20, k=k)[1]
            if len(values) >= 3:
                found.append(leading_gap(values)[0])
    if not found:
        return 2, 0.0
    counts = np.bincount(found)
    return int(counts.argmax()), float(counts.max() / len(found))


class Domains:
    """Domains of a set of points, found on landmarks and assigned to any point by the extension of their map."""

    def __init__(self, landmarks, rng, reps=20, n=20):
        d = distances(landmarks)
        self.rows, self.count, self.width, self.run = persistent_count(d, n=n)
        _, self.agreement = stable_count(d, rng, reps)
        if self.run < 2:
            self.count = 1
        axes = min(self.count + 2, n, len(landmarks) - 2)
        coords, values, psi, sigma, q = diffusion_map(d, axes, k=self.width)
        self.model, self.gap = (landmarks, sigma, q, psi, values), float(values[0] / max(values[1], 1e-10)) if len(values) > 1 else 0.0
        own = kmeans(coords, self.count, rng) if self.count > 1 else np.zeros(len(landmarks), int)
        self.labels = own
        self.centres = np.array([coords[own == c].mean(0) for c in range(self.count)])

    @classmethod
    def from_state(cls, state):
        """The object again from its plain attributes."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def assign(self, v):
        """Domain of each point: the nearest centre in the extended coordinates."""
        return distances(nystrom(self.model, v, k=self.width), self.centres).argmin(1)
