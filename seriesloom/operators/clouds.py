"""Point clouds: blocked distance work, nearest neighbours, kernels and plan statistics.

Distance work never emits all pairs: query blocks meet point blocks in Arrow groups of fixed size, each
group multiplies matrices and returns only partial results (best k, sums, extremes).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.geometry import distances, leading_pairs, signed
from seriesloom.operators.series import spread
from seriesloom.runtime import cut

#: Rows of a block; a group holds one block of each side.
BLOCK = 2000


def cloud(df: DataFrame, idx: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, v (array of double), label; rows without vector, or with a null or not finite member, are left out."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.col(idx).isNotNull() & F.col(vector).isNotNull()).filter(ok).select(F.col(idx).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("long").alias("label"))


def against(points: DataFrame, queries: DataFrame, kernel, schema: str, rows: int = BLOCK, once: bool = False) -> DataFrame:
    """Run ``kernel(query ids, query matrix, query labels, point ids, ...)`` on every pair of blocks. With ``once``
    (points against themselves) every two blocks meet one time only: half the copies and half the work; ``same_block``
    tells a block that meets itself."""
    n_p, n_q = (max(1, -(-x.count() // rows)) for x in (points, queries))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    side = lambda df, s, own, other, n, lo, hi: df.select("id", "v", "label", F.lit(s).alias("side"), block(n).alias(own), F.explode(F.sequence(lo, hi)).alias(other))
    first, last = (F.lit(0), block(n_p)) if once else (F.lit(0), F.lit(n_q - 1))
    both = side(points, 0, "pb", "qb", n_p, first, last).unionByName(side(queries, 1, "qb", "pb", n_q, block(n_q) if once else F.lit(0), F.lit(n_p - 1)))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        q, p = df[df.side == 1], df[df.side == 0]
        if not len(q) or not len(p):
            return kernel_empty
        return kernel(q.id.to_numpy(), np.vstack(q.v), q.label.to_numpy(), p.id.to_numpy(), np.vstack(p.v), p.label.to_numpy())

    kernel_empty = pd.DataFrame({c.split()[0]: pd.Series([], dtype="float64") for c in schema.split(", ")})
    return both.groupBy("qb", "pb").applyInPandas(run, schema)


def same_block(qi: np.ndarray, pi: np.ndarray) -> bool:
    """Whether a block meets itself."""
    return len(qi) == len(pi) and set(qi.tolist()) == set(pi.tolist())


def nearest(points: DataFrame, queries: DataFrame, k: int, metric: str = "euclid") -> DataFrame:
    """i, j, d, rank: the k nearest other points of each query; ties go to the lower id."""

    def local(qi, q, ql, pi, p, pl):
        d = np.abs(q[:, None] - p[None]).max(-1) if metric == "chebyshev" else distances(q, p)
        d = np.where(qi[:, None] == pi[None], np.inf, d)
        m = min(k, len(pi))
        pick = np.argsort(d, axis=1, kind="stable")[:, :m] if len(pi) <= 4 * m else np.argpartition(d, m - 1, axis=1)[:, :m]
        return pd.DataFrame({"i": np.repeat(qi, m), "j": pi[pick].ravel(), "d": np.take_along_axis(d, pick, 1).ravel()})

    part = against(points, queries, local, "i long, j long, d double").filter("d < double('Infinity')")
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).filter(F.col("rank") <= k)


def median_distances(points: DataFrame, bins: int = 4096, few: int = 100_000) -> DataFrame:
    """same, d: the exact median distance of pairs with equal and with different labels. Counts of blocks narrow both
    medians down until few distances are left; only these are returned, so no pass emits all pairs."""

    def split(qi, q, ql, pi, p, pl):
        d, same = distances(q, p), ql[:, None] == pl[None]
        once = qi[:, None] < pi[None] if same_block(qi, pi) else np.ones(d.shape, bool)
        return [(k, d[once & (same == k)]) for k in (True, False)]

    def ends(*block):
        return pd.DataFrame([(k, len(d), d.max() if len(d) else 0.0) for k, d in split(*block)], columns=["same", "n", "hi"])

    found = {r.same: r for r in against(points, points, ends, "same boolean, n long, hi double", once=True).groupBy("same").agg(F.sum("n").alias("n"), F.max("hi").alias("hi")).collect()}
    # distances of another pass may differ in the last bits, so a range is a little wider than its bins
    ranges = {k: (-1e-9, r.hi * (1 + 1e-9) + 1e-9) for k, r in found.items() if r.n}
    left = {k: found[k].n for k in ranges}
    middle = {k: ((found[k].n - 1) // 2, found[k].n // 2) for k in ranges}
    for _ in range(4):
        if all(n <= few for n in left.values()):
            break

        def counts(*block):
            rows = []
            for k, d in split(*block):
                if k in ranges:
                    lo, hi = ranges[k]
                    at = np.bincount(np.clip((d - lo) / (hi - lo) * bins + 1, 0, bins + 1).astype(int), minlength=bins + 2)
                    rows += [(k, int(b), int(at[b])) for b in np.flatnonzero(at)]
            return pd.DataFrame(rows, columns=["same", "bin", "n"])

        seen = against(points, points, counts, "same boolean, bin int, n long", once=True).groupBy("same", "bin").agg(F.sum("n").alias("n")).toPandas()
        for k in list(ranges):
            at = np.zeros(bins + 2, int)
            own = seen[seen.same == k]
            at[own.bin] = own.n
            a, b = np.searchsorted(np.cumsum(at), middle[k], "right")
            (lo, hi), step = ranges[k], (ranges[k][1] - ranges[k][0]) / bins
            ranges[k] = (lo + (a - 1) * step - 1e-9, lo + b * step + 1e-9)
            left[k] = int(at[a : b + 1].sum())

    def rest(*block):
        rows = []
        for k, d in split(*block):
            if k in ranges:
                lo, hi = ranges[k]
                rows.append((k, -1.0, int((d < lo).sum())))
                rows += [(k, float(x), int(n)) for x, n in zip(*np.unique(d[(d >= lo) & (d <= hi)], return_counts=True))]
        return pd.DataFrame(rows, columns=["same", "d", "n"])

    e = against(points, points, rest, "same boolean, d double, n long", once=True).groupBy("same", "d").agg(F.sum("n").alias("n")).toPandas().sort_values("d")
    out = []
    for k in ranges:
        own = e[e.same == k]
        pick = np.searchsorted(np.cumsum(own.n), middle[k], "right")
        out.append((k, float(own.d.iloc[pick].mean())))
    return points.sparkSession.createDataFrame(out, "same boolean, d double")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def as_plan(v: Column) -> Column:
    """Absolute values to total mass 1."""
    m = F.transform(v, lambda x: F.abs(x))
    return F.transform(m, lambda x: x / total(m))


def entropy(t: Column) -> Column:
    """-sum t ln t over positive entries."""
    return F.aggregate(t, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def marginal(t: Column, n: int, rows: bool) -> Column:
    """Row or column sums of a flattened n x n plan."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda s, j: s + F.element_at(t, (i * n + j + 1 if rows else j * n + i + 1).cast("int"))))


def kernel_sum(points: DataFrame, n: int = 40) -> DataFrame:
    """k, eps, ln_s of the kernel sums over all ordered pairs, by partial sums of blocks."""

    def ends(qi, q, ql, pi, p, pl):
        d = distances(q, p)
        d = d[qi[:, None] != pi[None]]
        pos = d[d > 0]
        return pd.DataFrame({"lo": [pos.min() if len(pos) else np.inf], "hi": [d.max() if len(d) else 0.0]})

    r = against(points, points, ends, "lo double, hi double", once=True).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if r.lo is None or not np.isfinite(r.lo) or r.hi <= 0:
        return points.sparkSession.createDataFrame([], "k int, eps double, ln_s double")
    lo, hi = r.lo**2 / 10, r.hi**2 * 10
    eps = [lo * (hi / lo) ** (k / (n - 1)) for k in range(n)]

    def sums(qi, q, ql, pi, p, pl):
        d2 = np.square(np.where(qi[:, None] == pi[None], 0.0, distances(q, p)))
        return pd.DataFrame({"k": range(n), "eps": eps, "s": [np.exp(-d2 / e).sum() * (1 if same_block(qi, pi) else 2) for e in eps]})

    return against(points, points, sums, "k int, eps double, s double", once=True).groupBy("k", "eps").agg(F.ln(F.sum("s")).alias("ln_s"))


def steepest(sums: DataFrame) -> DataFrame:
    """Twice the largest central slope of ln_s over ln eps: dimension and the eps where it is reached."""
    w = Window.orderBy("k")  # as many rows as there are widths
    x = F.ln("eps")
    up, down = F.lead("ln_s").over(w), F.lag("ln_s").over(w)
    slope = F.coalesce((up - down) / (F.lead(x).over(w) - F.lag(x).over(w)), (up - F.col("ln_s")) / (F.lead(x).over(w) - x), (F.col("ln_s") - down) / (x - F.lag(x).over(w)))
    return sums.withColumn("slope", slope).agg((2 * F.max("slope")).alias("dimension"), F.max_by("eps", "slope").alias("eps"))


def label_dimensions(points: DataFrame, n: int = 40) -> DataFrame:
    """label, n_all, full: the kernel-sum dimension over all points of each label, by partial sums of blocks."""

    def pairs(q, ql, p, pl, qi, pi):
        d2 = np.square(distances(q, p))
        for label in np.intersect1d(ql, pl):
            own = d2[np.ix_(ql == label, pl == label)]
            yield label, own, qi[ql == label][:, None] != pi[pl == label][None]

    def ends(qi, q, ql, pi, p, pl):
        rows = [(int(k), float(d[o][d[o] > 0].min(initial=np.inf)), float(d[o].max(initial=0.0))) for k, d, o in pairs(q, ql, p, pl, qi, pi)]
        return pd.DataFrame(rows, columns=["label", "lo", "hi"])

    found = against(points, points, ends, "label long, lo double, hi double", once=True).groupBy("label").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("hi > 0").collect()
    widths = {r.label: np.geomspace(r.lo / 10, r.hi * 10, n) for r in found}

    def sums(qi, q, ql, pi, p, pl):
        rows = []
        for k, d, o in pairs(q, ql, p, pl, qi, pi):
            if int(k) in widths:
                d = np.where(o, d, 0.0)
                rows += [(int(k), j, float(e), float(np.exp(-d / e).sum()) * (1 if same_block(qi, pi) else 2)) for j, e in enumerate(widths[int(k)])]
        return pd.DataFrame(rows, columns=["label", "k", "eps", "s"])

    s = against(points, points, sums, "label long, k int, eps double, s double", once=True).groupBy("label", "k", "eps").agg(F.ln(F.sum("s")).alias("y"))
    w, x = Window.partitionBy("label").orderBy("k"), F.ln("eps")
    slope = (F.lead("y").over(w) - F.lag("y").over(w)) / (F.lead(x).over(w) - F.lag(x).over(w))
    top = s.withColumn("slope", slope).groupBy("label").agg((2 * F.max("slope")).alias("full"))
    return points.groupBy("label").agg(F.count("*").alias("n_all")).join(top, "label", "left")


def swept(blocks: DataFrame, part, merge, end=lambda x: x) -> dict[int, np.ndarray]:
    """First id -> partial results of ``part(ids, other ids, distances)`` merged over all blocks in which these ids are;
    ``end`` draws together what is merged. A task returns one result for each set of ids it meets."""

    def run(frames):
        total: dict[int, np.ndarray] = {}
        for df in frames:
            for i, j, d in zip(df.i, df.j, df.d):
                d = np.asarray(d).reshape(len(i), len(j))
                for own, new in [(i, part(i, j, d))] + ([(j, part(j, i, d.T))] if i[0] != j[0] else []):
                    at = int(own[0])
                    total[at] = end(merge([total[at], new])) if at in total else end(new)
        if total:
            yield pd.DataFrame({"at": list(total), "wide": [v.shape[1] for v in total.values()], "s": [v.ravel() for v in total.values()]})

    def add(df: pd.DataFrame) -> pd.DataFrame:
        s = end(merge([np.asarray(v).reshape(-1, w) for v, w in zip(df.s, df.wide)]))
        return pd.DataFrame({"at": [df["at"].iloc[0]], "wide": [s.shape[1]], "s": [s.ravel()]})

    schema = "at long, wide int, s array<double>"
    return {r["at"]: np.array(r.s).reshape(-1, r.wide) for r in blocks.mapInPandas(run, schema).groupBy("at").applyInPandas(add, schema).collect()}


def whole_map(points: DataFrame, n: int, k: int, side: float = 8e6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, eigenvalues and right vectors psi of the diffusion map of all points (id, v, label), as ``diffusion_map`` has
    them from whole matrices: no landmarks, and every two points meet.

    The distances stay in blocks that are kept once (n^2 / 2 of them); the widths, the two normalisations and the products of
    the eigenvalue solver are sweeps over these. The driver has the columns of its solver, not pairs. A side of a block
    has up to ``side`` numbers.
    """
    rows = int(np.clip(side // max(points.agg(F.max(F.size("v"))).first()[0] or 1, 1), 50, BLOCK))

    def keep(qi, q, ql, pi, p, pl):
        a, b = np.argsort(qi), np.argsort(pi)
        x = q[a]
        return pd.DataFrame({"i": [qi[a]], "j": [pi[b]], "d": [(distances(x) if same_block(qi, pi) else distances(x, p[b])).ravel()]})

    blocks = cut(spread(against(points, points, keep, "i array<long>, j array<long>, d array<double>", rows, once=True), "i", "j"))
    near = swept(blocks, lambda i, j, d: np.partition(d, k, axis=1)[:, : k + 1] if d.shape[1] > k else d, np.hstack, lambda x: np.partition(x, k, axis=1)[:, : k + 1] if x.shape[1] > k else x)
    ids = np.sort(np.array([r.id for r in points.select("id").collect()]))
    # a set of ids is known by its first one, and is sorted
    firsts = {int(r.i[0]): np.searchsorted(ids, np.array(r.i)) for r in blocks.filter("i[0] = j[0]").select("i").collect()}

    def whole(found, width):
        out = np.zeros((len(ids), width))
        for at, s in found.items():
            out[firsts[at]] = s
        return out

    sigma = np.maximum(whole({at: s.max(1)[:, None] for at, s in near.items()}, 1)[:, 0], 1e-12)

    def product(x):
        def part(i, j, d):
            a, b = np.searchsorted(ids, i), np.searchsorted(ids, j)
            return np.exp(-(d**2) / np.outer(sigma[a], sigma[b])) @ x[b]

        return whole(swept(blocks, part, lambda s: np.sum(s, axis=0)), x.shape[1])

    q = np.maximum(product(np.ones((len(ids), 1)))[:, 0], 1e-12)
    mass = product(1 / q[:, None])[:, 0] / q
    mass = np.maximum(mass, 1e-12 * np.median(mass) + 1e-300)
    scale = 1 / np.sqrt(mass)
    weight = (scale / q)[:, None]
    start = np.random.default_rng(0).normal(size=(len(ids), min(n + 9, len(ids))))
    start[:, 0] = np.sqrt(mass)
    values, vectors = leading_pairs(lambda x: weight * product(weight * x), start, n + 1)
    return ids, values[1:], signed(vectors[:, 1:] * scale[:, None])
