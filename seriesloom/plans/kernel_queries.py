"""Queries whose operators are numerical kernels on whole series, groups or models; checked by invariants and fixtures."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesloom.functions import clustering as cu
from seriesloom.functions import descriptors as de
from seriesloom.functions import embedding as em
from seriesloom.functions import forecasting as fo
from seriesloom.functions import generators as ge
from seriesloom.functions import geometry as gm
from seriesloom.functions import statistics as st
from seriesloom.functions import topology as tp
from seriesloom.operators import clouds as cl
from seriesloom.operators import series as sr
from seriesloom.plans.cloud_queries import pts
from seriesloom.plans.metric_queries import grouped, nan_to_none, ser
from seriesloom.plans.series_queries import BY, vintages
from seriesloom.runtime import cut, is_small, table
from seriesloom.streaming import incremental as inc

QUERIES, ORACLE = {}, {}

#: Landmarks of a fitted map; points are extended from them.
LANDMARKS = 800
#: Replicates of resampling tests, as published.
BOOTSTRAPS, SURROGATES, PERMUTATIONS = 2000, 39, 200


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def even(v, n):
    """At most n rows, evenly spaced."""
    return v[np.unique(np.linspace(0, len(v) - 1, min(len(v), n)).astype(int))]


# --- embedding ----------------------------------------------------------------------------------------


@query()
def emb01_information_profile(spark, d):
    """Mutual information at all lags up to 50, with adaptive bins and bias correction, and with 64 fixed bins and none."""

    def run(x, seed):
        new, old = em.average_mutual_information(x), em.average_mutual_information(x, 50, 64, bias=False)
        return [[lag + 1, float(a), float(b)] for lag, (a, b) in enumerate(zip(new, old))]

    return grouped(spark, d, run, "lag int, ami double, ami_fixed double")


@query()
def emb05_false_neighbours(spark, d):
    """Shares of false neighbours for dimensions 1 to 20 over one set of rows, over each dimension's own rows, and the
    dimension by growth alone."""

    def run(x, seed):
        tau = em.first_minimum(em.average_mutual_information(x))
        one, own, plain = em.false_neighbours(x, tau), em.shrinking_false_neighbours(x, tau), em.plain_dimension(x, tau)
        return [[tau, k + 1, float(one[k]) if k < len(one) else None, float(own[k]) if k < len(own) else None, plain] for k in range(max(len(one), len(own)))]

    return grouped(spark, d, run, "tau int, dim int, share double, share_own double, plain_dim int")


@query()
def emb14_parameters(spark, d):
    def run(x, seed):
        tau, dim, v = em.embed(x)
        old = em.first_minimum(em.average_mutual_information(x, 20, 64, bias=False), 20, 3)
        old_dim = em.first_dimension(em.shrinking_false_neighbours(x, old), lo=3, hi=16, fallback=8)
        return [[tau, old, dim, old_dim, len(v), nan_to_none(em.neighbour_ratio(x, tau, dim)) if len(x) > dim * tau + 5 else None]]

    return grouped(spark, d, run, "tau int, tau_old int, dim int, dim_old int, n_vectors int, growth double")


def neighbours(spark, d):
    """Readings of every vintage of a key with those of the preceding one, under the earlier vintage as ``first``; a sole vintage stands alone."""
    s = ser(spark, d).select(*BY, "pos", "x")
    first = F.array_compact(F.array("before", F.when(F.col("after").isNotNull() | F.col("before").isNull(), F.col("vintage"))))
    return sr.spread(s.join(vintages(s), BY).select("key", F.explode(first).alias("first"), "vintage", "pos", "x"), "key", "first")


@query()
def emb13_joint_map(spark, d):
    """Joint diffusion map of every vintage of a key with the preceding one: their standardised clouds, right-aligned, side by side (mode 0 where there is no such pair)."""
    s = neighbours(spark, d)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        parts = [em.embed((g - g.mean()) / (g.std() + 1e-9)) for _, g in ((v, h.sort_values("pos").x.to_numpy()) for v, h in df.groupby("vintage")) if len(g) >= 50 and g.std() > 1e-9]
        if len(parts) < 2:
            return pd.DataFrame({"key": [df.key.iloc[0]], "first": [df["first"].iloc[0]], "mode": [0], "eigenvalue": [np.nan], "loops": [0]})
        n = min(len(p[2]) for p in parts)
        coords, values, *_ = gm.diffusion_map(gm.distances(np.hstack([p[2][-n:] for p in parts])), 3)
        loops = tp.loops(gm.distances(coords), of="birth")
        return pd.DataFrame({"key": df.key.iloc[0], "first": df["first"].iloc[0], "mode": range(1, len(values) + 1), "eigenvalue": values, "loops": loops})

    return s.groupBy("key", "first").applyInPandas(run, "key string, first int, mode int, eigenvalue double, loops int")


# --- maps ------------------------------------------------------------------------------------------------

VARIANTS = {
    "knn_late_window": {"theiler": 5, "late_window": True, "keep_self": True}, "knn": {}, "knn_theiler": {"theiler": 5}, "knn_alpha0": {"alpha": 0.0}, "median_markov": {"bandwidth": "median", "zero_diagonal": True, "matrix": "markov"},
    "median_lower": {"bandwidth": "median", "zero_diagonal": True, "matrix": "lower"}, "median_symmetric": {"bandwidth": "median", "zero_diagonal": True}, "kernel_sum": {"bandwidth": "kernel_sum", "zero_diagonal": True},
}


@query()
def d10_diffusion_spectra(spark, d):
    """Leading eigenvalues of every variant of the map over the whole cloud, and statistics of each spectrum."""

    def run(x, seed):
        dist = gm.distances(em.embed(x)[2])
        out = []
        for name, options in VARIANTS.items():
            o = dict(options)
            if o.get("bandwidth") == "kernel_sum":
                o["bandwidth"] = gm.kernel_sum_dimension(dist)[1]
            values = gm.diffusion_map(dist, 12, **o)[1]
            jump, bend = gm.spectrum_profile(values)
            kind, above = gm.spectral_diagnosis(values, len(dist), 12)
            out.append([name, [float(v) for v in values], float(values[0] / values[1]) if abs(values[1]) > 1e-12 else 0.0, gm.knee(values), gm.knee(values, True), nan_to_none(gm.heat_kernel_dimension(np.clip(values, 1e-9, 0.999999))), jump, bend, kind, above])
        return out

    return grouped(spark, d, run, "variant string, eigenvalues array<double>, gap double, knee int, knee_weighted int, heat_dimension double, jump int, bend int, diagnosis string, above double")


@query()
def d13_series_maps(spark, d):
    """The two ways of mapping a delay cloud: dense with its delay as window, and over 200 farthest points."""

    def run(x, seed):
        tau, _, v = em.embed(x)
        return [[kind, [float(e) for e in gm.series_map(v, 5, kind, tau)[1]]] for kind in ("dense", "farthest")]

    return grouped(spark, d, run, "version string, eigenvalues array<double>")


def landmark_model(points, k=10, n=6):
    """Map fitted on a bounded sample: the first LANDMARKS points in hash order (documented bound); the rest is extended."""
    rows = points.orderBy(sr.hash_order(F.col("id"), 0), "id").limit(LANDMARKS).select("id", "v").collect()
    v = np.array([r.v for r in rows])
    dist = gm.distances(v)
    _, values, psi, sigma, q = gm.diffusion_map(dist, n, k=k)
    return v, sigma, q, psi, values


@query()
def d12_nystrom_extension(spark, d):
    """Coordinates of every point by extension from the landmarks' map."""
    p = pts(spark, d)
    model = landmark_model(p)

    def run(frames):
        for df in frames:
            yield pd.DataFrame({"id": df.id, "label": df.label, "coords": list(gm.nystrom(model, np.vstack(df.v)))})

    return p.mapInPandas(run, "id long, label long, coords array<double>")


@query()
def d16_curvature(spark, d):
    def run(x, seed):
        v = em.embed(x)[2]
        return [[nan_to_none(gm.curvature(even(v, 1500), 12)), nan_to_none(gm.curvature(even(v, 300), 8, "diameter"))]]

    return grouped(spark, d, run, "median_ratio double, diameter_ratio double")


@query()
def d18_principal_axes(spark, d):
    """Variances along the principal axes, from one covariance matrix gathered by partial sums."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = pts(spark, d).select("id", array_to_vector("v").alias("vec"))
    model = PCA(k=5, inputCol="vec", outputCol="scores").fit(v)
    return model.transform(v).select("id", F.transform(vector_to_array("scores"), lambda x: F.round(F.abs(x), 6)).alias("scores"))


@query()
def d19_layout(spark, d):
    """Plane layout of the label centroids by stress majorisation; one row for each label goes into one task."""
    c = pts(spark, d).select("label", F.posexplode("v").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("v"))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("label")
        xy = gm.smacof(gm.distances(np.vstack(df.v)))
        return pd.DataFrame({"label": df.label, "x": xy[:, 0], "y": xy[:, 1]})

    return c.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "label long, x double, y double")


@query()
def l04_farthest_points(spark, d):
    def run(x, seed):
        v = em.embed(x)[2]
        first = int(np.random.default_rng(seed).integers(len(v)))
        return [[kind, r, int(i)] for kind, start in (("seeded", first), ("fixed", 0)) for r, i in enumerate(gm.farthest_points(v, 10, start))]

    return grouped(spark, d, run, "start string, rank int, row int")


# --- dimension, topology, descriptors, nulls ------------------------------------------------------------------------


@query()
def m02_dimension_battery(spark, d):
    """Every estimator on the whole cloud of a series; the primary value is the heat kernel's, else the neighbours'."""

    def run(x, seed):
        tau, _, v = em.embed(x)
        dist = gm.distances(v)
        values = gm.diffusion_map(dist, 20)[1]
        ks, width = gm.kernel_sum_dimension(dist)
        heat, lb, (gated, r2) = gm.heat_kernel_dimension(np.clip(values, 1e-9, 0.999999)), gm.levina_bickel(dist), gm.gated_correlation_dimension(dist, theiler=tau)
        jump, bend = gm.spectrum_profile(values)
        return [[ks, width, nan_to_none(gm.two_nn(dist)), nan_to_none(lb), nan_to_none(gm.correlation_dimension(dist, theiler=tau)), nan_to_none(gated), r2, gm.knee(values), jump, bend, nan_to_none(heat), nan_to_none(heat if np.isfinite(heat) else lb)]]

    return grouped(spark, d, run, "kernel_sum double, width double, two_nn double, levina_bickel double, correlation double, correlation_gated double, r2 double, knee int, jump int, bend int, heat double, primary double")


@query()
def m15_bootstrapped_dimension(spark, d):
    """Kernel-sum dimension by label: the estimate over all of a label's points, and replicates of matched-size subsamples
    without replacement (sizes are the least count of a label, at most LANDMARKS)."""
    p = pts(spark, d)
    sizes = p.groupBy("label").count()
    size = int(min(sizes.agg(F.expr("min(count)")).first()[0] or 0, LANDMARKS))
    w = Window.partitionBy("label", "rep").orderBy(F.xxhash64("id", "rep"), "id")
    draw = p.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= size)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        dim = gm.kernel_sum_dimension(gm.distances(np.vstack(df.v)))[0] if len(df) >= 10 else np.nan
        return pd.DataFrame({"label": [df.label.iloc[0]], "rep": [df.rep.iloc[0]], "n": [len(df)], "dimension": [dim]})

    x = draw.groupBy("label", "rep").applyInPandas(run, "label long, rep int, n int, dimension double")
    whole = cl.label_dimensions(p)
    return x.groupBy("label").agg(F.max("n").alias("n"), F.avg("dimension").alias("mean"), F.stddev_pop("dimension").alias("sd")).join(whole, "label")


@query()
def m16_calibration_ladder(spark, d):
    """Readings of the kernel-sum estimator on spheres of known dimension at growing n."""
    grid = spark.createDataFrame([(k, n) for k in (5, 7, 9, 11) for n in (100, 200, 400, 800, 1600)], "dim int, n int").repartition("dim", "n")

    def run(frames):
        for df in frames:
            yield pd.DataFrame([(k, n, gm.kernel_sum_dimension(gm.distances(ge.sphere(k, 200, n, np.random.default_rng(k * 1000 + n))))[0]) for k, n in zip(df.dim, df.n)], columns=["dim", "n", "reading"])

    return grid.mapInPandas(run, "dim int, n int, reading double")


@query()
def n01_topology(spark, d):
    """Loop test, loops and persistence of a cloud (at most 150 points for homology), and the score of its loops among
    surrogates with the same points, delay and dimension."""

    def run(x, seed):
        tau, dim, v = em.embed(x)
        v = even(v, de.HOMOLOGY)
        dist = gm.distances(v)
        cover, hole, bars, loop = tp.loop_test(v)
        b = tp.loop_bars(dist)
        life, h0 = b[:, 1] - b[:, 0], tp.component_bars(dist)
        z = de.loop_score(v, np.random.default_rng(seed), surrogates=SURROGATES)
        return [[cover, hole, bars, loop, tp.count_loops(b), tp.count_loops(b, of="birth"), float(h0.sum()), float(life.sum()), float(max(h0.max(), life.max() if len(life) else 0)), nan_to_none(z)]]

    return grouped(spark, d, run, "coverage double, hole double, bars int, loop boolean, loops_life int, loops_birth int, h0_total double, h1_total double, longest double, z double")


@query()
def n06_bootstrapped_loops(spark, d):
    """Loops of the detrended plane of every vintage and the preceding one, over 40 subsamples of 85 % of its points."""
    s = neighbours(spark, d)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        parts = [g.sort_values("pos").x.to_numpy(float) for _, g in df.groupby("vintage")]
        out = [df.key.iloc[0], df["first"].iloc[0], None, None, 0]
        if len(parts) == 2 and (n := min(map(len, parts))) >= 20:
            t = np.arange(n)
            plane = de.column_z(np.column_stack([p[-n:] - np.polyval(np.polyfit(t, p[-n:], 1), t) for p in parts]))
            counts, passed = tp.bootstrapped_loops(plane, np.random.default_rng(0))
            out[2:] = [float(counts.mean()), float(counts.std()), int(passed)]
        return pd.DataFrame([out], columns=["key", "first", "mean", "sd", "passed"])

    return s.groupBy("key", "first").applyInPandas(run, "key string, first int, mean double, sd double, passed int")


@query()
def q07_descriptors(spark, d):
    """The sixteen descriptors of each series, and the five that survive any smooth change of the observed quantity."""

    def run(x, seed):
        tau, dim, v = em.embed(x)
        b = de.bundle(x, v, tau, dim, np.random.default_rng(seed))
        return [[*(nan_to_none(b[k]) for k in de.SLOTS), [nan_to_none(b[k]) for k in de.INVARIANT]]]

    return grouped(spark, d, run, ", ".join(f"{k} double" for k in de.SLOTS) + ", invariant array<double>")


@query()
def q08_features(spark, d):
    def run(x, seed):
        dist = gm.distances(em.embed(x)[2])
        return [[[float(v) for v in de.gram_spectrum(dist, 20)], de.distance_moments(dist), [float(v) for v in de.temporal_features(x)]]]

    return grouped(spark, d, run, "spectrum array<double>, distance array<double>, temporal array<double>")


@query()
def r01_surrogate_test(spark, d):
    """Permutation entropy against phase-randomised surrogates: z-score and rank p-value."""

    def run(x, seed):
        rng = np.random.default_rng(seed)
        real = de.permutation_entropy(x, 4)
        null = np.array([de.permutation_entropy(st.phase_randomised(x, rng), 4) for _ in range(19)])
        return [[real, float(null.mean()), float((real - null.mean()) / (null.std() + 1e-9)), float((1 + (null <= real).sum()) / 20)]]

    return grouped(spark, d, run, "real double, surrogate double, z double, p double")


@query()
def r05_stationary_bootstrap(spark, d):
    """Interval of the ratio of mean squared one-step errors (random walk over mean), by stationary bootstrap."""

    def run(x, seed):
        rng = np.random.default_rng(seed)
        a, b = np.diff(x) ** 2, (x[1:] - x.mean()) ** 2
        theta = a.mean() / b.mean()
        n, length = len(a), st.block_length(len(a))
        reps = []
        for _ in range(BOOTSTRAPS):
            i = st.stationary_index(n, length, rng)
            reps.append(a[i].mean() / max(b[i].mean(), 1e-20))
        jack = ((a.sum() - a) / (n - 1)) / ((b.sum() - b) / (n - 1))
        lo, hi = st.bca_interval(theta, reps, jack)
        return [[float(theta), nan_to_none(lo), nan_to_none(hi), length]]

    return grouped(spark, d, run, "ratio double, lo double, hi double, block int")


@query()
def v03_dependence_test(spark, d):
    """Dependence of neighbouring values by kernels over the whole series, against 200 permutations."""

    def run(x, seed):
        s, p = st.hsic(x[:-1], x[1:], np.random.default_rng(seed), PERMUTATIONS)
        return [[s, p]]

    return grouped(spark, d, run, "hsic double, p double")


@query()
def f12_unit_roots(spark, d):
    """Test for a unit root with one lagged difference: statistic and approximate p-value."""
    return grouped(spark, d, lambda x, seed: [[nan_to_none(v) for v in st.unit_root(x)]], "t double, p double")


def by_label(spark, d):
    """Landmarks of each label: its first LANDMARKS points in hash order (the bound of a fitted map; all points are extended)."""
    w = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    return pts(spark, d).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= LANDMARKS).drop("r")


@query()
def v09_split_half(spark, d):
    """Agreement of the maps of the two halves of a label's landmarks, both extended to all landmarks: Procrustes
    disparity, and difference of their spectra."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        v = np.vstack(df.sort_values("id").v)
        half = len(v) // 2
        if half < 12:
            return pd.DataFrame({"label": [df.label.iloc[0]], "n": [len(v)], "disparity": [np.nan], "difference": [np.nan]})
        maps = [(w, *gm.diffusion_map(gm.distances(w), 3)[1:]) for w in (v[:half], v[half:])]
        a, b = (gm.nystrom((w, sigma, q, psi, values), v) for w, values, psi, sigma, q in maps)
        return pd.DataFrame({"label": [df.label.iloc[0]], "n": [len(v)], "disparity": [st.procrustes(a, b)], "difference": [float(np.abs(maps[0][1] - maps[1][1]).max() / np.abs(maps[0][1]).max())]})

    return by_label(spark, d).groupBy("label").applyInPandas(run, "label long, n int, disparity double, difference double")


# --- clusters -----------------------------------------------------------------------------------------------------


@query()
def t01_kmeans(spark, d):
    """Best of several seeded runs by cost, and its contingency with the labels."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = pts(spark, d).select("id", "label", array_to_vector("v").alias("features")).cache()
    best = min((KMeans(k=10, seed=s, maxIter=20).fit(v) for s in range(3)), key=lambda m: m.summary.trainingCost)
    return best.transform(v).groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query()
def t05_adjusted_information(spark, d):
    """Adjusted mutual information from the contingency counts (one small row set)."""
    n = pts(spark, d).groupBy("label", (F.col("v")[0] > 0).cast("int").alias("k")).agg(F.count("*").alias("n"))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"ami": [st.adjusted_mutual_information(df.pivot_table(index="label", columns="k", values="n", fill_value=0).to_numpy())]})

    return n.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "ami double")


def domain_models(spark, d):
    """Domains of every label, found on its landmarks; the plain arrays of each label's model in one row."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        v = np.vstack(df.sort_values("id").v)
        label = df.label.iloc[0]
        if len(v) < 20:
            return pd.DataFrame({"label": [label], "model": [None], "n": [len(v)]})
        return pd.DataFrame({"label": [label], "model": [pickle.dumps(vars(cu.Domains(v, np.random.default_rng(7))))], "n": [len(v)]})

    return cut(by_label(spark, d).groupBy("label").applyInPandas(run, "label long, model binary, n int"))


@query()
def t09_bandwidth_persistence(spark, d):
    """For each label and bandwidth: the cluster count its spectrum suggests and the gap; the persistent count, its
    bandwidth and run beside, and how many subsamples agree."""

    def run(frames):
        for df in frames:
            rows = []
            for label, n, blob in zip(df.label, df.n, df.model):
                if blob is not None:
                    m = cu.Domains.from_state(pickle.loads(blob))
                    rows += [(label, n, k, c, g, m.count, m.width, m.run, m.agreement, m.agreement > 0.8) for k, c, g in m.rows]
            yield pd.DataFrame(rows, columns=["label", "n", "width", "count", "gap", "persistent", "best_width", "run", "agreement", "stable"])

    return domain_models(spark, d).mapInPandas(run, "label long, n int, width int, count int, gap double, persistent int, best_width int, run int, agreement double, stable boolean")


@query()
def t12_domains(spark, d):
    """Domain of every point: clusters of its label's map, found on landmarks and assigned to all points by extension.
    Points of a label with fewer than 20 points have no domain."""
    points, models = pts(spark, d), domain_models(spark, d)
    x = points.join(F.broadcast(models) if is_small(models, 200) else models, "label", "left")

    def run(frames):
        known: dict[bytes, cu.Domains] = {}
        for df in frames:
            out = pd.DataFrame({"id": df.id, "label": df.label, "k": 0, "agreement": np.nan, "domain": -1})
            for label, rows in df.groupby("label", dropna=False).groups.items():
                blob = df.model.loc[rows[0]]
                if blob is not None:
                    if label not in known:
                        known = {label: cu.Domains.from_state(pickle.loads(blob))} if len(known) > 20 else known | {label: cu.Domains.from_state(pickle.loads(blob))}
                    m = known[label]
                    out.loc[rows, ["k", "agreement"]] = [m.count, m.agreement]
                    out.loc[rows, "domain"] = m.assign(np.vstack(df.v.loc[rows]))
            yield out

    return x.select("id", "label", "v", "model").mapInPandas(run, "id long, label long, k int, agreement double, domain int")


@query()
def t11_domain_maps(spark, d):
    """The map of each domain's landmarks: size, spectral gap, dimension and whether its structure asks for a split."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        v = np.vstack(df.sort_values("id").v)
        label, rows = df.label.iloc[0], []
        if len(v) >= 20:
            m = cu.Domains(v, np.random.default_rng(7))
            for c in range(m.count):
                own = v[m.labels == c]
                if len(own) < 20:
                    rows.append((label, c, len(own), None, None, None, False, "too few"))
                    continue
                values = gm.diffusion_map(gm.distances(own), min(20, len(own) - 2))[1]
                gap, kind = float(values[0] / max(values[1], 1e-10)), gm.spectral_diagnosis(values, len(own), 20)[0]
                rows.append((label, c, len(own), gap, gm.knee(values), nan_to_none(gm.heat_kernel_dimension(np.clip(values, 1e-9, 0.999999))), gap < 1.5 and len(own) > 100 and kind == "split", kind))
        return pd.DataFrame(rows, columns=["label", "domain", "n", "gap", "knee", "heat", "needs_split", "reason"])

    return by_label(spark, d).groupBy("label").applyInPandas(run, "label long, domain int, n int, gap double, knee int, heat double, needs_split boolean, reason string")


@query()
def t02_label_clusters(spark, d):
    """Ward and spectral clusters of each label's landmarks at its persistent count."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("id")
        v = np.vstack(df.v)
        k = max(2, cu.persistent_count(gm.distances(v))[1]) if len(v) >= 20 else 1
        return pd.DataFrame({"id": df.id, "label": df.label, "k": k, "ward": cu.ward(v, k), "spectral": cu.spectral(gm.distances(v), k, np.random.default_rng(7)) if k > 1 else 0})

    return by_label(spark, d).groupBy("label").applyInPandas(run, "id long, label long, k int, ward int, spectral int")


@query()
def e11_distinct_cover(spark, d):
    """Greedy cover of each label at a distance: which points are kept."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("id")
        return df.iloc[cu.distinct_cover(np.vstack(df.v), 1.2)][["id", "label"]]

    return pts(spark, d).groupBy("label").applyInPandas(run, "id long, label long")


@query("""with c as (select vec_id as id, embedding::double[] as v from embeddings), k as (select a.id as i, list_distance(a.v, b.v) as d, row_number() over (partition by a.id order by list_distance(a.v, b.v), b.id) as k from c a join c b on a.id <> b.id qualify k <= 10),
r as (select i, max(d) as r from k group by i) select i, round(r, 6) as r from r where (((i % 2147483647) * 1103515245 + 12345) % 2147483648 + 0.5) / 2147483648 < greatest(0.05, least(1.0, r / (select median(r) from r)))""")
def e08_density_thinning(spark, d):
    """Points kept with probability by their tenth neighbour's distance over the median, clipped to [0.05, 1]."""
    p = pts(spark, d)
    r = cl.nearest(p, p, 10).groupBy("i").agg(F.max("d").alias("r"))
    med = F.broadcast(r.agg(F.percentile("r", F.lit(0.5)).alias("m")))
    u = ((F.col("i") % 2147483647 * 1103515245 + 12345) % 2147483648 + 0.5) / 2147483648
    return r.join(med).filter(u < F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.col("r") / F.col("m")))).select("i", F.round("r", 6).alias("r"))


def made(spark, n, variants, seeds, f, schema):
    """``f(family, variant, seed, series)`` for every generated series, in parallel; rows of a declared schema."""
    grid = spark.createDataFrame([(k, v, s) for k in ge.FAMILIES for v in range(variants) for s in range(seeds)], "family string, variant int, seed int")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for df in frames:
            for k, v, s in zip(df.family, df.variant, df.seed):
                yield pd.DataFrame(f(k, v, s, ge.family(k, n, s * 100_000 + list(ge.FAMILIES).index(k) * 100 + v)), columns=names)

    return sr.spread(grid, "family", "variant", "seed").mapInPandas(run, schema)


def family_distances(name, x):
    """Distances between the mapped coordinates of 40 farthest delay vectors of a generated series."""
    tau, dim = ge.FAMILIES[name]
    v = em.row_standard(em.delay_vectors((x - x.mean()) / (x.std() + 1e-12), tau, dim))
    return gm.distances(gm.diffusion_map(gm.distances(v[gm.farthest_points(v, 40)]), 10)[0])


SETS = {"m1": ["m1"], "m4": ["m4"], "m5": ["m5"], "m1_m4": ["m1", "m4"], "m1_m5": ["m1", "m5"], "m1_m4_m5": ["m1", "m4", "m5"]}


@query()
def t13_synthetic_gate(spark, d):
    """Twelve known families, five variants and five seeds of 12,000 steps: Ward clusters of each feature set against the
    truth, by seed; the best set decides."""

    def make(k, v, s, x):
        dist = family_distances(k, x)
        z = (x - x.mean()) / (x.std() + 1e-12)
        return [(s, k, v, [float(a) for a in de.gram_spectrum(dist, 20)], de.distance_moments(dist), [float(a) for a in de.temporal_features(z)])]

    def score(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["family", "variant"])
        truth = np.unique(df.family, return_inverse=True)[1]
        z = {c: de.column_z(np.nan_to_num(np.vstack(df[c]))) for c in ("m1", "m4", "m5")}
        out = []
        for name, parts in SETS.items():
            found = cu.ward(np.hstack([z[c] for c in parts]), len(ge.FAMILIES))
            table_ = np.zeros((truth.max() + 1, found.max() + 1))
            np.add.at(table_, (truth, found), 1)
            out.append((df.seed.iloc[0], name, len(df), cu.adjusted_rand(found, truth), st.adjusted_mutual_information(table_)))
        return pd.DataFrame(out, columns=["seed", "features", "n", "ari", "ami"])

    rows = made(spark, 12_000, 5, 5, make, "seed int, family string, variant int, m1 array<double>, m4 array<double>, m5 array<double>")
    return rows.groupBy("seed").applyInPandas(score, "seed int, features string, n int, ari double, ami double")


@query()
def x03_families(spark, d):
    """Series of the twelve known systems, generated in parallel: family, variant, pos, x."""
    return made(spark, 2000, 3, 1, lambda k, v, s, x: {"family": k, "variant": v, "pos": range(1, len(x) + 1), "x": x}, "family string, variant int, pos int, x double")


# --- forecasts --------------------------------------------------------------------------------------------------------


@query()
def f11_ladder(spark, d):
    """Walk-forward ladder of models on each series, in one long table, and its metrics by SQL aggregates."""

    def run(x, seed):
        rows = [[m, f, t, y, p, b] for m, f, t, y, p, b in fo.ladder(x, 1, 4, seed)]
        if not rows:
            raise ValueError("no fold")
        return rows

    # walk() has its first fold at 62 values; shorter and constant series keep a row with their error
    p = grouped(spark, d, run, "model string, fold int, t int, y double, yhat double, base double", 62)
    e = lambda c: F.sum((F.col("y") - F.col(c)) * (F.col("y") - F.col(c)))
    return p.groupBy(*BY, "model").agg(F.count("y").alias("n"), (e("yhat") / F.count("y")).alias("mse"), F.when(e("base") > 1e-9, 1 - e("yhat") / e("base")).alias("r2_oos"), F.avg((F.signum("y") == F.signum("yhat")).cast("int")).alias("direction"), F.max("error").alias("error"))


@query()
def f11_gates(spark, d):
    """Gates of the ladder for each series: errors of the ridge over those of every other model, which of them it beats, and
    whether it has skill against the recursive mean, the right direction more often than not, and all of these."""
    others = ["random_walk", "rolling_mean", "autoregression", "pca_ridge", "placebo", "shrunk"]
    m = QUERIES["f11_ladder"](spark, d).filter("n > 0").groupBy(*BY).pivot("model", ["ridge", *others]).agg(F.first("mse").alias("mse"), F.first("r2_oos").alias("r2"), F.first("direction").alias("direction"))
    ratio = {o: F.when(F.col(f"{o}_mse") > 1e-12, F.col("ridge_mse") / F.col(f"{o}_mse")) for o in others}
    beats = {o: F.coalesce(r < 1, F.lit(False)) for o, r in ratio.items()}
    skill, way = F.coalesce(F.col("ridge_r2") > 0, F.lit(False)), F.coalesce(F.col("ridge_direction") > 0.5, F.lit(False))
    every = skill & way
    for o in ("random_walk", "rolling_mean", "autoregression", "placebo", "shrunk"):
        every = every & beats[o]
    return m.select(*BY, *[ratio[o].alias(f"ratio_{o}") for o in others], *[beats[o].alias(f"beats_{o}") for o in others], F.col("ridge_r2").alias("r2_oos"), skill.alias("skill"), way.alias("direction"), every.alias("all_gates"))


@query()
def f07_random_forest(spark, d):
    """Random forest on lagged values over all series, scored on the last fifth of each."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    w = sr.over()
    x = ser(spark, d).withColumn("z", sr.zscore()).withColumn("n", F.count("*").over(sr.whole()))
    for k in range(1, 5):
        x = x.withColumn(f"l{k}", F.lag("z", k).over(w))
    x = VectorAssembler(inputCols=[f"l{k}" for k in range(1, 5)], outputCol="features", handleInvalid="skip").transform(x)
    model = RandomForestRegressor(numTrees=300, minInstancesPerNode=5, maxDepth=8, seed=7, labelCol="z").fit(x.filter("pos <= 0.8 * n"))
    out = model.transform(x.filter("pos > 0.8 * n"))
    return out.groupBy(*BY).agg(F.count("*").alias("n"), F.avg((F.col("z") - F.col("prediction")) * (F.col("z") - F.col("prediction"))).alias("mse"))


# --- streaming ------------------------------------------------------------------------------------------------------------


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(avg(value), 8) as mean from events group by all")
def x21_stream_hourly(spark, d):
    return inc.drain(inc.hourly(inc.source(spark, f"{d}/events.parquet")), "complete").withColumn("mean", F.round("mean", 8))


@query("select user_id, event_id, [value, lag(value) over w, lag(value, 2) over w] as v from events window w as (partition by user_id order by ts, event_id) qualify lag(event_id, 2) over w is not null")
def x22_stream_delay_vectors(spark, d):
    return inc.drain(inc.delay_vectors(inc.source(spark, f"{d}/events.parquet")), "append")


@query("select user_id, count(*) as n, max(n) as longest from (select user_id, s, count(*) as n from (select user_id, sum(new) over (partition by user_id order by ts, event_id) as s from (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as new from events)) group by all) group by user_id")
def x23_sessions(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.count("*").alias("k"))
    return s.groupBy("user_id").agg(F.count("*").alias("n"), F.max("k").alias("longest"))
