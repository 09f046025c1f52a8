"""Queries on transport: plans, barycenters, their stores, sensitivities, coupling and networks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions import clustering as cu
from seriesloom.functions import embedding as em
from seriesloom.functions import geometry as gm
from seriesloom.functions import statistics as st
from seriesloom.functions import transport as tr
from seriesloom.operators import clouds as cl
from seriesloom.operators import series as sr
from seriesloom.plans.kernel_queries import LANDMARKS, family_distances, made, neighbours
from seriesloom.plans.metric_queries import grouped, nan_to_none
from seriesloom.plans.series_queries import BY, S, _PAIRS
from seriesloom.runtime import cut, is_small, shared_folder, table
from seriesloom.sources import files as fi

QUERIES, ORACLE = {}, {}

#: Supports of a cost matrix; regularisation and most steps of a plan.
SUPPORTS, EPS, STEPS = 40, 0.008, 1000
#: Starts of a barycenter, rounds with all of them, starts kept after those, further rounds, and steps of a plan in a round.
RESTARTS, FIRST, KEPT, ROUNDS, ROUND_STEPS = 10, 2, 2, 8, 60
#: Plans solved as one stack, and units whose barycenters go along with a job.
STACK, UNITS = 256, 200
#: Seeds of replicated coupling, and width of the probe and of routing.
SEEDS, PROBE = 12, 0.1


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def square(values) -> np.ndarray:
    """A stack of flat matrices as square ones."""
    m = np.array([np.asarray(v, float) for v in values])
    return m.reshape(len(m), int(round(m.shape[1] ** 0.5)), -1)


def supports(v) -> np.ndarray:
    """Cost matrix of a cloud: distances of its SUPPORTS farthest points over their largest."""
    if len(v) < SUPPORTS:
        raise ValueError("too few vectors")
    return tr.unit_max(gm.distances(v[gm.farthest_points(v, SUPPORTS)]))


def store(spark, name: str) -> str:
    """Folder of a store of results in the shared folder."""
    return f"{shared_folder(spark)}/store/{name}"


def cost_matrices(spark, d, clouds: bool = False) -> DataFrame:
    """key, vintage, unit, ok, error, c: one row-major cost matrix for each series, with the cloud it comes from (cloud, dim)
    if that is asked for; failures keep their row."""
    unit = table(spark, d, "series_vintages").select(*BY, "unit").dropDuplicates(BY)

    def run(x, seed):
        v = em.embed(x)[2]
        return [[supports(v).ravel(), *((v.ravel(), v.shape[1]) if clouds else ())]]

    return cut(grouped(spark, d, run, "c array<double>" + ", cloud array<double>, dim int" * clouds).join(unit, BY, "left"))


def summed(parts: DataFrame) -> DataFrame:
    """unit, restart, s, loss, n: partial sums of arrays added up; as many rows meet as there are partial results."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"unit": [df.unit.iloc[0]], "restart": [df.restart.iloc[0]], "s": [np.sum(np.vstack(df.s), axis=0)], "loss": [df.loss.sum()], "n": [int(df.n.sum())]})

    return parts.groupBy("unit", "restart").applyInPandas(run, "unit string, restart int, s array<double>, loss double, n long")


def barycenters(costs: DataFrame, eps: float = EPS, restarts: int = RESTARTS, rounds: int = ROUNDS, exact: bool = False) -> DataFrame:
    """unit, b, loss, members: Frechet mean of the cost matrices of each unit, over all its series.

    Starts run side by side: each round solves the plans of all members to every start, sums T' C T by partial sums
    and renews the starts. After FIRST rounds the KEPT ones of least mean loss go on, and the best is the result. A task
    holds its members' matrices once and stacks of plans, never a unit; the starts of UNITS units go to it with the job.
    """
    spark = costs.sparkSession
    members = cut(sr.spread(costs.filter("ok and unit is not null").select(*BY, "unit", "c")))
    units = sorted(r.unit for r in members.select("unit").distinct().collect())
    if not units:
        return spark.createDataFrame([], "unit string, b array<double>, loss double, members long")
    starts = [(u, r, [float(x) for x in tr.random_start(SUPPORTS, np.random.default_rng([k, r])).ravel()]) for k, u in enumerate(units) for r in range(restarts)]
    b = spark.createDataFrame(starts, "unit string, restart int, b array<double>")

    def solve(some: pd.DataFrame):
        names, refs = list(zip(some.unit, some.restart)), square(some.b)

        def run(frames):
            for df in frames:
                c, s, loss, n = square(df.c) if len(df) else None, np.zeros(refs.shape), np.zeros(len(refs)), np.zeros(len(refs), int)
                pairs = [(i, j) for j, (unit, _) in enumerate(names) for i in np.flatnonzero(df.unit == unit)]
                for i in range(0, len(pairs), STACK):
                    own, at = np.array(pairs[i : i + STACK]).T
                    t, l = tr.exact_plans(c[own], refs[at], 30)[:2] if exact else tr.gw_plans(c[own], refs[at], eps, ROUND_STEPS, inner=10)[:2]
                    good = np.isfinite(t).all((1, 2)) & np.isfinite(l)
                    for j in np.unique(at):
                        k = good & (at == j)
                        s[j] += tr.pulled_back(t[k], c[own[k]])
                        loss[j] += l[k].sum()
                        n[j] += k.sum()
                met = sorted({j for _, j in pairs})
                yield pd.DataFrame([(*names[j], s[j].ravel(), loss[j], n[j]) for j in met], columns=["unit", "restart", "s", "loss", "n"])

        return run

    def renew(frames):
        for df in frames:
            yield pd.DataFrame({"unit": df.unit, "restart": df.restart, "b": [tr.squared(square([s])[0] / max(n, 1) * SUPPORTS**2).ravel() for s, n in zip(df.s, df.n)]})

    for k in range(rounds + 1):
        parts = []
        for i in range(0, len(units), UNITS):
            some = F.col("unit").isin(units[i : i + UNITS])
            parts.append(members.filter(some).select("unit", "c").mapInPandas(solve(b.filter(some).toPandas()), "unit string, restart int, s array<double>, loss double, n long"))
        new = cut(summed(reduce(DataFrame.union, parts)))
        mean = new.withColumn("r", F.row_number().over(Window.partitionBy("unit").orderBy(F.col("loss") / F.col("n"), "restart")))
        if k == rounds:
            return cut(b.join(mean.filter("r = 1"), ["unit", "restart"]).select("unit", "b", (F.col("loss") / F.col("n")).alias("loss"), F.col("n").alias("members")))
        if k == FIRST and restarts > KEPT:
            new = mean.filter(F.col("r") <= KEPT).drop("r")
        b = cut(new.mapInPandas(renew, "unit string, restart int, b array<double>"))


_MEMO: dict = {}


def once(spark, d, name, build):
    """A checkpointed table that several queries of a session share, made once."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _MEMO:
        _MEMO[key] = build()
    return _MEMO[key]


def clouds_of(spark, d):
    """Costs with their clouds, for the queries that need both; these ask for it first."""
    return once(spark, d, "clouds", lambda: cost_matrices(spark, d, True))


def costs_of(spark, d):
    there = _MEMO.get((spark.sparkContext.applicationId, d, "clouds"))
    return once(spark, d, "costs", lambda: cost_matrices(spark, d)) if there is None else there.drop("cloud", "dim")


def references(spark, d):
    return once(spark, d, "references", lambda: barycenters(costs_of(spark, d)))


def plans(spark, d, eps: float = EPS, folder: str | None = None) -> DataFrame:
    """One entropic plan from each series to its unit's barycenter, in a store by content: a plan that is there already is
    read, not solved. cache_key, key, vintage, unit, t, loss, converged, status."""
    wanted = costs_of(spark, d).filter("ok").select(*BY, "unit", "c").join(references(spark, d).select("unit", "b"), "unit")
    wanted = wanted.withColumn("cache_key", fi.content_key("c", "b", F.lit(eps), F.lit(STEPS)))

    def run(frames):
        for df in frames:
            t, loss, done, status = [], [], [], []
            for i in range(0, len(df), STACK):
                part = df.iloc[i : i + STACK]
                x, l, ok = tr.gw_plans(square(part.c), square(part.b), eps, STEPS)
                for a, b, c in zip(x, l, ok):
                    good = bool(np.isfinite(a).all() and a.sum() > 0)
                    t.append(a.ravel() if good else None)
                    loss.append(float(b) if good else None)
                    done.append(bool(c))
                    status.append("ok" if good else "not finite")
            yield pd.DataFrame({"cache_key": df.cache_key, "t": t, "loss": loss, "converged": done, "status": status})

    found = fi.resumed(wanted, folder or store(spark, "plans"), lambda todo: sr.spread(todo).select("cache_key", "c", "b").mapInPandas(run, "cache_key string, t array<double>, loss double, converged boolean, status string"))
    return wanted.select("cache_key", *BY, "unit").join(found, "cache_key")


def landmark_rows(df: DataFrame, *columns: str) -> pd.DataFrame:
    """The first LANDMARKS series in hash order, on the driver: the bound of a fitted map, from which all are extended."""
    return df.orderBy(F.xxhash64(*BY), *BY).limit(LANDMARKS).select(*BY, *columns).toPandas()


# --- plans and barycenters ------------------------------------------------------------------------------------


@query()
def g01_transport_plans(spark, d):
    p = plans(spark, d)
    return p.select(*BY, "unit", "loss", "converged", "status", cl.total(F.col("t")).alias("mass"), cl.entropy(F.col("t")).alias("entropy"))


@query(f"select count(*) as n_series, 0::bigint as wrong_mass, 0::bigint as wrong_rows, 0::bigint as wrong_columns, 0::bigint as wrong_loss, 0::bigint as computed_again from ({S} select distinct key, vintage from s)")
def g02_plan_invariants(spark, d):
    """Closed forms of all plans: unit mass, uniform marginals, a loss that the sums over supports give again, and a second
    run that solves nothing. Series without plan count among the series."""
    costs, p = costs_of(spark, d), plans(spark, d)
    n = costs.select(*BY).distinct().count()
    x = p.filter("status = 'ok'").join(costs.select(*BY, "c"), BY).join(references(spark, d).select("unit", "b"), "unit")

    def run(frames):
        for df in frames:
            t, c, b = square(df.t), square(df.c), square(df.b)
            p, q = t.sum(2), t.sum(1)
            again = np.einsum("ki,kij,kj->k", p, c * c, p) + np.einsum("ki,kij,kj->k", q, b * b, q) - 2 * np.einsum("kij,kjl,klm,kim->k", c, t, b, t, optimize=True)
            bad = lambda v: np.abs(v - 1 / SUPPORTS).max(1) > 1e-6
            yield pd.DataFrame({"mass": np.abs(t.sum((1, 2)) - 1) > 1e-6, "rows": bad(t.sum(2)), "columns": bad(t.sum(1)), "loss": np.abs(again - df.loss) > 1e-9})

    bad = x.mapInPandas(run, "mass boolean, rows boolean, columns boolean, loss boolean")
    wanted = costs.filter("ok").select("unit", "c").join(references(spark, d).select("unit", "b"), "unit").withColumn("cache_key", fi.content_key("c", "b", F.lit(EPS), F.lit(STEPS)))
    again = fi.missing_work(wanted, store(spark, "plans")).count()
    count = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).cast("long")
    return bad.agg(count("mass").alias("wrong_mass"), count("rows").alias("wrong_rows"), count("columns").alias("wrong_columns"), count("loss").alias("wrong_loss")).select(F.lit(n).cast("long").alias("n_series"), "*", F.lit(again).cast("long").alias("computed_again"))


@query()
def g03_robust_plans(spark, d):
    """Plans with fallbacks for every series to its unit's barycenter, failures kept as statuses; and the plan that is exact
    where the entropic one fails."""
    x = costs_of(spark, d).filter("ok").select(*BY, "unit", "c").join(references(spark, d).select("unit", "b"), "unit")

    def run(frames):
        for df in frames:
            rows = []
            for i in range(0, len(df), STACK):
                part = df.iloc[i : i + STACK]
                c, b = square(part.c), square(part.b)
                (t, status), solver = tr.robust_plans(c, b, EPS), tr.plans_or_exact(c, b, EPS)[1]
                rows += [(key, vintage, s, float(x.sum()), tr.objective(y, z, x), how) for key, vintage, s, x, y, z, how in zip(part.key, part.vintage, status, t, c, b, solver)]
            yield pd.DataFrame(rows, columns=["key", "vintage", "status", "mass", "loss", "solver"])

    return sr.spread(x).mapInPandas(run, "key string, vintage int, status string, mass double, loss double, solver string")


@query()
def g05_exact_plans(spark, d):
    """Plans without entropy beside the entropic ones: root of the exact loss, its entropic counterpart, and the number of
    cells the exact plan uses."""
    x = plans(spark, d).filter("status = 'ok'").select(*BY, "unit", F.col("loss").alias("entropic")).join(costs_of(spark, d).select(*BY, "c"), BY).join(references(spark, d).select("unit", "b"), "unit")

    def run(frames):
        for df in frames:
            rows = []
            for i in range(0, len(df), STACK):
                part = df.iloc[i : i + STACK]
                t, loss, done = tr.exact_plans(square(part.c), square(part.b))
                rows += zip(part.key, part.vintage, np.sqrt(np.maximum(loss, 0)).tolist(), np.sqrt(np.maximum(part.entropic, 0)).tolist(), (t > 1e-9).sum((1, 2)).tolist(), done.tolist())
            yield pd.DataFrame(rows, columns=["key", "vintage", "exact", "entropic", "cells", "converged"])

    return sr.spread(x).mapInPandas(run, "key string, vintage int, exact double, entropic double, cells int, converged boolean")


@query()
def g08_barycenters(spark, d):
    return references(spark, d).select("unit", "loss", "members", F.size("b").alias("size"))


@query("select 0::bigint as wrong_size, 0::bigint as asymmetric, 0::bigint as filled_diagonal")
def g11_reference_shapes(spark, d):
    """Barycenters that aren't square, symmetric and empty on the diagonal: none."""
    each = F.sequence(F.lit(0), F.lit(SUPPORTS**2 - 1))
    cell = lambda i: F.element_at("b", i.cast("int") + 1)
    gap = F.array_max(F.transform(each, lambda i: F.abs(cell(i) - cell((i % SUPPORTS) * SUPPORTS + F.floor(i / SUPPORTS)))))
    diag = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(SUPPORTS - 1)), lambda i: F.abs(cell(i * (SUPPORTS + 1)))))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return references(spark, d).agg(count(F.size("b") != SUPPORTS**2).alias("wrong_size"), count(gap > 1e-12).alias("asymmetric"), count(diag > 0).alias("filled_diagonal"))


@query()
def g09_exact_barycenters(spark, d):
    """Barycenters from plans without entropy, one start."""
    return barycenters(costs_of(spark, d), restarts=1, rounds=6, exact=True).select("unit", "loss", "members")


@query()
def g12_reference_bundles(spark, d):
    """Each unit's barycenter with the map of its costs, the losses of its members' plans, and its distance to the others."""
    ref = references(spark, d)
    losses = plans(spark, d).groupBy("unit").agg(F.avg("loss").alias("mean_loss"), F.max("loss").alias("worst_loss"))

    def run(frames):
        for df in frames:
            values = [[float(v) for v in gm.cost_matrix_map(b, 5)[1]] for b in square(df.b)] if len(df) else []
            yield pd.DataFrame({"unit": df.unit, "eigenvalues": values})

    return ref.select("unit", "b").mapInPandas(run, "unit string, eigenvalues array<double>").join(losses, "unit")


@query()
def g05_reference_distances(spark, d):
    """Exact distances between the units' barycenters (a row for each unit; pairs of these few)."""
    rows = references(spark, d).orderBy("unit").select("unit", "b").toPandas()  # a row for each unit
    dist = tr.pair_distances(square(rows.b)) if len(rows) else np.zeros((0, 0))
    return spark.createDataFrame([(a, b, float(dist[i, j])) for i, a in enumerate(rows.unit) for j, b in enumerate(rows.unit) if i < j], "unit string, other string, distance double")


@query()
def g15_projected_states(spark, d):
    """States of each series in the coordinates of its unit's barycenter, by the row of the plan that its nearest support
    names: mean and deviation of the first three coordinates over the states."""
    clouds_ = clouds_of(spark, d).filter("ok").select(*BY, "cloud", "dim")
    p = plans(spark, d).filter("status = 'ok'").select(*BY, "unit", "t")
    ref = references(spark, d).select("unit", "b").toPandas()  # a row for each unit
    coords = {unit: gm.cost_matrix_map(b, 3)[0] for unit, b in zip(ref.unit, square(ref.b) if len(ref) else [])}

    def run(frames):
        for df in frames:
            rows = []
            for key, vintage, unit, t, cloud, dim in zip(df.key, df.vintage, df.unit, square(df.t) if len(df) else [], df.cloud, df.dim):
                v = np.asarray(cloud, float).reshape(-1, dim)
                y = tr.projected_states(v, t, coords[unit], v[gm.farthest_points(v, SUPPORTS)])
                rows.append((key, vintage, len(y), [float(a) for a in y.mean(0)], [float(a) for a in y.std(0)]))
            yield pd.DataFrame(rows, columns=["key", "vintage", "n_states", "mean", "sd"])

    return sr.spread(p.join(clouds_, BY)).mapInPandas(run, "key string, vintage int, n_states int, mean array<double>, sd array<double>")


@query()
def k06_replicates(spark, d):
    """Bootstrap replicates of each series' mean, cached by content: series, metric, seed, replicates and block length
    name them, and a second run reads them."""
    s = sr.series(table(spark, d, "readings")).groupBy(*BY).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("x")).filter(F.size("x") >= 20)
    wanted = s.withColumn("cache_key", fi.content_key(*BY, "x", F.lit("mean"), F.lit(7), F.lit(200), F.ceil(F.cbrt(F.size("x")))))

    def run(frames):
        for df in frames:
            reps = []
            for x in df.x:
                x, rng = np.asarray(x, float), np.random.default_rng(7)
                reps.append([float(x[st.stationary_index(len(x), st.block_length(len(x)), rng)].mean()) for _ in range(200)])
            yield pd.DataFrame({"cache_key": df.cache_key, "reps": reps})

    found = fi.resumed(wanted, store(spark, "replicates"), lambda todo: todo.select("cache_key", "x").mapInPandas(run, "cache_key string, reps array<double>"))
    return wanted.select("cache_key", *BY).join(found, "cache_key").select(*BY, F.size("reps").alias("n"), F.array_min("reps").alias("lo"), F.array_max("reps").alias("hi"))


# --- maps of plans ------------------------------------------------------------------------------------------------------


def plan_map(rows: pd.DataFrame, n: int = 5):
    """Fitted map of the roots of landmark plans: (points, sigma, q, psi, values)."""
    v = np.sqrt(np.maximum(np.vstack(rows.t), 0))
    dist = gm.gram_hellinger(np.vstack(rows.t))
    _, values, psi, sigma, q = gm.diffusion_map(dist, min(n, len(v) - 2), k=min(10, len(v) - 1))
    return v, sigma, q, psi, values


@query()
def d21_plan_coordinates(spark, d):
    """Coordinates of every series from the map of its plan: fitted on up to LANDMARKS plans, all plans extended."""
    p = plans(spark, d).filter("status = 'ok'")
    model = plan_map(landmark_rows(p, "t"))

    def run(frames):
        for df in frames:
            out = gm.nystrom(model, np.sqrt(np.maximum(np.vstack(df.t), 0))) if len(df) else np.zeros((0, 5))
            yield pd.DataFrame({"key": df.key, "vintage": df.vintage, "unit": df.unit, "coords": list(out)})

    return p.select(*BY, "unit", "t").mapInPandas(run, "key string, vintage int, unit string, coords array<double>")


@query()
def d15_plan_map_diagnostics(spark, d):
    """The map of Hellinger distances between landmark plans (five at least): eigenvalues, gap, and the ratio of median
    Frobenius to median Hellinger distance."""
    rows = landmark_rows(plans(spark, d).filter("status = 'ok'"), "t")
    schema = "n int, eigenvalues array<double>, gap double, hellinger double, frobenius double, ratio double"
    if len(rows) < 5:
        return spark.createDataFrame([], schema)
    values, t = plan_map(rows, 10)[4], np.vstack(rows.t)
    up = np.triu_indices(len(t), 1)
    h, f = float(np.median(gm.gram_hellinger(t)[up])), float(np.median(gm.distances(t)[up]))
    return spark.createDataFrame([(len(t), [float(v) for v in values], float(values[0] / max(values[1], 1e-12)), h, f, f / h if h > 0 else None)], schema)


@query()
def d07_cost_distances(spark, d):
    """Mean Frobenius distance of the cost matrices asked (hash divisible by 20) to all, and the nearest."""
    c = costs_of(spark, d).filter("ok").select(F.xxhash64(*BY).alias("id"), F.col("c").alias("v"), F.lit(0).cast("long").alias("label"))

    def part(qi, q, ql, pi, x, pl):
        e, other = gm.distances(q, x), qi[:, None] != pi[None]
        return pd.DataFrame({"i": qi, "n": other.sum(1), "s": (e * other).sum(1), "near": np.where(other, e, np.inf).min(1)})

    return cl.against(c, c.filter("id % 20 = 0"), part, "i long, n long, s double, near double").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("mean"), F.min("near").alias("near"))


# --- coupling ----------------------------------------------------------------------------------------------------------


@query()
def s03_reference_tensor(spark, d):
    """Sensitivities between the barycenters of all units (a row for each pair of units and modes), directed."""
    rows = references(spark, d).orderBy("unit").select("unit", "b").toPandas()  # a row for each unit
    mats, out = square(rows.b) if len(rows) else [], []
    modes = [gm.diffusion_map(m, 3) for m in mats]
    for i, a in enumerate(rows.unit):
        for j, b in enumerate(rows.unit):
            if i != j:
                f = tr.sensitivity(tr.gw_plan(mats[i], mats[j], EPS)[0], modes[i][2], modes[j][2], modes[j][1])
                out += [(a, b, k, m, float(f[k, m])) for k in range(3) for m in range(3)]
    return spark.createDataFrame(out, "unit string, other string, k int, l int, sensitivity double")


def attractor(x):
    """Cost matrix, modes and eigenvalues of a series."""
    c = supports(em.embed((x - x.mean()) / x.std())[2])
    _, values, psi, *_ = gm.diffusion_map(c, 3)
    return c, psi, values


def replicated(x, y, null, seeds: int = SEEDS) -> dict:
    """Coupling of two series through a barycenter, over random starts: information, participation, asymmetry and the
    norms of both directions, each with the null's. The plans of all seeds are solved as one stack."""
    (ca, pa, la), (cb, pb, lb), (cn, pn, ln) = attractor(x), attractor(y), attractor(null)
    out: dict[str, list] = {k: [] for k in ("mi", "mi_null", "pr", "pr_null", "asym", "forward", "back")}

    def information(t):
        t = t / t.sum()
        own = t > 0
        return float((t[own] * np.log(t[own] / np.outer(t.sum(1), t.sum(0))[own])).sum() / np.log(SUPPORTS))

    share = lambda s: float(np.square(np.square(s).sum()) / np.square(np.square(s)).sum()) if np.abs(s).max() > 0 else 0.0
    for other, psi, values, mi, pr in ((cb, pb, lb, "mi", "pr"), (cn, pn, ln, "mi_null", "pr_null")):
        two = np.concatenate([np.repeat(ca[None], seeds, 0), np.repeat(other[None], seeds, 0)])
        b = np.array([tr.random_start(SUPPORTS, np.random.default_rng(1000 + k)) for k in range(seeds)])
        for _ in range(4):
            t = tr.gw_plans(two, np.concatenate([b, b]), 0.01, ROUND_STEPS, inner=10)[0]
            pulled = t.transpose(0, 2, 1) @ two @ t * SUPPORTS**2 / 2
            b = np.array([tr.squared(m) for m in pulled[:seeds] + pulled[seeds:]])
        t = tr.gw_plans(two, np.concatenate([b, b]), 0.01, 200, inner=10)[0]
        for ta, tb in zip(t[:seeds], t[seeds:]):
            s = tr.mediated_sensitivity(ta, tb, pa, psi, values)
            out[mi].append(information(tb @ ta.T))
            out[pr].append(share(s))
            if other is cb:
                r = tr.mediated_sensitivity(tb, ta, pb, pa, la)
                out["asym"].append(float(np.linalg.norm(s - r.T) / (np.linalg.norm(s) + 1e-12)))
                out["forward"].append(float(np.linalg.norm(s)))
                out["back"].append(float(np.linalg.norm(r)))
    return out


_S5 = ["mi", "mi_null", "pr", "pr_null", "asym"]


@query()
def s05_coupling(spark, d):
    """Coupling of every vintage of a key with the preceding one over 12 seeds, against a random walk as null: information,
    participation and asymmetry with their deviations, ratio of directions, its paired test, and lagged F tests both ways."""
    s = neighbours(spark, d)
    names = [c for k in _S5 for c in (k, f"{k}_sd")] + ["direction", "direction_sd", "always", "t", "p", "f_forward", "p_forward", "f_back", "p_back"]

    def run(df: pd.DataFrame) -> pd.DataFrame:
        failed = lambda why: pd.DataFrame([[df.key.iloc[0], df["first"].iloc[0]] + [None] * len(names) + [why]], columns=["key", "first", *names, "error"])
        parts = [g.sort_values("pos").x.to_numpy(float) for _, g in df.groupby("vintage")]
        if len(parts) != 2 or min(map(len, parts)) < 60 or min(p.std() for p in parts) <= 1e-9:
            return failed("no two clouds")
        x, y = parts
        try:
            r = replicated(x, y, np.cumsum(np.random.default_rng(11).normal(size=len(x))))
        except (ValueError, IndexError, np.linalg.LinAlgError) as e:
            return failed(str(e)[:200])
        row = [f(r[k]) for k in _S5 for f in (np.mean, np.std)]
        ratio = np.array(r["forward"]) / np.maximum(r["back"], 1e-300)
        t, p, always = st.paired_t(r["forward"], r["back"])
        n = min(len(x), len(y))
        dx, dy = np.diff(x[-n:]), np.diff(y[-n:])
        row += [ratio.mean(), ratio.std(), always, t, p, *st.granger(dx, dy), *st.granger(dy, dx)]
        return pd.DataFrame([[df.key.iloc[0], df["first"].iloc[0], *(v if isinstance(v, bool) else nan_to_none(float(v)) for v in row), None]], columns=["key", "first", *names, "error"])

    schema = ", ".join(f"{n} {'boolean' if n == 'always' else 'double'}" for n in names)
    return s.groupBy("key", "first").applyInPandas(run, f"key string, first int, {schema}, error string")


@query()
def s12_soft_routing(spark, d):
    """Entropy of each series' plan to every unit's barycenter at a wide eps, and softmax weights over units."""
    x = costs_of(spark, d).filter("ok").select(*BY, "c")
    ref = references(spark, d).orderBy("unit").select("unit", "b").toPandas()  # a row for each unit
    units, mats = list(ref.unit), square(ref.b) if len(ref) else np.zeros((0, SUPPORTS, SUPPORTS))

    def run(frames):
        for df in frames:
            rows = []
            for i in range(0, len(df), STACK):
                part = df.iloc[i : i + STACK]
                c = square(part.c)
                h = np.array([[-(t[t > 0] * np.log(t[t > 0])).sum() for t in tr.gw_plans(c, b, PROBE, STEPS)[0]] for b in mats]).T
                for key, vintage, e in zip(part.key, part.vintage, h):
                    heat = max(np.subtract(*np.percentile(e, [75, 25])), e.std(), 1e-10)
                    w = np.exp(-(e - e.min()) / heat)
                    rows += [(key, vintage, u, float(a), float(b)) for u, a, b in zip(units, e, w / w.sum())]
            yield pd.DataFrame(rows, columns=["key", "vintage", "unit", "entropy", "weight"])

    return sr.spread(x).mapInPandas(run, "key string, vintage int, unit string, entropy double, weight double")


def multi_plans(spark, d) -> DataFrame:
    """key, vintage, own, unit, t, entropy, gated, coupling: a plan from every series to every unit's barycenter.

    To its own unit at full precision; to another first at the probe's width, and at full precision only if the probe's
    entropy lies at least 0.1 below that of a shuffled reference; otherwise the probe stands with coupling 0.
    """
    x = costs_of(spark, d).filter("ok and unit is not null").select(*BY, "unit", "c")
    ref = references(spark, d).orderBy("unit").select("unit", "b").toPandas()  # a row for each unit
    units, mats = list(ref.unit), square(ref.b) if len(ref) else np.zeros((0, SUPPORTS, SUPPORTS))
    entropy = lambda t: -(t[t > 0] * np.log(t[t > 0])).sum()
    rng, null = np.random.default_rng(42), []
    for b in mats:
        p = rng.permutation(SUPPORTS)
        null.append(entropy(tr.gw_plan(b[np.ix_(p, p)], b, PROBE)[0]))
    top = 2 * np.log(SUPPORTS)

    def run(frames):
        for df in frames:
            rows = []
            for i in range(0, len(df), STACK):
                part = df.iloc[i : i + STACK]
                c, own = square(part.c), part.unit.to_numpy()
                for k, (u, b) in enumerate(zip(units, mats)):
                    t = tr.gw_plans(c, b, PROBE, STEPS)[0]
                    fine = (own == u) | (np.array([entropy(x) for x in t]) < null[k] - 0.1)
                    if fine.any():
                        t[fine] = tr.gw_plans(c[fine], b, EPS, STEPS)[0]
                    for key, vintage, o, plan, f in zip(part.key, part.vintage, own, t, fine):
                        h = float(entropy(plan))
                        rows.append((key, vintage, o, u, plan.ravel(), h, bool(f), 1 - h / top if f else 0.0))
            yield pd.DataFrame(rows, columns=["key", "vintage", "own", "unit", "t", "entropy", "gated", "coupling"])

    return cut(sr.spread(x).mapInPandas(run, "key string, vintage int, own string, unit string, t array<double>, entropy double, gated boolean, coupling double"))


def multi(spark, d):
    return once(spark, d, "multi", lambda: multi_plans(spark, d))


@query()
def s07_multi_reference(spark, d):
    return multi(spark, d).select(*BY, "own", "unit", "entropy", "gated", "coupling")


def weighted_blocks(spark, d) -> tuple[DataFrame, list[str]]:
    """key, vintage, own, v: the roots of a series' plans, each weighted by the root of its coupling (0.01 at least)."""
    m = multi(spark, d)
    units = sorted(r.unit for r in m.select("unit").distinct().collect())
    block = F.transform("t", lambda x: F.sqrt(F.greatest(x, F.lit(1e-15)) * F.greatest(F.col("coupling"), F.lit(0.01))))
    v = m.select(*BY, "own", "unit", block.alias("v")).groupBy(*BY, "own").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("unit", "v"))), lambda s: s["v"])).alias("v"))
    return v, units


def coupling_model(spark, d):
    """Map of the weighted blocks, fitted on landmarks: (rows, model, units)."""
    v, units = weighted_blocks(spark, d)
    rows = landmark_rows(v, "own", "v")
    x = np.vstack(rows.v)
    _, values, psi, sigma, q = gm.diffusion_map(gm.distances(x), min(30, 2 * len(units), len(x) - 2), k=min(30, len(x) - 1))
    return rows, (x, sigma, q, psi, values), units, v


@query()
def s08_coupling_coordinates(spark, d):
    """Coordinates of every series in the coupling-weighted map, extended from its landmarks."""
    _, model, _, v = coupling_model(spark, d)

    def run(frames):
        for df in frames:
            out = gm.nystrom(model, np.vstack(df.v), k=min(30, len(model[0]))) if len(df) else []
            yield pd.DataFrame({"key": df.key, "vintage": df.vintage, "own": df.own, "coords": list(out)})

    return v.mapInPandas(run, "key string, vintage int, own string, coords array<double>")


def ranks(x):
    """Ranks with ties at their mean."""
    _, of, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[of]


def loadings(psi: np.ndarray, scores: list[np.ndarray], values: np.ndarray) -> list[float]:
    """For the series of one unit: eigenvalue-weighted rank correlations of the map's axes with the scores of every block."""
    out = np.zeros(len(scores))
    score_ranks = [[ranks(c) for c in s.T if c.std() > 1e-15] for s in scores]
    for x, lam in zip(psi.T, np.abs(values[:20])):
        if x.std() > 0:
            axis = ranks(x)
            out += [lam * max((abs(np.corrcoef(axis, r)[0, 1]) for r in block), default=0.0) for block in score_ranks]
    return out.tolist()


def block_axes(blocks: DataFrame, parts: int = 8) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """unit -> (mean, three leading right singular vectors) of the centred blocks of all series, from sums of products: one
    pass, in which a task adds up x' x of one part of a unit's rows."""

    def partial(frames):
        total: dict[str, np.ndarray] = {}
        for df in frames:
            for unit, own in df.groupby("unit"):
                x = np.vstack(own.v)
                total[unit] = total.get(unit, 0.0) + np.vstack([x.T @ x, x.sum(0), np.full(x.shape[1], len(x))])
        if total:
            yield pd.DataFrame({"unit": list(total), "s": [v.ravel() for v in total.values()]})

    def axes(df: pd.DataFrame) -> pd.DataFrame:
        s = sum(df.s)
        width = int(round((len(s) + 1) ** 0.5)) - 1  # rows are two more than columns
        s = s.reshape(-1, width)
        n, mean = s[-1, 0], s[-2] / s[-1]
        v = np.linalg.eigh(s[:-2] - n * np.outer(mean, mean))[1][:, ::-1][:, :3]
        return pd.DataFrame({"unit": [df.unit.iloc[0]], "mean": [mean], "v": [v.ravel()]})

    rows = sr.spread(blocks.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts))), "unit", "part")
    found = rows.mapInPandas(partial, "unit string, s array<double>").groupBy("unit").applyInPandas(axes, "unit string, mean array<double>, v array<double>")
    return {r.unit: (np.array(r["mean"]), np.array(r.v).reshape(len(r["mean"]), -1)) for r in found.collect()}  # a row for each unit


def coupling_matrix(spark, d, whole: bool = False) -> tuple[np.ndarray, list[str]]:
    """Directed coupling of the units: over all series of each, eigenvalue-weighted rank correlations of the map's axes with
    the three leading scores of every unit's block, over the roots of the diagonal; NaN for units with fewer than ten
    series. The map is that of all series if ``whole``; else it is fitted on landmarks, and all series are extended from it
    if there are more."""
    v, units = weighted_blocks(spark, d)
    many = v.count() > LANDMARKS
    if not (many and whole):
        rows, model, _, v = coupling_model(spark, d)
        x, _, _, psi, values = model
    split = lambda x: np.split(x, len(units), axis=1)
    out, few = np.zeros((len(units), len(units))), np.ones(len(units), bool)
    if not many:
        svd = [np.linalg.svd(b - b.mean(0), full_matrices=False) for b in split(x)]
        scores = [u[:, :3] * s[:3] for u, s, _ in svd]
        found = []
        for name, own in rows.groupby("own").indices.items():
            found.append((name, len(own), loadings(psi[own], [s[own] for s in scores], values) if len(own) >= 10 else None))
    else:
        block = F.transform("t", lambda x: F.sqrt(F.greatest(x, F.lit(1e-15)) * F.greatest(F.col("coupling"), F.lit(0.01))))
        axes = block_axes(multi(spark, d).select("unit", block.alias("v")))

        v = cut(v.withColumn("id", F.xxhash64(*BY)))
        if whole:
            ids, values, psi = cl.whole_map(v.select("id", "v", F.lit(0).cast("long").alias("label")), min(30, 2 * len(units)), 30)

        def place(frames):
            for df in frames:
                if len(df):
                    x = np.vstack(df.v)
                    coords = (psi[np.searchsorted(ids, df.id)] if whole else gm.nystrom(model, x, k=min(30, len(model[0]))))[:, :20]
                    yield pd.DataFrame({"own": df.own, "coords": list(coords), "scores": list(np.hstack([(b - axes[u][0]) @ axes[u][1] for u, b in zip(units, split(x))]))})

        def load(df: pd.DataFrame) -> pd.DataFrame:
            out = None
            if len(df) >= 10:
                scores = np.vstack(df.scores)
                out = loadings(np.vstack(df.coords), [scores[:, 3 * k : 3 * k + 3] for k in range(len(units))], values)
            return pd.DataFrame({"own": [df.own.iloc[0]], "n": [len(df)], "loads": [out]})

        found = v.mapInPandas(place, "own string, coords array<double>, scores array<double>").groupBy("own").applyInPandas(load, "own string, n long, loads array<double>").collect()
    for name, n, loads in found:
        if name in units and n >= 10:
            out[units.index(name)], few[units.index(name)] = loads, False
    root = np.where(few, np.nan, np.sqrt(np.maximum(np.diag(out), 1e-10)))
    return out / np.outer(root, root), units


@query()
def s09_coupling_matrix(spark, d):
    c, units = coupling_matrix(spark, d, True)
    return spark.createDataFrame([(a, b, nan_to_none(float(c[i, j]))) for i, a in enumerate(units) for j, b in enumerate(units)], "unit string, other string, coupling double")


@query()
def s10_coupling_network(spark, d):
    """Units as a network: place in the plane (scaling of 1 less mean coupling), and coupling out, in and net. Units whose
    coupling isn't known couple with none."""
    c, units = coupling_matrix(spark, d, True)
    c = np.nan_to_num(c)
    dist = np.clip(1 - (c + c.T) / 2, 0, None)
    np.fill_diagonal(dist, 0.0)
    xy = gm.smacof(dist)
    off = c - np.diag(np.diag(c))
    return spark.createDataFrame([(u, float(xy[i, 0]), float(xy[i, 1]), float(off[i].sum()), float(off[:, i].sum()), float(off[i].sum() - off[:, i].sum())) for i, u in enumerate(units)], "unit string, x double, y double, sent double, received double, net double")


@query("""with c as (select vec_id as id, embedding::double[] as v, label::bigint as label from embeddings), p as (select a.id, a.label, a.label // 2 as pair, a.label = b.label as same, list_distance(a.v, b.v) as d from c a join c b on a.id <> b.id and a.label // 2 = b.label // 2),
n as (select id, label, pair, 1 as one, d, row_number() over (partition by id order by d) as k from p where same union all select id, label, pair, 0, d, row_number() over (partition by id order by d) from p),
r as (select id, any_value(label) as label, any_value(pair) as pair, one, min(d) filter (k = 1) as r1, min(d) filter (k = 2) as r2 from n where k <= 2 group by id, one), e as (select pair, case when one = 1 then label end as label, count(*) as n, count(*) / sum(ln(r2 / r1)) as dim from r where r1 > 1e-10 group by all)
select pair, round(sum(dim) filter (label is not null), 4) as apart, round(sum(dim) filter (label is null), 4) as together, round(sum(dim) filter (label is null) / sum(dim) filter (label is not null), 4) as rho from e where n >= 20 group by pair having count(*) = 3""")
def s11_coupling_rho(spark, d):
    """Dimension of two labels together over the sum of their dimensions (two nearest neighbours), by pairs of labels."""
    p = cl.cloud(table(spark, d, "embeddings"))

    def two(qi, q, ql, pi, x, pl):
        dist, rows = np.where(qi[:, None] == pi[None], np.inf, gm.distances(q, x)), []
        for one, ok in ((1, ql[:, None] == pl[None]), (0, ql[:, None] // 2 == pl[None] // 2)):
            near = np.sort(np.where(ok, dist, np.inf), axis=1)[:, :2]
            rows.append(pd.DataFrame({"id": np.repeat(qi, near.shape[1]), "label": np.repeat(ql, near.shape[1]), "one": one, "d": near.ravel()}))
        return pd.concat(rows)

    w = Window.partitionBy("id", "one").orderBy("d")
    r = cl.against(p, p, two, "id long, label long, one int, d double").filter("d < double('Infinity')").withColumn("k", F.row_number().over(w)).filter("k <= 2")
    r = r.groupBy("id", "label", "one").agg(F.min("d").alias("r1"), F.max("d").alias("r2")).filter("r1 > 1e-10")
    e = r.withColumn("pair", F.floor(F.col("label") / 2)).groupBy("pair", F.when(F.col("one") == 1, F.col("label")).alias("label")).agg(F.count("*").alias("n"), (F.count("*") / F.sum(F.ln(F.col("r2") / F.col("r1")))).alias("dim")).filter("n >= 20")
    apart, together = F.sum(F.when(F.col("label").isNotNull(), F.col("dim"))), F.sum(F.when(F.col("label").isNull(), F.col("dim")))
    return e.groupBy("pair").agg(F.round(apart, 4).alias("apart"), F.round(together, 4).alias("together"), F.round(together / apart, 4).alias("rho"), F.count("*").alias("n")).filter("n = 3").drop("n")


@query()
def t14_family_recovery(spark, d):
    """Known families found again from transport plans: cost matrices of generated series, their barycenter, maps of the
    plans' Hellinger and Frobenius distances, clusters against the truth, and the ratio of median distances between and
    within families."""
    from seriesloom.functions import generators as ge

    def make(k, v, s, x):
        return [(k, v, [float(a) for a in tr.unit_max(family_distances(k, x)).ravel()])]

    rows = made(spark, 3000, 5, 1, make, "family string, variant int, c array<double>")

    def score(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["family", "variant"])
        costs, truth = square(df.c), np.unique(df.family, return_inverse=True)[1]
        first = np.flatnonzero(df.variant.to_numpy() == 0)
        b, _ = tr.barycenter(costs[first], SUPPORTS, EPS, rounds=8, restarts=3)
        t = tr.gw_plans(costs, b, EPS, STEPS)[0].reshape(len(costs), -1)
        out = []
        for name, dist in (("hellinger", gm.gram_hellinger(t)), ("frobenius", gm.distances(t))):
            coords = gm.diffusion_map(dist, 6, bandwidth="median", zero_diagonal=True, matrix="markov")[0]
            found = cu.kmeans(coords, len(ge.FAMILIES), np.random.default_rng(0))
            i, j = np.triu_indices(len(t), 1)
            same = truth[i] == truth[j]
            out.append((name, len(t), cu.adjusted_rand(found, truth), float(np.median(dist[i, j][~same]) / np.median(dist[i, j][same]))))
        return pd.DataFrame(out, columns=["distance", "n", "ari", "ratio"])

    # sixty generated series by design: one small group
    return rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(score, "distance string, n int, ari double, ratio double")


@query(_PAIRS + """, j as (select l.pair, l.date, l.x - lag(l.x) over w as u, r.x - lag(r.x) over w as v from (select pair, date, max_by(x, pos) as x from a group by all) l join (select pair, date, max_by(x, pos) as x from b group by all) r using (pair, date) window w as (partition by l.pair order by l.date)),
h as (select pair, date >= date '2000-01-01' as late, u / 100 as u, v / 100 as v from j where u is not null), c as (select pair, late, count(*) as n, var_samp(u) as a, var_samp(v) as b, covar_samp(u, v) as c from h group by all having count(*) >= 3)
select pair, late, n, round(sqrt(greatest((a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c), 0)), 5) as major from c""")
def v14_hysteresis(spark, d):
    """Ellipses of the plane of changes of a vintage and the preceding one, before and after a date."""
    j = changes_plane(spark, d)
    c = j.groupBy("pair", "late").agg(F.count("*").alias("n"), F.var_samp("u").alias("a"), F.var_samp("v").alias("b"), F.covar_samp("u", "v").alias("c")).filter("n >= 3")
    arm = F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, F.lit(2.0)) + F.col("c") * F.col("c"))
    return c.select("pair", "late", "n", F.round(F.sqrt(F.greatest((F.col("a") + F.col("b")) / 2 + arm, F.lit(0.0))), 5).alias("major"))


def changes_plane(spark, d) -> DataFrame:
    """pair, late, u, v: joint changes of a vintage and the preceding one, marked by whether they are later than the date."""
    from seriesloom.plans.series_queries import pairs

    one = lambda s, n: s.groupBy("pair", "date").agg(F.max_by("x", "pos").alias(n))
    a, b = pairs(spark, d)
    w = Window.partitionBy("pair").orderBy("date")
    j = one(a, "x").join(one(b, "y"), ["pair", "date"])
    j = j.withColumn("u", (F.col("x") - F.lag("x").over(w)) / 100).withColumn("v", (F.col("y") - F.lag("y").over(w)) / 100).filter("u is not null")
    return j.select("pair", (F.col("date") >= F.lit("2000-01-01").cast("date")).alias("late"), "u", "v")


@query()
def r10_ellipse_intervals(spark, d):
    """Intervals of those ellipses' half-axes and angle over 1,000 resamples."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        (a, b), (c, e), (f, g) = st.ellipse_intervals(df[["u", "v"]].to_numpy(float), np.random.default_rng(0))
        return pd.DataFrame([[df.pair.iloc[0], df.late.iloc[0], len(df), a, b, c, e, f, g]], columns=["pair", "late", "n", "major_lo", "major_hi", "minor_lo", "minor_hi", "angle_lo", "angle_hi"])

    return changes_plane(spark, d).groupBy("pair", "late").applyInPandas(run, "pair string, late boolean, n int, major_lo double, major_hi double, minor_lo double, minor_hi double, angle_lo double, angle_hi double")
