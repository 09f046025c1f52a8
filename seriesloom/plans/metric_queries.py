"""Queries on forecasts, tests and association, with SQL checks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions import statistics as st
from seriesloom.operators import series as sr
from seriesloom.plans.series_queries import _EDGES, BY, S, edges, rnd, ser
from seriesloom.runtime import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# Long table of predictions: random walk and rolling mean at horizon 3, with the recursive mean as base.
PRED = S + """, y as (select key, vintage, pos, x / 100 as y, lag(x, 3) over w / 100 as rw, avg(x) over (partition by key, vintage order by pos rows between 14 preceding and 3 preceding) / 100 as ao,
avg(x) over (partition by key, vintage order by pos rows between unbounded preceding and 1 preceding) / 100 as base from s window w as (partition by key, vintage order by pos)),
p as (select key, vintage, pos, y, base, ao, rw as yhat from y where pos > 60)"""


def predictions(spark, d):
    w = sr.over()
    y = ser(spark, d).withColumn("rw", F.lag("x", 3).over(w) / 100).withColumn("ao", F.avg("x").over(w.rowsBetween(-14, -3)) / 100)
    y = y.withColumn("base", F.avg("x").over(w.rowsBetween(Window.unboundedPreceding, -1)) / 100).withColumn("y", F.col("x") / 100)
    return y.filter("pos > 60").select(*BY, "pos", "y", "base", "ao", F.col("rw").alias("yhat"))


@query(PRED + " select key, vintage, pos, round(yhat, 7) + 0.0 as yhat from p")
def f05_random_walk(spark, d):
    return predictions(spark, d).select(*BY, "pos", rnd(F.col("yhat"), 7).alias("yhat"))


@query(PRED + " select key, vintage, pos, round(ao, 10) + 0.0 as ao from p")
def f06_rolling_mean_walk(spark, d):
    return predictions(spark, d).select(*BY, "pos", rnd(F.col("ao"), 10).alias("ao"))


@query(S + """, f as (select key, vintage, pos, x, lag(x) over w as z, floor((pos - 61) / 12) as fold from s window w as (partition by key, vintage order by pos)), k as (select distinct key, vintage, fold from f where fold >= 0),
b as (select k.key, k.vintage, k.fold, regr_slope(x, z) as slope, regr_intercept(x, z) as cut, var_pop(z) as v from k join f on f.key = k.key and f.vintage = k.vintage and f.pos <= 60 + 12 * k.fold and z is not null group by all)
select f.key, f.vintage, f.pos, round((cut + slope * z) / 1000, 6) + 0.0 as yhat from f join b using (key, vintage, fold) where v > 1e-9""")
def f01_one_feature_ridge(spark, d):
    """Walk-forward one-feature regression. Running sums at each fold's end give its fit: no row meets a fold twice."""
    w = sr.over()
    f = ser(spark, d).withColumn("z0", F.lag("x").over(w)).withColumn("fold", F.floor((F.col("pos") - 61) / 12))
    # centred by the series' first value, so the sums stay small
    first = F.first("x").over(w.rowsBetween(Window.unboundedPreceding, 0))
    f = f.withColumn("c", first).withColumn("a", F.col("z0") - F.col("c")).withColumn("b", F.when(F.col("z0").isNotNull(), F.col("x") - F.col("c")))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    for name, e in (("n", F.when(F.col("z0").isNotNull(), 1.0)), ("sa", F.col("a")), ("sb", F.col("b")), ("saa", F.col("a") * F.col("a")), ("sab", F.col("a") * F.col("b"))):
        f = f.withColumn(name, F.sum(e).over(run))
    ends = f.filter("pos >= 60 and (pos - 60) % 12 = 0").select(*BY, ((F.col("pos") - 60) / 12).cast("long").alias("fold"), "n", "sa", "sb", "saa", "sab")
    v = F.col("saa") / F.col("n") - F.pow(F.col("sa") / F.col("n"), 2)
    slope = (F.col("sab") / F.col("n") - F.col("sa") / F.col("n") * F.col("sb") / F.col("n")) / v
    ends = ends.withColumn("v", v).filter("v > 1e-9").withColumn("slope", slope).withColumn("cut", F.col("sb") / F.col("n") - F.col("slope") * F.col("sa") / F.col("n")).select(*BY, "fold", "slope", "cut")
    return f.filter("fold >= 0").select(*BY, "pos", "fold", "a", "c").join(ends, [*BY, "fold"]).select(*BY, "pos", rnd((F.col("c") + F.col("cut") + F.col("slope") * F.col("a")) / 1000).alias("yhat"))


@query(PRED + """ select key, vintage, count(*) as n, round(avg((y - yhat) * (y - yhat)), 6) as mse, round(avg(yhat - y), 6) + 0.0 as bias, round(case when sum((y - base) * (y - base)) > 1e-9 then 1 - sum((y - yhat) * (y - yhat)) / sum((y - base) * (y - base)) end, 5) + 0.0 as r2_oos,
round(avg((sign(round(y, 6)) = sign(round(yhat, 6)))::int), 6) as direction, round(case when sum((y - ao) * (y - ao)) > 1e-9 then sum((y - yhat) * (y - yhat)) / sum((y - ao) * (y - ao)) end, 5) as mse_ratio from p group by all""")
def u01_forecast_metrics(spark, d):
    sq = lambda c: F.sum((F.col("y") - F.col(c)) * (F.col("y") - F.col(c)))
    same = F.signum(F.round("y", 6)) == F.signum(F.round("yhat", 6))
    return predictions(spark, d).groupBy(*BY).agg(
        F.count("*").alias("n"), F.round(sq("yhat") / F.count("*"), 6).alias("mse"), rnd(F.avg(F.col("yhat") - F.col("y"))).alias("bias"), rnd(F.when(sq("base") > 1e-9, 1 - sq("yhat") / sq("base")), 5).alias("r2_oos"),
        F.round(F.avg(same.cast("int")), 6).alias("direction"), F.round(F.when(sq("ao") > 1e-9, sq("yhat") / sq("ao")), 5).alias("mse_ratio"),
    )


@query(PRED + " select key, vintage, round(case when var_pop(y) * count(*) < 1e-9 then case when sum((y - yhat) * (y - yhat)) < 1e-9 then 0 end else 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) end, 5) + 0.0 as r2 from p group by all")
def u02_r_squared(spark, d):
    g = predictions(spark, d).groupBy(*BY).agg(F.sum((F.col("y") - F.col("yhat")) * (F.col("y") - F.col("yhat"))).alias("e"), (F.var_pop("y") * F.count("*")).alias("t"))
    return g.select(*BY, rnd(F.when(F.col("t") < 1e-9, F.when(F.col("e") < 1e-9, 0.0)).otherwise(1 - F.col("e") / F.col("t")), 5).alias("r2"))


@query("with p as (select label, vec_id, abs(embedding[1]::double) as p from embeddings), r as (select *, row_number() over (partition by label order by p, vec_id) as rk, count(*) over (partition by label) as n from p) select vec_id, round(least(1.0, min(p * n / rk) over (partition by label order by rk rows between current row and unbounded following)), 9) as q from r")
def u06_false_discovery(spark, d):
    p = table(spark, d, "embeddings").select("label", "vec_id", F.abs(F.col("embedding")[0].cast("double")).alias("p"))
    w = Window.partitionBy("label").orderBy("p", "vec_id")
    r = p.withColumn("rk", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("label")))
    q = F.min(F.col("p") * F.col("n") / F.col("rk")).over(Window.partitionBy("label").orderBy("rk").rowsBetween(0, Window.unboundedFollowing))
    return r.select("vec_id", F.round(F.least(F.lit(1.0), q), 9).alias("q"))


@query(PRED + """, d as (select key, vintage, pos, (y - yhat) * (y - yhat) - (y - ao) * (y - ao) as d from p), m as (select *, d - avg(d) over (partition by key, vintage) as c from d), l as (select *, lag(c) over w as c1, lag(c, 2) over w as c2 from m window w as (partition by key, vintage order by pos)),
g as (select key, vintage, count(*) as n, avg(d) as mean, sum(c * c) / count(*) as g0, coalesce(sum(c * c1), 0) / count(*) as g1, coalesce(sum(c * c2), 0) / count(*) as g2 from l group by all)
select key, vintage, round(mean / sqrt(case when g0 + 2 * (g1 + g2) > 1e-12 then g0 + 2 * (g1 + g2) else g0 end / n) * sqrt(greatest((n + 1 - 6 + 6.0 / n) / n, 0)), 4) + 0.0 as t from g where g0 > 1e-9 and n >= 3""")
def u07_diebold_mariano(spark, d):
    w = sr.over()
    sq = lambda c: (F.col("y") - F.col(c)) * (F.col("y") - F.col(c))
    m = predictions(spark, d).withColumn("d", sq("yhat") - sq("ao")).withColumn("c", F.col("d") - F.avg("d").over(sr.whole()))
    m = m.withColumn("c1", F.lag("c", 1).over(w)).withColumn("c2", F.lag("c", 2).over(w))
    gamma = lambda c: F.coalesce(F.sum(F.col("c") * F.col(c)), F.lit(0.0)) / F.count("*")
    g = m.groupBy(*BY).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), gamma("c").alias("g0"), (gamma("c") + 2 * (gamma("c1") + gamma("c2"))).alias("v")).filter("g0 > 1e-9 and n >= 3")
    t = F.col("mean") / F.sqrt(F.when(F.col("v") > 1e-12, F.col("v")).otherwise(F.col("g0")) / F.col("n")) * F.sqrt(F.greatest((F.col("n") - 5 + 6.0 / F.col("n")) / F.col("n"), F.lit(0.0)))
    return g.select(*BY, rnd(t, 4).alias("t"))


@query(PRED + """, f as (select key, vintage, pos, (y - base) * (y - base) - ((y - yhat) * (y - yhat) - (base - yhat) * (base - yhat)) as f from p), m as (select *, f - avg(f) over (partition by key, vintage) as c from f), l as (select *, lag(c) over w as c1 from m window w as (partition by key, vintage order by pos)),
g as (select key, vintage, count(*) as n, avg(f) as mean, sum(c * c) / count(*) as g0, coalesce(sum(c * c1), 0) / count(*) as g1 from l group by all) select key, vintage, round(mean / sqrt((g0 + g1) / n), 4) + 0.0 as t from g where g0 + g1 > 1e-9""")
def u08_clark_west(spark, d):
    sq = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    m = predictions(spark, d).withColumn("f", sq("y", "base") - (sq("y", "yhat") - sq("base", "yhat"))).withColumn("c", F.col("f") - F.avg("f").over(sr.whole())).withColumn("c1", F.lag("c").over(sr.over()))
    g = m.groupBy(*BY).agg(F.count("*").alias("n"), F.avg("f").alias("mean"), ((F.sum(F.col("c") * F.col("c")) + F.coalesce(F.sum(F.col("c") * F.col("c1")), F.lit(0.0))) / F.count("*")).alias("v")).filter("v > 1e-9")
    return g.select(*BY, rnd(F.col("mean") / F.sqrt(F.col("v") / F.col("n")), 4).alias("t"))


@query(S + """, r as (select key, vintage, rank() over (partition by key, vintage order by x) + (count(*) over (partition by key, vintage, x) - 1) / 2.0 as a, pos::double as b from s) select key, vintage, round(corr(a, b), 6) + 0.0 as rho from r group by all having count(*) >= 10 and var_pop(a) > 1e-12""")
def v01_spearman(spark, d):
    a = F.rank().over(sr.over("x")) + (F.count("*").over(Window.partitionBy(*BY, "x")) - 1) / 2
    g = ser(spark, d).withColumn("a", a).groupBy(*BY).agg(F.corr("a", "pos").alias("rho"), F.count("*").alias("n"), F.var_pop("a").alias("v"))
    return g.filter("n >= 10 and v > 1e-12").select(*BY, rnd(F.col("rho")).alias("rho"))


@query(S + """, f as (select key, vintage, corr(x, pos) as r, count(*) as n from s group by all having var_pop(x) > 1e-12) select key, vintage, round(case when n < 4 then -1 else tanh(atanh(r) - 1.959964 / sqrt(n - 3)) end, 6) + 0.0 as lo, round(case when n < 4 then 1 else tanh(atanh(r) + 1.959964 / sqrt(n - 3)) end, 6) + 0.0 as hi from f where abs(r) < 1 - 1e-9""")
def v04_fisher_interval(spark, d):
    g = ser(spark, d).groupBy(*BY).agg(F.corr("x", "pos").alias("r"), F.count("*").alias("n"), F.var_pop("x").alias("v")).filter("v > 1e-12 and abs(r) < 1 - 1e-9")
    end = lambda s: F.when(F.col("n") < 4, float(s)).otherwise(F.tanh(F.atanh("r") + s * 1.959964 / F.sqrt(F.col("n") - 3)))
    return g.select(*BY, rnd(end(-1)).alias("lo"), rnd(end(1)).alias("hi"))


def correlations(spark, d) -> DataFrame:
    """label, a, b, r, n: correlation of every two of the coordinates (a < b) within each label. Each task adds up sums and
    products of its rows; only these meet."""

    def partial(frames):
        for df in frames:
            for label, rows in df.groupby("label", dropna=False):
                v = np.vstack(rows.v).astype(float)
                yield pd.DataFrame({"label": [label], "n": [len(v)], "s": [v.sum(0)], "p": [(v.T @ v).ravel()]})

    def joined(df: pd.DataFrame) -> pd.DataFrame:
        n, s = df.n.sum(), np.sum(np.vstack(df.s), axis=0)
        c = np.sum(np.vstack(df.p), axis=0).reshape(len(s), -1) / n - np.outer(s, s) / n**2
        sd = np.sqrt(np.maximum(np.diag(c), 0))
        i, j = np.triu_indices(len(s), 1)
        with np.errstate(all="ignore"):
            return pd.DataFrame({"label": df.label.iloc[0], "a": i, "b": j, "r": c[i, j] / (sd[i] * sd[j]), "n": n})

    v = table(spark, d, "embeddings").filter("embedding is not null").select(F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return v.mapInPandas(partial, "label long, n long, s array<double>, p array<double>").groupBy("label").applyInPandas(joined, "label long, a long, b long, r double, n long")


_R = """with x as (select label::bigint as label, unnest(range(64)) as k, unnest(embedding)::double as v, vec_id from embeddings), g as (select a.label, a.k as a, b.k as b, corr(a.v, b.v) as r, count(*) as n from x a join x b using (label, vec_id) where a.k < b.k group by all)"""


@query(_R + """, t as (select *, row_number() over (partition by label, a order by abs(round(r, 6)) desc, b) as place from g),
p as (select label, a as axis, b as feature, round(r, 6) + 0.0 as r, n, abs(r) > 0.3 as named, place from t) select label, axis, feature, r, named from p where place <= 3""")
def v02_axis_correlations(spark, d):
    """The three strongest correlations of each axis with later ones, by label, and whether they are strong enough to name it."""
    w = Window.partitionBy("label", "axis").orderBy(F.desc(F.abs("r")), "feature")
    g = correlations(spark, d).select("label", F.col("a").alias("axis"), F.col("b").alias("feature"), rnd(F.col("r")).alias("r"))
    return g.withColumn("n", F.row_number().over(w)).filter("n <= 3").select("label", "axis", "feature", "r", (F.abs("r") > 0.3).alias("named"))


@query(_R + " select label, a, b from g where abs(r) > 0.2")
def v05_collinear_pairs(spark, d):
    """Coordinates that go together, over all pairs of them within a label."""
    return correlations(spark, d).filter("abs(r) > 0.2").select("label", "a", "b")


@query()
def v05_collinear_groups(spark, d):
    """Greedy groups: coordinates in order, each with those after it that go with it and belong to no group yet. Pairs of
    coordinates of one label meet, never rows."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        taken, rows = set(), []
        for a, own in df.sort_values(["a", "b"]).groupby("a"):
            if a not in taken:
                more = [b for b in own.b if b not in taken]
                if more:
                    taken |= {a, *more}
                    rows += [(df.label.iloc[0], a, b) for b in (a, *more)]
        return pd.DataFrame(rows, columns=["label", "seed", "member"])

    return v05_collinear_pairs(spark, d).groupBy("label").applyInPandas(run, "label long, seed long, member long")


@query()
def v02_false_discovery(spark, d):
    """Correlations of coordinates within each label with their p-values (normal scores), corrected for false discoveries,
    without those between collinear coordinates."""
    g = correlations(spark, d).filter("abs(r) <= 0.95 and n > 3")
    z = F.abs(F.atanh("r")) * F.sqrt(F.col("n") - 3)

    def tail(frames):
        for df in frames:
            yield df.assign(p=[math.erfc(v / math.sqrt(2)) for v in df.z]).drop(columns="z")

    p = g.withColumn("z", z).select("label", "a", "b", "r", "z").mapInPandas(tail, "label long, a long, b long, r double, p double")
    w = Window.partitionBy("label").orderBy("p", "a", "b")
    x = p.withColumn("k", F.row_number().over(w)).withColumn("m", F.count("*").over(Window.partitionBy("label")))
    q = F.min(F.col("p") * F.col("m") / F.col("k")).over(Window.partitionBy("label").orderBy("k").rowsBetween(0, Window.unboundedFollowing))
    return x.withColumn("q", F.least(F.lit(1.0), q)).filter("q < 0.05").select("label", "a", "b", "r", "p", "q")


@query(S + """, h as (select *, pos > count(*) over (partition by key, vintage) / 2 as late from s), r as (select key, vintage, late, rank() over (partition by key, vintage order by x) + (count(*) over (partition by key, vintage, x) - 1) / 2.0 as rk from h)
select key, vintage, round((sum(rk) filter (late) - count(*) filter (late) * (count(*) filter (late) + 1) / 2.0) / (count(*) filter (late) * count(*) filter (not late)), 6) as auc from r group by all having count(*) filter (late) > 0 and count(*) filter (not late) > 0""")
def v06_auc(spark, d):
    h = ser(spark, d).withColumn("late", F.col("pos") > F.count("*").over(sr.whole()) / 2)
    h = h.withColumn("rk", F.rank().over(sr.over("x")) + (F.count("*").over(Window.partitionBy(*BY, "x")) - 1) / 2)
    g = h.groupBy(*BY).agg(F.sum(F.when(F.col("late"), F.col("rk"))).alias("s"), F.sum(F.col("late").cast("long")).alias("p"), F.count("*").alias("n")).filter("p > 0 and p < n")
    return g.select(*BY, F.round((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p"))), 6).alias("auc"))


@query(_EDGES + " select src, tgt, round(cume_dist() over (partition by src order by round(w, 4)), 9) as p from e where w > 0")
def v08_empirical_distribution(spark, d):
    e = edges(spark, d).filter("w > 0").withColumn("w", F.round("w", 4))
    return e.select("src", "tgt", F.round(F.cume_dist().over(Window.partitionBy("src").orderBy("w")), 9).alias("p"))


@query(S + """, p as (select key, vintage, date >= date '2000-01-01' as late, x / 100 as a, (x - lag(x) over w) / 100 as b from s window w as (partition by key, vintage order by pos)), c as (select key, vintage, late, count(*) as n, var_samp(a) as va, var_samp(b) as vb, covar_samp(a, b) as c from p where b is not null group by all having count(*) >= 3)
select key, vintage, late, n, round(sqrt(greatest((va + vb) / 2 + sqrt(pow((va - vb) / 2, 2) + c * c), 0)), 5) as major, round(sqrt(greatest((va + vb) / 2 - sqrt(pow((va - vb) / 2, 2) + c * c), 0)), 4) as minor from c""")
def v12_ellipses(spark, d):
    """One-sigma ellipses of the phase plane before and after a date."""
    p = ser(spark, d).withColumn("b", (F.col("x") - F.lag("x").over(sr.over())) / 100).withColumn("a", F.col("x") / 100).withColumn("late", F.col("date") >= F.lit("2000-01-01").cast("date")).filter("b is not null")
    c = p.groupBy(*BY, "late").agg(F.count("*").alias("n"), F.var_samp("a").alias("va"), F.var_samp("b").alias("vb"), F.covar_samp("a", "b").alias("c")).filter("n >= 3")
    mid, arm = (F.col("va") + F.col("vb")) / 2, F.sqrt(F.pow((F.col("va") - F.col("vb")) / 2, F.lit(2.0)) + F.col("c") * F.col("c"))
    return c.select(*BY, "late", "n", F.round(F.sqrt(F.greatest(mid + arm, F.lit(0.0))), 5).alias("major"), F.round(F.sqrt(F.greatest(mid - arm, F.lit(0.0))), 4).alias("minor"))


_FLIP = """, n as (select a.src, a.tgt, a.w as f, b.w as g from e a join e b on a.src = b.tgt and a.tgt = b.src where a.src < a.tgt), r as (select rep, src, tgt, case when (rep * 7919 + substr(src, 8)::bigint * 104729 + substr(tgt, 8)::bigint * 1299709) % 2147483647 % 2 = 0 or rep = 0 then f else g end as f, case when (rep * 7919 + substr(src, 8)::bigint * 104729 + substr(tgt, 8)::bigint * 1299709) % 2147483647 % 2 = 0 or rep = 0 then g else f end as g from n, range(2001) t(rep)),
x as (select rep, src as node, f - g as net from r union all select rep, tgt, g - f from r), s as (select rep, node, sum(net) as net from x group by all), q as (select rep, sum(abs(net)) as q from s group by rep)"""


@query(_EDGES + _FLIP + " select round((select q from q where rep = 0), 4) as observed, round(avg((q >= (select q from q where rep = 0) - 1e-9)::int), 6) as p from q where rep > 0")
def r02_direction_flip_null(spark, d):
    """Net-flow statistic against edge-direction flips: replicates are exploded per edge and aggregated."""
    e = edges(spark, d)
    back = e.select(F.col("src").alias("tgt"), F.col("tgt").alias("src"), F.col("w").alias("g"))
    n = e.withColumnRenamed("w", "f").join(back, ["src", "tgt"]).filter("src < tgt").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(2000))))
    num = lambda c: F.substring(c, 8, 10).cast("long")
    keep = ((F.col("rep") * 7919 + num("src") * 104729 + num("tgt") * 1299709) % 2147483647 % 2 == 0) | (F.col("rep") == 0)
    net = F.when(keep, F.col("f") - F.col("g")).otherwise(F.col("g") - F.col("f"))
    x = n.select("rep", F.explode(F.array(F.struct(F.col("src").alias("node"), net.alias("net")), F.struct(F.col("tgt").alias("node"), (-net).alias("net")))).alias("x")).select("rep", "x.*")
    q = x.groupBy("rep", "node").agg(F.sum("net").alias("net")).groupBy("rep").agg(F.sum(F.abs("net")).alias("q"))
    o = F.broadcast(q.filter("rep = 0").select(F.col("q").alias("o")))
    return q.filter("rep > 0").join(o).agg(F.round(F.first("o"), 4).alias("observed"), F.round(F.avg((F.col("q") >= F.col("o") - 1e-9).cast("int")), 6).alias("p"))


@query("select region, n, top, k, round(exp(lgamma(n - k + 1) - lgamma(top - k + 1) - lgamma(n - top + 1) - (lgamma(n + 1) - lgamma(top + 1) - lgamma(n - top + 1))), 9) as p from (select n_regionkey as region, 25 as n, 10 as top, least(count(*), 5) as k from nation group by all)")
def r03_rank_test(spark, d):
    """Probability that k given members are all among the top of n."""

    def log_factorial(n):
        return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, i: s + F.ln(i.cast("double")))

    g = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.least(F.count("*"), F.lit(5)).cast("int").alias("k")).withColumn("n", F.lit(25)).withColumn("top", F.lit(10))
    p = log_factorial(F.col("n") - F.col("k")) - log_factorial(F.col("top") - F.col("k")) - log_factorial(F.lit(25)) + log_factorial(F.lit(10))
    return g.select("region", "n", "top", "k", F.round(F.exp(p), 9).alias("p"))


@query("select key, vintage, count(*) as n, ceil(pow(count(*), 1.0 / 3) - 1e-9)::bigint as block from readings where date is not null and value is not null and isfinite(value) group by all")
def r06_block_length(spark, d):
    return ser(spark, d).groupBy(*BY).agg(F.count("*").alias("n")).withColumn("block", F.ceil(F.pow(F.col("n").cast("double"), F.lit(1.0 / 3)) - 1e-9))


@query("select artifact, round(avg(level), 6) as mean, round(avg(level) / (1 + stddev_pop(level)), 6) as real from (select artifact, try_cast(json_extract_string(body, '$.estimates.level') as double) as level from artifact_entries) group by all")
def v13_surrogate_score(spark, d):
    level = F.get_json_object("body", "$.estimates.level").try_cast("double")
    return table(spark, d, "artifact_entries").select("artifact", level.alias("l")).groupBy("artifact").agg(F.round(F.avg("l"), 6).alias("mean"), F.round(F.avg("l") / (1 + F.stddev_pop("l")), 6).alias("real"))


# --- p-values on aggregated rows --------------------------------------------------------------------------------


_TERM = "exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))"


@query(PRED + f""", g as (select key, vintage, sum((sign(round(y - base, 6)) = sign(round(yhat - base, 6)))::int)::bigint as hits, count(*) as n from p where yhat is not null group by all)
select key, vintage, hits, n, round(least(1, 2 * (select sum({_TERM}) from range(least(hits, n - hits) + 1) r(k))), 6) as p from g""")
def u09_sign_tests(spark, d):
    """Exact two-sided sign test of directional hits: twice the tail of the binomial with one half, 1 at most."""
    hit = (F.signum(F.round(F.col("y") - F.col("base"), 6)) == F.signum(F.round(F.col("yhat") - F.col("base"), 6))).cast("long")
    g = predictions(spark, d).filter("yhat is not null").groupBy(*BY).agg(F.sum(hit).alias("hits"), F.count("*").alias("n"))

    def run(frames):
        for df in frames:
            yield df.assign(p=[round(st.sign_test(int(h), int(n)), 6) for h, n in zip(df.hits, df.n)])

    return g.mapInPandas(run, "key string, vintage int, hits long, n long, p double")


@query()
def u07_test_p_values(spark, d):
    """Two-sided p-values of the Diebold-Mariano statistics."""
    n = predictions(spark, d).groupBy(*BY).agg(F.count("*").alias("n"))
    g = QUERIES["u07_diebold_mariano"](spark, d).join(n, BY)

    def run(frames):
        for df in frames:
            yield df.assign(p=[st.student_two_sided(t, k - 1) for t, k in zip(df.t, df.n)])

    return g.mapInPandas(run, "key string, vintage int, t double, n long, p double")


def grouped(spark, d, f, schema, least=60):
    """Apply ``f(values, seed) -> list of rows`` to each series of at least ``least`` values; failures become a row with an error.

    A series is one group, its values a float array; the number of series, not their length, grows.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(df: pd.DataFrame) -> pd.DataFrame:
        key, vintage = df["key"].iloc[0], df["vintage"].iloc[0]
        x = df.sort_values(["date", "obs_id"])["x"].to_numpy(float)
        ok, error, rows = True, None, []
        try:
            if len(x) < least:
                raise ValueError("too short")
            if not x.std() > 1e-9:
                raise ValueError("constant")
            import zlib

            rows = f((x - x.mean()) / x.std(), zlib.crc32(f"{key}|{vintage}".encode()))
        except (ValueError, FloatingPointError, IndexError) as e:
            ok, error = False, str(e)[:200]
        rows = rows or [[None] * len(names)]
        return pd.DataFrame([[key, vintage, *r, ok, error] for r in rows], columns=["key", "vintage", *names, "ok", "error"])

    rows = sr.spread(sr.finite(table(spark, d, "readings")))
    return rows.groupBy(*BY).applyInPandas(run, f"key string, vintage int, {schema}, ok boolean, error string")


def nan_to_none(v):
    return None if v is None or (isinstance(v, float) and not math.isfinite(v)) else float(v)
