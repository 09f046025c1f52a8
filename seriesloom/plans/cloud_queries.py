"""Queries on point clouds and transport plans, with SQL checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesloom.functions.geometry import distances
from seriesloom.operators import clouds as cl
from seriesloom.operators import series as sr
from seriesloom.plans.series_queries import _PAIRS, BY, S, pairs, rnd, ser
from seriesloom.runtime import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def pts(spark, d):
    return cl.cloud(table(spark, d, "embeddings"))


def asked(p):
    """The stated query set: every row whose id is divisible by 20."""
    return p.filter("id % 20 = 0")


C = "with c as (select vec_id as id, embedding::double[] as v, label::bigint as label from embeddings)"
DIST = "list_distance(a.v, b.v)"
PLAN = C + ", t as (select id, label, list_transform(v, lambda x: abs(x) / list_sum(list_transform(v, lambda y: abs(y)))) as t from c)"
KNN = C + ", k as (select a.id as i, b.id as j, list_distance(a.v, b.v) as d, row_number() over (partition by a.id order by list_distance(a.v, b.v), b.id) as rank from c a join c b on a.id <> b.id{where} qualify rank <= {k})"


# --- array functions -------------------------------------------------------------------------------------


@query(C + " select id, round(list_sum(list_transform(v, lambda x: (x - list_avg(v)) / greatest(list_stddev_pop(v), 1e-8))), 6) + 0.0 as s, round((v[1] - list_avg(v)) / greatest(list_stddev_pop(v), 1e-8), 6) + 0.0 as first from c")
def b05_row_standard(spark, d):
    m = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    sd = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x - F.col("m")) * (x - F.col("m"))) / F.size("v"))
    z = F.transform("v", lambda x: (x - F.col("m")) / F.greatest(F.col("sd"), F.lit(1e-8)))
    return pts(spark, d).withColumn("m", m).withColumn("sd", sd).withColumn("z", z).select("id", rnd(cl.total(F.col("z"))).alias("s"), rnd(F.col("z")[0]).alias("first"))


@query(C + " select id, round(case when list_stddev_pop(v) < 0.12 then 0.0 else (v[2] - list_avg(v)) / list_stddev_pop(v) end, 6) + 0.0 as second from c")
def b06_row_standard_flat_zero(spark, d):
    m = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    sd = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x - F.col("m")) * (x - F.col("m"))) / F.size("v"))
    return pts(spark, d).withColumn("m", m).withColumn("sd", sd).select("id", rnd(F.when(F.col("sd") < 0.12, 0.0).otherwise((F.col("v")[1] - F.col("m")) / F.col("sd"))).alias("second"))


@query(C + " select id, round(v[1] / list_max(list_transform(v, lambda x: abs(x))), 6) + 0.0 as unit, round(2 * v[1] / list_max(list_transform(v, lambda x: abs(x))), 6) + 0.0 as regime from c")
def b09_unit_max(spark, d):
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    return pts(spark, d).select("id", rnd(F.col("v")[0] / top).alias("unit"), rnd(2 * F.col("v")[0] / top).alias("regime"))


@query(C + " select id, round(list_max(list_transform(v, lambda x: 2 * x / list_max(list_transform(v, lambda y: abs(y))))), 6) as top from c")
def b10_regime_scale(spark, d):
    """Values scaled so that the largest magnitude is 2: the largest value after it."""
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    return pts(spark, d).select("id", F.round(F.array_max(F.transform("v", lambda x: 2 * x / top)), 6).alias("top"))


@query(PLAN + " select id, round(t[1], 9) as first, round(sqrt(t[64]), 9) as root from t")
def b11_mass_and_root(spark, d):
    return pts(spark, d).select("id", cl.as_plan(F.col("v")).alias("t")).select("id", F.round(F.col("t")[0], 9).alias("first"), F.round(F.sqrt(F.col("t")[63]), 9).alias("root"))


@query(PLAN + """, h as (select *, list_sum(list_transform(t, lambda x: case when x > 0 then -x * ln(x) else 0 end)) as h from t)
select id, round(h, 6) as entropy, round(1 - h / (2 * ln(8)), 6) as strength, round(exp(h), 4) as support, round(1 / list_sum(list_transform(t, lambda x: x * x)), 4) as participation, round(sqrt(list_sum(list_transform(t, lambda x: (x - 1.0 / 64) * (x - 1.0 / 64)))), 6) as structure from h""")
def h01_plan_statistics(spark, d):
    t = pts(spark, d).select("id", cl.as_plan(F.col("v")).alias("t")).withColumn("h", cl.entropy(F.col("t")))
    gap = F.sqrt(F.aggregate("t", F.lit(0.0), lambda s, x: s + (x - 1 / 64) * (x - 1 / 64)))
    return t.select("id", F.round("h", 6).alias("entropy"), F.round(1 - F.col("h") / (2 * float(np.log(8))), 6).alias("strength"), F.round(F.exp("h"), 4).alias("support"), F.round(1 / cl.dot(F.col("t"), F.col("t")), 4).alias("participation"), F.round(gap, 6).alias("structure"))


@query(PLAN + """, x as (select id, unnest(range(64)) as k, unnest(t) as m from t), y as (select id, k // 8 as r, k % 8 as c, m from x),
z as (select *, sum(m) over (partition by id, r) as p, sum(m) over (partition by id, c) as q from y) select id, round(sum(case when m > 0 then m * ln(m / (p * q)) else 0 end) / ln(8), 6) + 0.0 as information from z group by id""")
def h04_mutual_information(spark, d):
    t = pts(spark, d).select("id", cl.as_plan(F.col("v")).alias("t")).withColumn("p", cl.marginal(F.col("t"), 8, True)).withColumn("q", cl.marginal(F.col("t"), 8, False))
    # entropies of the marginals less that of the plan: no explode, no shuffle
    return t.select("id", rnd((cl.entropy(F.col("p")) + cl.entropy(F.col("q")) - cl.entropy(F.col("t"))) / float(np.log(8))).alias("information"))


@query(PLAN + ", x as (select t.id, unnest(range(64)) as k, unnest(t.t) as m from t), y as (select id, k // 8 as r, k % 8 as c, m from x) select a.id, a.r, b.r as c, round(sum(a.m * b.m), 9) as w from y a join y b on a.id = b.id and a.c = b.c group by all")
def h08_mediated_coupling(spark, d):
    """The coupling of every plan."""
    return coupled(pts(spark, d))


def coupled(p):
    x = p.select("id", cl.as_plan(F.col("v")).alias("t"))
    row = lambda i: F.slice("t", i * 8 + 1, 8)
    cells = F.array(*[F.struct(F.lit(i).cast("long").alias("r"), F.lit(j).cast("long").alias("c"), F.round(cl.dot(row(i), row(j)), 9).alias("w")) for i in range(8) for j in range(8)])
    return x.select("id", F.explode(cells).alias("e")).select("id", "e.*")


# --- distances -----------------------------------------------------------------------------------------------


@query(C + " select a.id as i, count(*) as n, round(avg(list_distance(a.v, b.v)), 6) as mean, round(max(list_distance(a.v, b.v)), 6) as far from c a join c b on a.id <> b.id where a.id % 20 = 0 group by all")
def d01_distances(spark, d):
    p = pts(spark, d)

    def part(qi, q, ql, pi, x, pl):
        e = np.where(qi[:, None] == pi[None], 0.0, distances(q, x))
        return pd.DataFrame({"i": qi, "n": (qi[:, None] != pi[None]).sum(1), "s": e.sum(1), "far": e.max(1)})

    return cl.against(p, asked(p), part, "i long, n long, s double, far double").groupBy("i").agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean"), F.round(F.max("far"), 6).alias("far"))


@query(PLAN + " select a.id as i, round(avg(sqrt(list_sum(list_transform(list_zip(a.t, b.t), lambda z: (sqrt(z[1]) - sqrt(z[2])) * (sqrt(z[1]) - sqrt(z[2])))))), 6) as hellinger, round(avg(list_distance(a.t, b.t)), 6) as frobenius from t a join t b on a.id <> b.id where a.id % 20 = 0 group by all")
def d03_plan_distances(spark, d):
    p = pts(spark, d).withColumn("v", cl.as_plan(F.col("v")))

    def part(qi, q, ql, pi, x, pl):
        other = qi[:, None] != pi[None]
        return pd.DataFrame({"i": qi, "n": other.sum(1), "h": (distances(np.sqrt(q), np.sqrt(x)) * other).sum(1), "f": (distances(q, x) * other).sum(1)})

    return cl.against(p, asked(p), part, "i long, n long, h double, f double").groupBy("i").agg(F.round(F.sum("h") / F.sum("n"), 6).alias("hellinger"), F.round(F.sum("f") / F.sum("n"), 6).alias("frobenius"))


@query(PLAN + " select a.id as i, round(avg(sqrt(list_sum(list_transform(list_zip(a.t, b.t), lambda z: (sqrt(z[1]) - sqrt(z[2])) * (sqrt(z[1]) - sqrt(z[2])))) / 2)), 6) as bounded, round(avg(sqrt(greatest(2 - 2 * list_sum(list_transform(list_zip(a.t, b.t), lambda z: sqrt(z[1] * z[2]))), 0))), 6) as gram from t a join t b on a.id <> b.id where a.id % 20 = 0 group by all")
def d04_bounded_hellinger(spark, d):
    """Mean Hellinger distance within [0, 1], and the unscaled one from inner products of the roots, of the plans asked to all."""
    p = pts(spark, d).withColumn("v", cl.as_plan(F.col("v")))

    def part(qi, q, ql, pi, x, pl):
        other = qi[:, None] != pi[None]
        return pd.DataFrame({"i": qi, "n": other.sum(1), "h": (distances(np.sqrt(q), np.sqrt(x)) / np.sqrt(2) * other).sum(1), "g": (np.sqrt(np.clip(2 - 2 * np.sqrt(q) @ np.sqrt(x).T, 0, None)) * other).sum(1)})

    return cl.against(p, asked(p), part, "i long, n long, h double, g double").groupBy("i").agg(F.round(F.sum("h") / F.sum("n"), 6).alias("bounded"), F.round(F.sum("g") / F.sum("n"), 6).alias("gram"))


@query(PLAN + " select round(median(list_distance(a.t, b.t)), 6) as frobenius, round(median(sqrt(list_sum(list_transform(list_zip(a.t, b.t), lambda z: (sqrt(z[1]) - sqrt(z[2])) * (sqrt(z[1]) - sqrt(z[2])))))), 6) as hellinger from t a join t b on a.id < b.id")
def d06_plan_medians(spark, d):
    """Exact medians of both distances over all pairs of plans."""
    p = pts(spark, d).withColumn("v", cl.as_plan(F.col("v"))).withColumn("label", F.lit(0).cast("long"))
    one = lambda x, n: cl.median_distances(x).filter("same").select(F.round("d", 6).alias(n))
    return one(p, "frobenius").join(one(p.withColumn("v", F.transform("v", F.sqrt)), "hellinger"))


@query(C + ", p as (select a.id, list_distance(a.v, b.v) as d from c a join c b on a.id <> b.id), m as (select median(d) as m from p where d > 0) select id, round(avg(d) / (select m from m), 6) as scaled from p where id % 20 = 0 group by id")
def d02_median_scaled(spark, d):
    """Mean distance of the points asked to all others, over the exact median of the positive distances of all pairs."""
    p = pts(spark, d)
    m = F.broadcast(cl.median_distances(p.withColumn("label", F.lit(0).cast("long"))).filter("same").select(F.col("d").alias("m")))

    def part(qi, q, ql, pi, x, pl):
        other = qi[:, None] != pi[None]
        return pd.DataFrame({"id": qi, "n": other.sum(1), "s": (distances(q, x) * other).sum(1)})

    e = cl.against(p, asked(p), part, "id long, n long, s double").groupBy("id").agg((F.sum("s") / F.sum("n")).alias("d"))
    return e.join(m).select("id", F.round(F.col("d") / F.col("m"), 6).alias("scaled"))


@query(C + ", x as (select id, unnest(range(64)) as k, unnest(v) as x from c), s as (select k, avg(x) as m, stddev_pop(x) as sd from x group by k) select id, round(sum((x - m) / case when sd < 1e-10 then 1 else sd end), 5) + 0.0 as total, round(max((x - m) / case when sd < 1e-10 then 1 else sd end), 5) as top from x join s using (k) group by id")
def q11_column_scores(spark, d):
    """Features to zero mean and unit deviation by column: sum and largest score of each row. Column moments come from
    one pass; rows are never exploded against them."""
    p = pts(spark, d)
    width = 64
    m = p.agg(*[f(F.col("v")[k]).alias(f"{n}{k}") for k in range(width) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if m.m0 is None:
        return spark.createDataFrame([], "id long, total double, top double")
    mean, sd = (F.array(*[F.lit(float(m[f"{n}{k}"])) for k in range(width)]) for n in ("m", "s"))
    z = F.transform(F.arrays_zip(F.col("v").alias("v"), mean.alias("m"), sd.alias("s")), lambda e: (e["v"] - e["m"]) / F.when(e["s"] < 1e-10, 1.0).otherwise(e["s"]))
    return p.select("id", z.alias("z")).select("id", rnd(cl.total(F.col("z")), 5).alias("total"), F.round(F.array_max("z"), 5).alias("top"))


@query(KNN.format(where=" and a.id % 20 = 0", k=10) + " select i, j, round(d, 6) as d, rank from k")
def j11_nearest(spark, d):
    p = pts(spark, d)
    return cl.nearest(p, asked(p), 10).select("i", "j", F.round("d", 6).alias("d"), F.col("rank").cast("long").alias("rank"))


@query(C + " select a.id as i, count(*) as n from c a join c b on a.id <> b.id and list_distance(a.v, b.v) <= 1.3 where a.id % 20 = 0 group by all")
def j12_radius_count(spark, d):
    p = pts(spark, d)

    def part(qi, q, ql, pi, x, pl):
        return pd.DataFrame({"i": qi, "n": ((distances(q, x) <= 1.3) & (qi[:, None] != pi[None])).sum(1)})

    return cl.against(p, asked(p), part, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).filter("n > 0")


@query(KNN.format(where=" and a.id % 20 = 0", k=10) + " select i, round(max(d), 6) as bandwidth from k group by i")
def l03_adaptive_bandwidth(spark, d):
    p = pts(spark, d)
    return cl.nearest(p, asked(p), 10).groupBy("i").agg(F.round(F.max("d"), 6).alias("bandwidth"))


@query(KNN.format(where="", k=5) + """, s as (select i, max(d) as s from k group by i), e as (select k.i, k.j, exp(-d * d / (a.s * b.s)) as w from k join s a on k.i = a.i join s b on k.j = b.i),
q as (select i, sum(w) as q from e group by i), n as (select e.i, e.j, w / (a.q * b.q) as w from e join q a on e.i = a.i join q b on e.j = b.i) select i, j, round(w / sum(w) over (partition by i), 6) as p from n""")
def d09_markov_rows(spark, d):
    p = pts(spark, d)
    k = cl.nearest(p, p, 5)
    s = k.groupBy("i").agg(F.max("d").alias("s"))
    other = lambda x, c: x.select(F.col("i").alias("j"), F.col(c).alias(f"{c}_j"))
    e = k.join(s, "i").join(other(s, "s"), "j").withColumn("w", F.exp(-F.col("d") * F.col("d") / (F.col("s") * F.col("s_j"))))
    q = e.groupBy("i").agg(F.sum("w").alias("q"))
    e = e.join(q, "i").join(other(q, "q"), "j").withColumn("w", F.col("w") / (F.col("q") * F.col("q_j")))
    return e.select("i", "j", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("i")), 6).alias("p"))


# --- dimension ----------------------------------------------------------------------------------------------------


@query(C + """, d as (select list_distance(a.v, b.v) as d, a.id <> b.id as off from c a, c b), r as (select min(d) filter (d > 1e-7 and off) as lo, max(d) as hi from d),
g as (select k, lo * lo / 10 * pow(hi * hi * 10 / (lo * lo / 10), k / 39.0) as eps from r, range(40) t(k)), s as (select k, eps, ln(sum(exp(-case when off then d * d else 0 end / eps))) as y from d, g group by all),
z as (select *, coalesce((lead(y) over w - lag(y) over w) / (lead(ln(eps)) over w - lag(ln(eps)) over w), (lead(y) over w - y) / (lead(ln(eps)) over w - ln(eps)), (y - lag(y) over w) / (ln(eps) - lag(ln(eps)) over w)) as slope from s window w as (order by k))
select round(2 * max(slope), 4) as dimension from z""")
def m01_kernel_sum_dimension(spark, d):
    return cl.steepest(cl.kernel_sum(pts(spark, d))).select(F.round("dimension", 4).alias("dimension"))


@query(KNN.format(where=" and a.id % 20 = 0", k=2) + ", r as (select i, min(d) filter (rank = 1) as r1, min(d) filter (rank = 2) as r2 from k group by i) select count(*) as n, round(count(*) / sum(ln(r2 / r1)), 5) as dimension from r where r1 > 1e-10")
def m05_two_nn(spark, d):
    """The two nearest of every point asked (id divisible by 20) among all points."""
    p = pts(spark, d)
    r = cl.nearest(p, asked(p), 2).groupBy("i").agg(F.min("d").alias("r1"), F.max("d").alias("r2")).filter("r1 > 1e-10")
    return r.agg(F.count("*").alias("n"), F.round(F.count("*") / F.sum(F.ln(F.col("r2") / F.col("r1"))), 5).alias("dimension"))


@query(KNN.format(where=" and a.id % 20 = 0", k=20) + ", r as (select i, max(d) as top from k group by i), e as (select k.i, 1 / avg(ln(top / d)) as m from k join r using (i) where rank between 5 and 19 and top > 1e-10 group by k.i) select round(avg(m), 5) as dimension from e")
def m06_levina_bickel(spark, d):
    """The 5th to 20th nearest of every point asked (id divisible by 20) among all points."""
    p = pts(spark, d)
    k = cl.nearest(p, asked(p), 20).withColumn("top", F.max("d").over(Window.partitionBy("i"))).filter("rank between 5 and 19 and top > 1e-10")
    return k.groupBy("i").agg((1 / F.avg(F.ln(F.col("top") / F.col("d")))).alias("m")).agg(F.round(F.avg("m"), 5).alias("dimension"))


@query(C + ", e as (select label, unnest(range(64)) as k, unnest(v) as x from c), s as (select label, k, var_pop(x) as l from e group by all) select label, round(pow(sum(l), 2) / sum(l * l), 5) as participation, round(-sum(l / t * ln(l / t)) / ln(64), 6) as spectral_entropy, count(*) filter (l > 0.01 * top) as above from (select *, sum(l) over (partition by label) as t, max(l) over (partition by label) as top from s) group by label")
def m10_spectrum_statistics(spark, d):
    s = pts(spark, d).select("label", F.posexplode("v").alias("k", "x")).groupBy("label", "k").agg(F.var_pop("x").alias("l"))
    w = Window.partitionBy("label")
    s = s.withColumn("t", F.sum("l").over(w)).withColumn("top", F.max("l").over(w))
    share = F.col("l") / F.col("t")
    return s.groupBy("label").agg(F.round(F.pow(F.sum("l"), 2) / F.sum(F.col("l") * F.col("l")), 5).alias("participation"), F.round(-F.sum(share * F.ln(share)) / float(np.log(64)), 6).alias("spectral_entropy"), F.sum((F.col("l") > 0.01 * F.col("top")).cast("long")).alias("above"))


# --- clustering measures ----------------------------------------------------------------------------------------


@query(C + ", x as (select label, case when v[1] > 0 then 1 else 0 end + case when v[2] > 0 then 2 else 0 end as k from c) select label, k, count(*) as n from x group by all")
def t07_confusion(spark, d):
    k = F.when(F.col("v")[0] > 0, 1).otherwise(0) + F.when(F.col("v")[1] > 0, 2).otherwise(0)
    return pts(spark, d).groupBy("label", k.alias("k")).agg(F.count("*").alias("n"))


@query(C + """, x as (select label, case when v[1] > 0 then 1 else 0 end + case when v[2] > 0 then 2 else 0 end as k from c), n as (select label, k, count(*)::double as n from x group by all),
s as (select (select sum(n * (n - 1) / 2) from n) as i, (select sum(m * (m - 1) / 2) from (select sum(n) as m from n group by label)) as a, (select sum(m * (m - 1) / 2) from (select sum(n) as m from n group by k)) as b, (select sum(n) * (sum(n) - 1) / 2 from n) as t)
select round((i - a * b / t) / ((a + b) / 2 - a * b / t), 6) + 0.0 as ari from s""")
def t04_adjusted_rand(spark, d):
    n = t07_confusion(spark, d)
    c2 = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    # one table: sums by cell, row, column and all of the contingency counts
    g = n.cube("label", "k").agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    s = g.groupBy("g").agg(c2("n").alias("c"))
    one = lambda v: F.max(F.when(F.col("g") == v, F.col("c")))
    r = s.agg(one(0).alias("i"), one(1).alias("a"), one(2).alias("b"), one(3).alias("t"))
    e = F.col("a") * F.col("b") / F.col("t")
    return r.select(rnd((F.col("i") - e) / ((F.col("a") + F.col("b")) / 2 - e)).alias("ari"))


@query(C + """, m as (select a.id, a.label, b.label as other, avg(list_distance(a.v, b.v)) as d from c a join c b on a.id <> b.id group by all),
s as (select id, min(d) filter (label = other) as a, min(d) filter (label <> other) as b from m group by id) select round(avg((b - a) / greatest(a, b)), 6) + 0.0 as silhouette from s""")
def t06_silhouette(spark, d):
    p = pts(spark, d)

    def part(qi, q, ql, pi, x, pl):
        e = distances(q, x) * (qi[:, None] != pi[None])
        names, of = np.unique(pl, return_inverse=True)
        hot = np.eye(len(names))[of]
        n = (qi[:, None] != pi[None]) @ hot
        return pd.DataFrame({"id": np.repeat(qi, len(names)), "label": np.repeat(ql, len(names)), "other": np.tile(names, len(qi)), "s": (e @ hot).ravel(), "n": n.ravel()})

    m = cl.against(p, p, part, "id long, label long, other long, s double, n double").groupBy("id", "label", "other").agg((F.sum("s") / F.sum("n")).alias("d"))
    s = m.groupBy("id").agg(F.min(F.when(F.col("label") == F.col("other"), F.col("d"))).alias("a"), F.min(F.when(F.col("label") != F.col("other"), F.col("d"))).alias("b"))
    return s.agg(rnd(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette"))


@query(C + " select round(median(list_distance(a.v, b.v)) filter (a.label = b.label) / median(list_distance(a.v, b.v)) filter (a.label <> b.label), 6) as ratio from c a join c b on a.id <> b.id")
def t08_within_between(spark, d):
    """The ratio over the pairs of all rows."""
    m = cl.median_distances(pts(spark, d))
    return m.agg(F.round(F.max(F.when(F.col("same"), F.col("d"))) / F.max(F.when(~F.col("same"), F.col("d"))), 6).alias("ratio"))


# --- information and delay vectors ---------------------------------------------------------------------------------


@query(S + """, b as (select *, count(*) over p as n, min(x) over p as lo, max(x) over p as hi from s window p as (partition by key, vintage)),
c as (select *, case when hi > lo then least(7, floor(8 * (x - lo) / (hi - lo)))::int else 0 end as b from b), l as (select a.key, a.vintage, k as lag, a.b as bx, b.b as by_ from c a, range(1, 6) t(k) join c b on a.key = b.key and a.vintage = b.vintage and b.pos = a.pos + k where a.n >= 60),
j as (select key, vintage, lag, bx, by_, count(*)::double as n from l group by all), m as (select *, sum(n) over (partition by key, vintage, lag) as t, sum(n) over (partition by key, vintage, lag, bx) as p, sum(n) over (partition by key, vintage, lag, by_) as q from j)
select key, vintage, lag, round(sum(n / t * ln(n * t / (p * q))), 6) + 0.0 as ami from m group by all""")
def emb01_mutual_information(spark, d):
    w = sr.whole()
    b = ser(spark, d).withColumn("n", F.count("*").over(w)).withColumn("lo", F.min("x").over(w)).withColumn("hi", F.max("x").over(w)).filter("n >= 60")
    b = b.withColumn("b", F.when(F.col("hi") > F.col("lo"), F.least(F.lit(7), F.floor(8 * (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))))).otherwise(F.lit(0)))
    # every lag from one window: no self-join
    for k in range(1, 6):
        b = b.withColumn(f"b{k}", F.lead("b", k).over(sr.over()))
    ahead = F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"b{k}").alias("by")) for k in range(1, 6)])
    j = b.select(*BY, F.col("b").alias("bx"), F.explode(ahead).alias("e")).select(*BY, "bx", "e.*").filter("by is not null").groupBy(*BY, "lag", "bx", "by").agg(F.count("*").alias("n"))
    s = lambda *c: F.sum("n").over(Window.partitionBy(*BY, "lag", *c))
    m = j.withColumn("t", s()).withColumn("p", s("bx")).withColumn("q", s("by"))
    return m.groupBy(*BY, "lag").agg(rnd(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("p") * F.col("q"))))).alias("ami"))


@query(S + " select key, vintage, pos, [x, lead(x, 2) over w, lead(x, 4) over w] as v from s window w as (partition by key, vintage order by pos) qualify pos <= count(*) over (partition by key, vintage) - 6")
def emb09_delay_vectors(spark, d):
    w = sr.over()
    x = ser(spark, d).withColumn("v", F.array("x", F.lead("x", 2).over(w), F.lead("x", 4).over(w))).withColumn("n", F.count("*").over(sr.whole()))
    return x.filter("pos <= n - 6").select(*BY, "pos", "v")


@query(S + ", t as (select key, vintage, pos - 2 as pos, round(x - lag(x, 2) over (partition by key, vintage order by pos), 6) + 0.0 as x from s qualify x is not null and pos > 2) select key, vintage, pos, [x, lead(x, 2) over w, lead(x, 4) over w] as v from t window w as (partition by key, vintage order by pos) qualify pos <= count(*) over (partition by key, vintage) - 6")
def emb10_differenced_delay_vectors(spark, d):
    w = sr.over()
    t = ser(spark, d).withColumn("x", rnd(F.col("x") - F.lag("x", 2).over(w))).filter("pos > 2").withColumn("pos", F.col("pos") - 2)
    x = t.withColumn("v", F.array("x", F.lead("x", 2).over(w), F.lead("x", 4).over(w))).withColumn("n", F.count("*").over(sr.whole()))
    return x.filter("pos <= n - 6").select(*BY, "pos", "v")


@query(S + " select key, vintage, pos, [x, lead(x) over w, lead(x, 2) over w] as v from s window w as (partition by key, vintage order by pos) qualify pos <= count(*) over (partition by key, vintage) - 2")
def emb11_minimal_delay_vectors(spark, d):
    w = sr.over()
    x = ser(spark, d).withColumn("v", F.array("x", F.lead("x", 1).over(w), F.lead("x", 2).over(w))).withColumn("n", F.count("*").over(sr.whole()))
    return x.filter("pos <= n - 2").select(*BY, "pos", "v")


@query(_PAIRS + ", j as (select l.pair, l.date, row_number() over (partition by l.pair order by l.date) as pos, l.x, r.x as y from (select pair, date, max_by(x, pos) as x from a group by all) l join (select pair, date, max_by(x, pos) as x from b group by all) r using (pair, date)) select pair, pos, [x, y, lag(x, 4) over w, lag(y, 4) over w] as v from j window w as (partition by pair order by pos) qualify pos > 4")
def emb12_joint_embedding(spark, d):
    """Every vintage of a key with the preceding one."""
    one = lambda s, n: s.groupBy("pair", "date").agg(F.max_by("x", "pos").alias(n))
    a, b = pairs(spark, d)
    w = Window.partitionBy("pair").orderBy("date")
    j = one(a, "x").join(one(b, "y"), ["pair", "date"]).withColumn("pos", F.row_number().over(w))
    return j.withColumn("v", F.array("x", "y", F.lag("x", 4).over(w), F.lag("y", 4).over(w))).filter("pos > 4").select("pair", "pos", "v")


@query(S + ", w as (select key, vintage, (x <= lead(x) over z)::int * 4 + (x <= lead(x, 2) over z)::int * 2 + (lead(x) over z <= lead(x, 2) over z)::int as k from s window z as (partition by key, vintage order by pos)), n as (select key, vintage, k, count(*)::double as n from w where k is not null group by all) select key, vintage, round(-sum(n / t * ln(n / t)) / ln(6), 6) + 0.0 as pe3 from (select *, sum(n) over (partition by key, vintage) as t from n) group by all")
def q01_permutation_entropy(spark, d):
    w = sr.over()
    b, c = F.lead("x", 1).over(w), F.lead("x", 2).over(w)
    k = (F.col("x") <= b).cast("int") * 4 + (F.col("x") <= c).cast("int") * 2 + (b <= c).cast("int")
    n = ser(spark, d).withColumn("k", k).filter("k is not null").groupBy(*BY, "k").agg(F.count("*").alias("n")).withColumn("t", F.sum("n").over(sr.whole()))
    s = F.col("n") / F.col("t")
    return n.groupBy(*BY).agg(rnd(-F.sum(s * F.ln(s)) / float(np.log(6))).alias("pe3"))


@query(S + ", z as (select *, lag(x) over w as a, lag(x, 4) over w as b, x - lag(x) over w as d1 from s window w as (partition by key, vintage order by pos)) select key, vintage, round(corr(x, a), 5) + 0.0 as acf1, round(corr(x, b), 5) + 0.0 as acf4, round(ln(var_pop(d1)), 5) + 0.0 as ln_var from z group by all having var_pop(d1) > 1e-12 and var_pop(x) > 1e-12")
def q10_temporal_features(spark, d):
    w = sr.over()
    z = ser(spark, d).withColumn("a", F.lag("x", 1).over(w)).withColumn("b", F.lag("x", 4).over(w)).withColumn("d1", F.col("x") - F.col("a"))
    g = z.groupBy(*BY).agg(F.corr("x", "a").alias("acf1"), F.corr("x", "b").alias("acf4"), F.var_pop("d1").alias("vd"), F.var_pop("x").alias("vx"))
    return g.filter("vd > 1e-12 and vx > 1e-12").select(*BY, rnd(F.col("acf1"), 5).alias("acf1"), rnd(F.col("acf4"), 5).alias("acf4"), rnd(F.ln("vd"), 5).alias("ln_var"))


# --- velocity, medoid, sensitivity ---------------------------------------------------------------------------------


@query(PLAN + " select id, round(sqrt(list_sum(list_transform(list_zip(t, lag(t) over w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) as frobenius, round(sqrt(list_sum(list_transform(list_zip(t, lag(t) over w), lambda z: (sqrt(z[1]) - sqrt(z[2])) * (sqrt(z[1]) - sqrt(z[2]))))), 6) as hellinger from t window w as (partition by label order by id) qualify lag(t) over w is not null")
def w06_plan_velocity(spark, d):
    t = pts(spark, d).withColumn("t", cl.as_plan(F.col("v"))).withColumn("u", F.lag("t").over(Window.partitionBy("label").orderBy("id"))).filter("u is not null")
    gap = lambda f: F.sqrt(F.aggregate(F.zip_with("t", "u", lambda a, b: F.pow(f(a) - f(b), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))
    return t.select("id", F.round(gap(lambda x: x), 6).alias("frobenius"), F.round(gap(F.sqrt), 6).alias("hellinger"))


@query(PLAN + ", s as (select a.label, a.id, sum(list_distance(a.t, b.t)) as s from t a join t b on a.label = b.label group by all) select label, min_by(id, (round(s, 9), id)) as medoid from s group by label")
def g14_medoid(spark, d):
    """The medoid of a label among all its rows."""
    p = pts(spark, d).withColumn("v", cl.as_plan(F.col("v")))
    return medoids(p, p)


def medoids(p, candidates):
    def part(qi, q, ql, pi, x, pl):
        e = distances(q, x) * (ql[:, None] == pl[None]) * (qi[:, None] != pi[None])
        return pd.DataFrame({"id": qi, "label": ql, "s": e.sum(1)})

    s = cl.against(p, candidates, part, "id long, label long, s double").groupBy("label", "id").agg(F.round(F.sum("s"), 9).alias("s"))
    return s.groupBy("label").agg(F.min_by("id", F.struct("s", "id")).alias("medoid"))


@query(PLAN + ", x as (select id, unnest(range(64)) as k, unnest(t) as m from t), y as (select id, k // 8 as r, k % 8 as c, m from x) select id, l, round(sum(m * cos(pi() * (l + 1) * (r + 0.5) / 8) * cos(pi() * (l + 1) * (c + 0.5) / 8) * pow(0.5, l) / 1.75), 9) + 0.0 as s from y, range(3) t(l) group by all")
def s01_sensitivity(spark, d):
    t = pts(spark, d).select("id", cl.as_plan(F.col("v")).alias("t"))
    mode = [[np.cos(np.pi * (k + 1) * (r + 0.5) / 8) for r in range(8)] for k in range(3)]
    weight = [F.array(*[F.lit(float(mode[k][i // 8] * mode[k][i % 8] * 0.5**k / 1.75)) for i in range(64)]) for k in range(3)]
    return t.select("id", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("l"), rnd(cl.dot(F.col("t"), weight[k]), 9).alias("s")) for k in range(3)])).alias("e")).select("id", "e.*")


@query(KNN.format(where=" and a.id % 2 = 0 and b.id % 2 = 1", k=1) + ", u as (select a.id as i, min(list_distance(a.v, b.v)) as d from c a join c b on a.id <> b.id and a.id % 2 = 1 and b.id % 2 = 1 group by all) select round(avg((d <= (select quantile_cont(d, 0.95) from u))::int), 6) as inside from k")
def v07_support(spark, d):
    """Fitted on every odd row and scored on every even one."""
    p = pts(spark, d)
    odd = p.filter("id % 2 = 1")
    return inside(odd, odd, p.filter("id % 2 = 0"))


def inside(odd, fit, score):
    own = cl.nearest(odd, fit, 1).agg(F.percentile("d", F.lit(0.95)).alias("t"))
    return cl.nearest(odd, score, 1).join(F.broadcast(own)).agg(F.round(F.avg((F.col("d") <= F.col("t")).cast("int")), 6).alias("inside"))
