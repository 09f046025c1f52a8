"""Queries on dated series: scans, projections, filters, joins, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesloom.operators import line_quarantine as lq
from seriesloom.operators import series as sr
from seriesloom.operators.series import BY
from seriesloom.plans.data_quality import _SPLIT
from seriesloom.runtime import table
from seriesloom.sources import registry as re

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that checks it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def rnd(c, n=6):
    """Rounded and without a negative zero."""
    return F.round(c, n) + F.lit(0.0)


S = """with s as (select key, vintage, date::date as date, value as x, row_number() over (partition by key, vintage order by date, obs_id) as pos
from readings where date is not null and value is not null and isfinite(value))"""
W = "window w as (partition by key, vintage order by pos)"
P = "partition by key, vintage"


def ser(spark, d):
    return sr.series(table(spark, d, "readings"))


# --- scans --------------------------------------------------------------------------------------------


@query(_SPLIT + "select j.file_name, line_id, try_cast(a[1:10] as date) as date, try_cast(b as double) as value from j where reason is null")
def a01_dated_scan(spark, d):
    ok = lq.judged_lines(lq.data_lines(table(spark, d, "series_lines")), keep=("file_name",)).filter("reason is null")
    return ok.select("file_name", "line_id", lq.day_of(F.col("date_text")).alias("date"), F.col("value_text").try_cast("double").alias("value"))


@query(_SPLIT + "select line_id, try_cast(b as double) as value from j where reason is null")
def a02_value_scan(spark, d):
    return lq.loaded_lines(table(spark, d, "series_lines")).select("line_id", "value")


@query(S + " select * from s")
def a04_typed_series(spark, d):
    return ser(spark, d)


@query("select regexp_extract(file_name, '^([a-z]+)_(.*)[.]csv$', 1) as source, regexp_extract(file_name, '^([a-z]+)_(.*)[.]csv$', 2) as series_id, count(distinct pull_no) as n_pulls from series_lines where file_name is not null group by all")
def a05_discover(spark, d):
    part = lambda k: F.regexp_extract("file_name", r"^([a-z]+)_(.*)[.]csv$", k)
    return table(spark, d, "series_lines").filter("file_name is not null").groupBy(part(1).alias("source"), part(2).alias("series_id")).agg(F.count_distinct("pull_no").alias("n_pulls"))


@query("select entry_id, json_extract_string(body, '$.run') as run, try_cast(json_extract_string(body, '$.estimates.seed') as bigint) as seed from artifact_entries")
def a07_result_documents(spark, d):
    return table(spark, d, "artifact_entries").select("entry_id", F.get_json_object("body", "$.run").alias("run"), F.get_json_object("body", "$.estimates.seed").try_cast("bigint").alias("seed"))


@query("select run, round(try_cast(json_extract_string(body, '$.estimates.level') as double), 9) as level, count(*) as n from artifact_entries where artifact = 'scaling' and run = 'sc-0001' group by all")
def a09_findings_scan(spark, d):
    e = table(spark, d, "artifact_entries").filter("artifact = 'scaling' and run = 'sc-0001'")
    return e.groupBy("run", F.round(F.get_json_object("body", "$.estimates.level").try_cast("double"), 9).alias("level")).agg(F.count("*").alias("n"))


@query("select vec_id, len(embedding) as width, label, round(list_sum(list_transform(embedding, lambda v: v::double)), 6) as total from embeddings")
def a08_feature_scan(spark, d):
    """Feature vectors with their width, label and sum."""
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("width"), "label", rnd(total).alias("total"))


@query(re.laws_sql())
def a14_laws(spark, d):
    """The registered laws, their members in order and how each is aggregated within a month."""
    return re.laws(spark)


@query(re.domains_sql())
def a15_domains(spark, d):
    """The registered domains, their members and which enter as log changes."""
    return re.domains(spark)


@query("select vec_id, round(list_max(list_transform(embedding, lambda v: abs(v::double))), 6) as top from embeddings where list_max(list_transform(embedding, lambda v: abs(v::double))) > 1e-3")
def a10_cost_scan(spark, d):
    top = F.array_max(F.transform("embedding", lambda v: F.abs(v.cast("double"))))
    return table(spark, d, "embeddings").filter(F.forall("embedding", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))).withColumn("top", top).filter("top > 1e-3").select("vec_id", rnd(F.col("top")).alias("top"))


_KINDS = ["view", "purchase", "click", "error", "signup"]


@query("select date_trunc('day', ts)::date as day, " + ", ".join(f"round(sum(value) filter (event_type = '{k}'), 10) as {k}" for k in _KINDS) + " from events group by all having count(value) > 0")
def a12_panel(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    p = e.groupBy("day").pivot("event_type", _KINDS).agg(F.sum("value"))
    return p.dropna("all", subset=_KINDS).select("day", *[F.round(k, 10).alias(k) for k in _KINDS])


@query("from (select date_trunc('hour', ts) as hour, " + ", ".join(f"round(avg(value) filter (event_type = '{k}'), 6) as {k}" for k in _KINDS[:3]) + " from events group by all) where view is not null and purchase is not null and click is not null")
def a13_complete_panel(spark, d):
    e = table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    p = e.groupBy("hour").pivot("event_type", _KINDS[:3]).agg(F.avg("value"))
    return p.dropna("any").select("hour", *[F.round(k, 6).alias(k) for k in _KINDS[:3]])


# --- projections ----------------------------------------------------------------------------------------


@query("""select line_id, t, case when regexp_full_match(t, '[0-9]{4}-Q[1-4]') then last_day(make_date(t[1:4]::int, t[7:7]::int * 3, 1))
  when regexp_full_match(t, '[0-9]{4}') then make_date(t[1:4]::int, 12, 31) when regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_cast(t as date) end as date
from (select line_id, regexp_extract(coalesce(raw_line, ''), '^([^,]*)', 1) as t from series_lines) where t[1:4] <> '0000'""")
def b01_parse_dates(spark, d):
    t = table(spark, d, "series_lines").select("line_id", F.regexp_extract(F.coalesce("raw_line", F.lit("")), r"\A([^,]*)", 1).alias("t")).filter("substr(t, 1, 4) <> '0000'")
    return t.withColumn("date", sr.parse_date(F.col("t")))


@query(S + f" select key, vintage, pos, round((x - avg(x) over p) / (stddev_pop(x) over p + 1e-9), 6) as z from s window p as ({P})")
def b02_zscore(spark, d):
    return ser(spark, d).select(*BY, "pos", rnd(sr.zscore()).alias("z"))


@query(S + f""", r as (select *, x - avg(x) over p - coalesce(covar_pop(x, pos) over p / nullif(var_pop(pos) over p, 0), 0) * (pos - avg(pos) over p) as r from s window p as ({P}))
select key, vintage, pos, round((r - avg(r) over p) / (stddev_pop(r) over p + 1e-12), 10) + 0.0 as z from r where (select count(*) from s t where t.key = r.key and t.vintage = r.vintage) > 2 window p as ({P})""")
def b03_cyclical(spark, d):
    s = ser(spark, d).withColumn("n", F.count("*").over(sr.whole())).filter("n > 2").withColumn("r", sr.detrended())
    return s.select(*BY, "pos", rnd(sr.zscore("r", eps=1e-12), 10).alias("z"))


@query(S + f""", m as (select *, median(x) over p as med from s window p as ({P})), n as (select *, median(abs(x - med)) over p as mad from m window p as ({P}))
select key, vintage, pos, round(greatest(-8.0, least(8.0, (x - med) / (1.4826 * mad + 1e-9))), 6) + 0.0 as z from n""")
def b04_robust_z(spark, d):
    return sr.robust_z(ser(spark, d)).select(*BY, "pos", rnd(F.col("z")).alias("z"))


@query(S + f" select key, vintage, pos, round(100 * (ln(x) - ln(lag(x, 12) over w)), 6) + 0.0 as yoy from (select key, vintage, pos, case when x > 0 then x end as x from s) {W}")
def b07_yoy_log_change(spark, d):
    return ser(spark, d).select(*BY, "pos", rnd(sr.log_change(12)).alias("yoy"))


@query(S + f" select key, vintage, pos, round(coalesce(x - lag(x) over w, 0.0), 6) + 0.0 as dx, round(ln(x) - ln(lag(x) over w), 9) + 0.0 as log_return from (select key, vintage, pos, case when x > 0 then x end as x from s) {W}")
def b08_difference(spark, d):
    s = ser(spark, d).withColumn("x", F.when(F.col("x") > 0, F.col("x")))
    return s.select(*BY, "pos", rnd(F.coalesce(sr.difference(), F.lit(0.0))).alias("dx"), rnd(sr.log_change(1, scale=1.0), 9).alias("log_return"))


@query("select distinct case when i <> 'other' then i else source || '-other' end as concept from (select source, lower(trim(indicator)) as i from series_labels where indicator is not null) where concept is not null")
def b14_concept(spark, d):
    i = F.lower(F.trim("indicator"))
    return table(spark, d, "series_labels").filter("indicator is not null").select(F.when(i != "other", i).otherwise(F.concat("source", F.lit("-other"))).alias("concept")).filter("concept is not null").distinct()


@query("select distinct array_to_string(string_split(regexp_replace(key, '^[a-z]+_', ''), '0')[1:2], '_') as substream from series_labels where key is not null")
def b15_substream(spark, d):
    return table(spark, d, "series_labels").filter("key is not null").select(F.array_join(F.slice(F.split(F.regexp_replace("key", "^[a-z]+_", ""), "0"), 1, 2), "_").alias("substream")).distinct()


_PATTERNS = [("prices", "^(fred_CPI|wb_FP)"), ("accounts", "_(GX|NYX)"), ("rates", "_(MRX|BLQ)"), ("trade", "_(TCX|QNX)")]


@query("select distinct key, case " + " ".join(f"when regexp_matches(key, '{p}') then '{n}'" for n, p in _PATTERNS) + " end as domain from series_labels")
def b16_classify(spark, d):
    return table(spark, d, "series_labels").select("key").distinct().withColumn("domain", sr.first_matching(F.col("key"), _PATTERNS))


@query("select key, vintage, case when unit in ('index', 'level', 'fx') then 'logret' end as pre from series_vintages")
def b17_preembed_rule(spark, d):
    return table(spark, d, "series_vintages").select(*BY, F.when(F.col("unit").isin("index", "level", "fx"), "logret").alias("pre"))


@query("""with h as (select date_trunc('hour', ts) as hour, event_type, avg(value) as v from events group by all)
select a.hour, round(a.v * (b.v / 100) / c.v, 6) as velocity from h a join h b using (hour) join h c using (hour) where a.event_type = 'view' and b.event_type = 'click' and c.event_type = 'purchase' and c.v > 0""")
def b18_derived_series(spark, d):
    h = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.avg("value").alias("v"))
    one = lambda k: h.filter(F.col("event_type") == k).select("hour", F.col("v").alias(k))
    return one("view").join(one("click"), "hour").join(one("purchase"), "hour").filter("purchase > 0").select("hour", rnd(F.col("view") * (F.col("click") / 100) / F.col("purchase")).alias("velocity"))


@query(S + f" select key, vintage, pos, round(x - lag(x, 3) over w, 6) + 0.0 as v from s {W}")
def b19_tau_difference(spark, d):
    return ser(spark, d).select(*BY, "pos", rnd(sr.difference(3)).alias("v"))


@query(S + " select distinct date, round(year(date) + (month(date) - 1) / 12.0, 6) as years from s")
def b20_fractional_year(spark, d):
    return ser(spark, d).select("date", rnd(sr.fractional_year()).alias("years")).distinct()


@query(S + f""", c as (select *, count(*) over ({P}) as n from s)
select key, vintage, pos from c where n <= 50 or exists (select 1 from range(50) r(k) where (k * (n - 1)) // 49 = pos - 1)""")
def b21_strided_subsample(spark, d):
    return sr.strided(ser(spark, d), 50).select(*BY, "pos")


@query(S + " select key, vintage, pos, round(sign(x) * ln(1 + abs(x)), 6) + 0.0 as v from s")
def b22_signed_log(spark, d):
    return ser(spark, d).select(*BY, "pos", rnd(sr.signed_log(F.col("x"))).alias("v"))


@query(S + f" select key, vintage, pos, [x, coalesce(lag(x) over w, first_value(x) over w), coalesce(lag(x, 2) over w, first_value(x) over w)] as lags from s {W}")
def b23_lag_matrix(spark, d):
    return ser(spark, d).select(*BY, "pos", sr.lag_vector(3).alias("lags"))


# --- filters ------------------------------------------------------------------------------------------------

_L = "with l as (select *, lower(trim(indicator)) as i, case when lower(trim(indicator)) <> 'other' then lower(trim(indicator)) else source || '-other' end as concept from series_labels)"


def labels(spark, d):
    i = F.lower(F.trim("indicator"))
    return table(spark, d, "series_labels").withColumn("i", i).withColumn("concept", F.when(i != "other", i).otherwise(F.concat("source", F.lit("-other"))))


@query(_L + " select idx from l where source not in ('bis', 'boe', 'yahoo')")
def c01_source_rule(spark, d):
    return labels(spark, d).filter(~F.col("source").isin("bis", "boe", "yahoo")).select("idx")


@query(_L + " select idx from l where n_points >= 200 and cost_max > 1e-3 and isfinite(cost_max)")
def c02_quality_rule(spark, d):
    return labels(spark, d).filter("n_points >= 200 and cost_max > 1e-3 and not isnan(cost_max)").select("idx")


@query(_L + " select idx, timescale in ('annual', 'quarterly', 'monthly') as corpus, source in ('bis', 'boe') as control from l where timescale in ('annual', 'quarterly', 'monthly') or source in ('bis', 'boe')")
def c03_frequency_and_controls(spark, d):
    x = labels(spark, d).select("idx", F.col("timescale").isin("annual", "quarterly", "monthly").alias("corpus"), F.col("source").isin("bis", "boe").alias("control"))
    return x.filter("corpus or control")


_QUALITY = "n_points >= 200 and cost_max > 1e-3 and isfinite(cost_max)"


@query(_L + f" select idx, source, timescale from l where source in ('bis', 'boe') and timescale in ('annual', 'quarterly', 'monthly') and {_QUALITY}")
def c04_control_set(spark, d):
    """Control sources that pass the quality and the frequency rule."""
    x = labels(spark, d).filter(F.col("source").isin("bis", "boe") & F.col("timescale").isin("annual", "quarterly", "monthly"))
    return x.filter("n_points >= 200 and cost_max > 1e-3 and not isnan(cost_max)").select("idx", "source", "timescale")


@query(_L + f" select idx, key, timescale from l where source not in ('bis', 'boe', 'yahoo') and timescale in ('annual', 'quarterly', 'monthly') and {_QUALITY}")
def c05_all_frequencies(spark, d):
    """The three rules together, every variant of a series kept."""
    x = labels(spark, d).filter(~F.col("source").isin("bis", "boe", "yahoo") & F.col("timescale").isin("annual", "quarterly", "monthly"))
    return x.filter("n_points >= 200 and cost_max > 1e-3 and not isnan(cost_max)").select("idx", "key", "timescale")


@query(_L + " select idx, concept from l where source = 'wb' or (source = 'worldbank' and i in ('gdp', 'inflation') and n_points >= 60)")
def c06_held_out(spark, d):
    return labels(spark, d).filter("source = 'wb' or (source = 'worldbank' and i in ('gdp', 'inflation') and n_points >= 60)").select("idx", "concept")


@query("select idx, cost_max is not null and isfinite(cost_max) and cost_max > 1e-3 as ok from series_labels")
def c07_finite_gate(spark, d):
    ok = F.coalesce(~F.isnan("cost_max") & (F.abs("cost_max") < float("inf")) & (F.col("cost_max") > 1e-3), F.lit(False))
    return table(spark, d, "series_labels").select("idx", ok.alias("ok"))


@query("""with c as (select key, vintage, min(date)::date as lo, max(date)::date as hi from readings where date is not null and value is not null group by all),
k as (select c.*, v.unit from c join series_vintages v using (key, vintage) where lo <= date '2000-01-01' and hi >= date '2010-01-01'), n as (select unit, count(*) as n from k group by unit having count(*) >= 3)
select key, vintage, unit, n from k join n using (unit)""")
def c09_window_coverage(spark, d):
    c = table(spark, d, "readings").filter("date is not null and value is not null").groupBy(*BY).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    k = c.filter("lo <= date'2000-01-01' and hi >= date'2010-01-01'").join(table(spark, d, "series_vintages").select(*BY, "unit"), BY)
    n = k.groupBy("unit").agg(F.count("*").alias("n")).filter("n >= 3")
    return k.join(n, "unit").select(*BY, "unit", "n")


@query("""with k as (select distinct key, case """ + " ".join(f"when regexp_matches(key, '{p}') then '{n}'" for n, p in _PATTERNS) + """ end as domain from readings where key is not null),
c as (select key, count(distinct last_day(date)) as months from readings where date is not null and value is not null group by key), j as (select domain, key, months from k join c using (key) where domain is not null and months >= 24)
select * from j qualify row_number() over (partition by domain order by key) <= 20 and count(*) over (partition by domain) >= 2""")
def c10_multi_source_corpus(spark, d):
    c = table(spark, d, "readings").filter("date is not null and value is not null and key is not null").groupBy("key").agg(F.count_distinct(F.last_day("date")).alias("months"))
    j = c.filter("months >= 24").withColumn("domain", sr.first_matching(F.col("key"), _PATTERNS)).filter("domain is not null")
    j = j.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy("key"))).withColumn("n", F.count("*").over(Window.partitionBy("domain")))
    return j.filter("r <= 20 and n >= 2").select("domain", "key", "months")


@query("select key, vintage, pos from (" + S + " select * from s) where x > 0")
def c11_finite_mask(spark, d):
    return ser(spark, d).filter("x > 0").select(*BY, "pos")


_RECESSIONS = [("1990-07-01", "1991-03-01"), ("2001-03-01", "2001-11-01"), ("2007-12-01", "2009-06-01"), ("2020-02-01", "2020-04-01")]


@query(S + " select key, vintage, pos, " + " or ".join(f"(date >= date '{a}' and date < date '{b}')" for a, b in _RECESSIONS) + " as flag from s")
def c13_interval_flag(spark, d):
    flag = F.lit(False)
    for a, b in _RECESSIONS:
        flag = flag | ((F.col("date") >= F.lit(a).cast("date")) & (F.col("date") < F.lit(b).cast("date")))
    return ser(spark, d).select(*BY, "pos", flag.alias("flag"))


@query("select key, vintage, count(*) as n, count(*) filter (date is null) as no_date, count(*) filter (value is null) as no_value, count(*) filter (value is not null and not isfinite(value)) as not_finite from readings group by all")
def c14_validators(spark, d):
    k = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return table(spark, d, "readings").groupBy(*BY).agg(F.count("*").alias("n"), k(F.col("date").isNull()).alias("no_date"), k(F.col("value").isNull()).alias("no_value"), k(F.isnan("value") | (F.abs("value") == float("inf"))).alias("not_finite"))


# --- joins -------------------------------------------------------------------------------------------------------

_PAIRS = S + """, v as (select key, vintage, lag(vintage) over w as before, lead(vintage) over w as after from (select distinct key, vintage from s) window w as (partition by key order by vintage)),
a as (select key || '#' || vintage as pair, pos, date, x from s join v using (key, vintage) where after is not null or before is null), b as (select key || '#' || before as pair, pos, date, x from s join v using (key, vintage) where before is not null)"""


def vintages(s):
    """Each vintage of a key with the ones before and after it; a sole vintage has neither."""
    w = Window.partitionBy("key").orderBy("vintage")
    return s.select(*BY).distinct().filter("key is not null and vintage is not null").withColumn("before", F.lag("vintage").over(w)).withColumn("after", F.lead("vintage").over(w))


def pairs(spark, d):
    """Every vintage of a key beside the preceding one: pair is the key and the earlier vintage. A sole vintage is a left side alone."""
    s = ser(spark, d)
    x = s.join(vintages(s), BY)
    one = lambda where, v: x.filter(where).select(F.concat("key", F.lit("#"), v).alias("pair"), "pos", "date", "x")
    return one("after is not null or before is null", "vintage"), one("before is not null", "before")


@query(_PAIRS + " select pair, date_trunc('month', b.date)::date as period, b.date, b.x as right_x, l.x as left_x from b join (select pair, date_trunc('month', date)::date as m, max_by(x, pos) as x from a group by all) l using (pair) where l.m = date_trunc('month', b.date)::date")
def j01_align_monthly(spark, d):
    return sr.align(*pairs(spark, d), "month")


@query(_PAIRS + " select pair, date_trunc('quarter', b.date)::date as period, b.date, b.x as right_x, l.x as left_x from b join (select pair, date_trunc('quarter', date)::date as m, max_by(x, pos) as x from a group by all) l using (pair) where l.m = date_trunc('quarter', b.date)::date")
def j02_align_quarterly(spark, d):
    return sr.align(*pairs(spark, d), "quarter")


@query(_PAIRS + """, u as (select pair, date_trunc('quarter', date)::date as q, avg(x) as x from a group by all), g as (select pair, date_trunc('quarter', date)::date as q, max_by(x, pos) as x from b group by all)
select pair, q as quarter, round(u.x - lag(u.x) over w, 10) + 0.0 as du, round(100 * (ln(g.x) - ln(lag(g.x, 4) over w)), 10) + 0.0 as growth from u join (select pair, q, case when x > 0 then x end as x from g) g using (pair, q) window w as (partition by pair order by q)""")
def j03_aggregate_then_join(spark, d):
    return aggregated(*pairs(spark, d))


def aggregated(a, b):
    u = a.groupBy("pair", F.trunc("date", "quarter").alias("quarter")).agg(F.avg("x").alias("u"))
    g = b.groupBy("pair", F.trunc("date", "quarter").alias("quarter")).agg(F.max_by("x", "pos").alias("g")).withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    w = Window.partitionBy("pair").orderBy("quarter")
    return u.join(g, ["pair", "quarter"]).select("pair", "quarter", rnd(F.col("u") - F.lag("u").over(w), 10).alias("du"), rnd(100 * (F.ln("g") - F.ln(F.lag("g", 4).over(w))), 10).alias("growth"))


@query(_PAIRS + """, l as (select pair, date_trunc('month', date)::date as m, max_by(x, pos) as x from a group by all), r as (select pair, date_trunc('month', date)::date as m, max_by(x, pos) as x from b group by all)
select coalesce(l.pair, r.pair) as pair, coalesce(l.m, r.m) as month, l.x as left_x, r.x as right_x from l full join r on l.pair = r.pair and l.m = r.m""")
def j04_full_outer_months(spark, d):
    return full_months(*pairs(spark, d))


def full_months(a, b):
    m = lambda s, n: s.groupBy("pair", F.trunc("date", "month").alias("month")).agg(F.max_by("x", "pos").alias(n))
    return m(a, "left_x").join(m(b, "right_x"), ["pair", "month"], "full")


@query("select l.idx, e.label from series_labels l join embeddings e on l.idx = e.vec_id")
def j06_positional(spark, d):
    return table(spark, d, "series_labels").select("idx").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), "label"), "idx")


@query("select key, vintage from series_vintages v where exists (select 1 from readings r where r.key = v.key and r.vintage = v.vintage and r.value < 0)")
def j07_semi(spark, d):
    return table(spark, d, "series_vintages").select(*BY).join(table(spark, d, "readings").filter("value < 0").select(*BY), BY, "left_semi")


@query("select distinct key from series_labels l where key is not null and not exists (select 1 from readings r where r.key = l.key)")
def j08_anti(spark, d):
    return table(spark, d, "series_labels").select("key").filter("key is not null").distinct().join(table(spark, d, "readings").select("key"), "key", "left_anti")


@query("""select key, vintage, g, min_by(date, (abs(date - gd), date)) as nearest from (select r.key, r.vintage, r.date::date as date, g, (date '1980-01-01' + (g * 3650)::int)::date as gd from readings r, range(5) t(g) where r.date is not null and r.value is not null) group by all""")
def j13_nearest_date(spark, d):
    x = table(spark, d, "readings").filter("date is not null and value is not null").select(*BY, F.col("date").cast("date").alias("date"))
    # five grid dates: the minimum is kept for each, without pairing rows with a grid table
    at = [F.date_add(F.lit("1980-01-01").cast("date"), g * 3650) for g in range(5)]
    agg = x.groupBy(*BY).agg(*[F.min_by("date", F.struct(F.abs(F.date_diff("date", g)), "date")).alias(f"g{k}") for k, g in enumerate(at)])
    return agg.select(*BY, F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("g"), F.col(f"g{k}").alias("nearest")) for k in range(5)])).alias("e")).select(*BY, "e.*")


@query(S + f""", f as (select key, vintage, date_trunc('month', min(date)) as start, max(date) as stop from s group by all), g as (select key, vintage, unnest(generate_series(start, stop::timestamp, interval 6 month))::date as grid from f)
select key, vintage, grid, count(*) as n, round(avg(x), 10) as mean, round(stddev_pop(x), 10) as sd from g join s using (key, vintage) where date >= (grid - interval 24 month) and date <= grid group by all having count(*) >= 12""")
def j14_trailing_windows(spark, d):
    t = sr.trailing_windows(ser(spark, d), 6, 24, 12)
    return t.select(*BY, "grid", "n", F.round("mean", 10).alias("mean"), F.round("sd", 10).alias("sd"))


@query(S + f", q as (select key, vintage, date_trunc('quarter', date)::date as quarter, avg(x) as x from s group by all) select key, vintage, quarter, round(x - lag(x) over (partition by key, vintage order by quarter), 10) + 0.0 as dx from q")
def j15_previous_quarter(spark, d):
    q = sr.quarterly_mean(ser(spark, d))
    return q.select(*BY, "quarter", rnd(F.col("x") - F.lag("x").over(sr.over("quarter")), 10).alias("dx"))


# --- aggregates -----------------------------------------------------------------------------------------------------


@query(S + f""", g as (select key, vintage, median(gap) as gap, count(*) as n from (select key, vintage, date - lag(date) over w as gap from s {W}) group by all),
m as (select key, vintage, last_day(date) as month, avg(x) as mean, max_by(x, pos) as last, max(date) as date from s group by all),
p as (select key, vintage, case when n < 2 then date else month end as month, case when n >= 2 and gap < 27 then mean else last end as x from m join g using (key, vintage) where n < 2 or gap <= 34),
q as (select key, vintage, month, last, lead(month) over z as nm, lead(last) over z as nx from m join g using (key, vintage) where n >= 2 and gap > 34 window z as (partition by key, vintage order by month)),
r as (select *, unnest(range(case when nm is null then 1 else datediff('month', month, nm) end)) as k from q)
select key, vintage, month, round(x, 10) + 0.0 as x from p union all
select key, vintage, last_day((date_trunc('month', month) + to_months(k::int))::date), round(case when k = 0 then last else last + (nx - last) * (last_day((date_trunc('month', month) + to_months(k::int))::date) - month) / (nm - month) end, 10) + 0.0 from r""")
def e01_monthly(spark, d):
    return sr.monthly(ser(spark, d)).select(*BY, "month", rnd(F.col("x"), 10).alias("x"))


@query(S + " select key, vintage, date_trunc('quarter', date)::date as quarter, round(avg(x), 10) as x from s group by all")
def e02_quarterly_mean(spark, d):
    return sr.quarterly_mean(ser(spark, d)).select(*BY, "quarter", F.round("x", 10).alias("x"))


@query("select key, idx, n_points from (select *, row_number() over (partition by key order by coalesce(n_points, -1) desc, idx) as r from series_labels where key is not null) where r = 1")
def e03_best_variant(spark, d):
    return sr.best_variant(table(spark, d, "series_labels").filter("key is not null")).select("key", "idx", "n_points")


@query(_L + " select source, concept, timescale, count(*) as n, grouping(source, concept, timescale) as level from l group by grouping sets ((source), (concept), (timescale))")
def e04_composition(spark, d):
    from pyspark.sql import functions as F

    x = labels(spark, d).select("source", "concept", "timescale")
    return x.groupingSets([["source"], ["concept"], ["timescale"]], "source", "concept", "timescale").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


_HASH = "(idx * 48271 + 12345) % 2147483647"


@query(_L + f", n as (select count(*) as n from l where concept is not null) select idx, concept from l where concept is not null qualify row_number() over (partition by concept order by {_HASH}, idx) <= (select (n * 0.05)::bigint from n)")
def e06_concept_cap(spark, d):
    x = labels(spark, d).filter("concept is not null").select("idx", "concept")
    return sr.capped(x, "concept", F.lit(int(round(x.count() * 0.05))))


@query(_L + f", r as (select idx, concept from l where concept is not null qualify row_number() over (partition by concept order by {_HASH}, idx) <= 12) select idx, concept from r order by concept, {_HASH}, idx limit 150")
def e07_balanced_landmarks(spark, d):
    x = sr.capped(labels(spark, d).filter("concept is not null").select("idx", "concept"), "concept", F.lit(12))
    return x.orderBy("concept", sr.hash_order(F.col("idx"), 0), "idx").limit(150)


@query(_L + f""", r as (select idx, source, i, {_HASH} as h, row_number() over (partition by source, i order by {_HASH}, idx) as a from l where i is not null and source is not null),
z as (select (count(*) * 0.4)::bigint as target, count(distinct (source, i)) as pairs, count(distinct i) as n from r), k as (select greatest(target - pairs, 0) as rest, greatest(50, greatest(target - pairs, 0) // n) as cap from z),
pool as (select idx, h, row_number() over (partition by i order by h, idx) as b from r where a > 1), fill as (select idx from pool, k where b <= cap qualify row_number() over (order by h, idx) <= rest)
select idx, source, i, a = 1 as first from r where a = 1 or idx in (from fill)""")
def e09_pair_balanced_sample(spark, d):
    """One label of each source and indicator; then more up to 40 % of all, where no indicator gives more than its equal
    share of what is missing (50 at least). The cut among the candidates is found by their hash, not by sorting them in
    one place: only the wanted hash is looked for."""
    h = sr.hash_order(F.col("idx"), 0)
    x = labels(spark, d).filter("i is not null and source is not null").select("idx", "source", "i", h.alias("h"))
    x = x.withColumn("a", F.row_number().over(Window.partitionBy("source", "i").orderBy("h", "idx")))
    z = x.agg(F.floor(F.count("*") * 0.4 + 0.5).alias("target"), F.count_distinct("source", "i").alias("pairs"), F.count_distinct("i").alias("n")).first()
    rest = max(int(z.target) - z.pairs, 0)
    pool = x.filter("a > 1").withColumn("b", F.row_number().over(Window.partitionBy("i").orderBy("h", "idx"))).filter(F.col("b") <= max(50, rest // max(z.n, 1)))
    fill = pool.orderBy("h", "idx").limit(rest)  # as many rows as the sample wants
    chosen = x.filter("a = 1").unionByName(fill.drop("b"))
    return chosen.select("idx", "source", "i", (F.col("a") == 1).alias("first"))


@query(_L + f""", c as (select idx, concept, {_HASH} as h, count(*) over () as n from l where concept is not null), k as (select count(distinct concept) as k from c)
select idx, concept, 'natural' as scheme from c where h < 0.1 * 2147483647 union all select idx, concept, 'capped' from c qualify row_number() over (partition by concept order by h, idx) <= 350
union all select idx, concept, 'equal' from c, k qualify row_number() over (partition by concept order by h, idx) <= (n * 0.1)::bigint // k""")
def e10_stratified_schemes(spark, d):
    """A tenth as it comes (by hash), at most 350 of a concept, and an equal share of a tenth for each concept."""
    h = sr.hash_order(F.col("idx"), 0)
    x = labels(spark, d).filter("concept is not null").select("idx", "concept")
    z = x.agg(F.floor(F.count("*") * 0.1 + 0.5).alias("n"), F.count_distinct("concept").alias("k")).first()
    each = int(z.n) // max(z.k, 1)
    return x.filter(h < 0.1 * 2147483647).withColumn("scheme", F.lit("natural")).unionByName(sr.capped(x, "concept", F.lit(350)).withColumn("scheme", F.lit("capped"))).unionByName(sr.capped(x, "concept", F.lit(each)).withColumn("scheme", F.lit("equal")))


@query(S + """, m as (select key, vintage, avg(x) as mean, stddev_pop(x) as sd, count(*) as n from s group by all having stddev_pop(x) > 1e-9)
select key, vintage, round(m.mean, 10) as mean, round(m.sd, 10) as sd, round(avg(((x - m.mean) / m.sd) ** 3), 10) + 0.0 as skew, round(avg(((x - m.mean) / m.sd) ** 4) - 3, 10) + 0.0 as kurt from m join s using (key, vintage) group by key, vintage, m.mean, m.sd""")
def e12_moments(spark, d):
    m = ser(spark, d).groupBy(*BY).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.skewness("x").alias("skew"), F.kurtosis("x").alias("kurt")).filter("sd > 1e-9")
    return m.select(*BY, F.round("mean", 10).alias("mean"), F.round("sd", 10).alias("sd"), rnd(F.col("skew"), 10).alias("skew"), rnd(F.col("kurt"), 10).alias("kurt"))


@query(S + " select key, vintage, round(quantile_cont(x, 0.05), 10) as p05, round(median(x), 10) as p50, round(quantile_cont(x, 0.95), 10) as p95, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 10) as iqr from s group by all")
def e13_percentiles(spark, d):
    q = lambda p: F.percentile("x", F.lit(p))
    return ser(spark, d).groupBy(*BY).agg(F.round(q(0.05), 10).alias("p05"), F.round(q(0.5), 10).alias("p50"), F.round(q(0.95), 10).alias("p95"), F.round(q(0.75) - q(0.25), 10).alias("iqr"))


@query(S + """, t as (select key, vintage, atan2(dx, x) as th from (select key, vintage, x, x - lag(x) over w as dx from s window w as (partition by key, vintage order by pos)) where dx is not null),
e as (select key, vintage, min(th) as lo, max(th) as hi from t group by all having max(th) > min(th))
select key, vintage, count(distinct least(23, floor((th - lo) / (hi - lo) * 24)))::double / 24 as coverage from t join e using (key, vintage) group by all""")
def e14_histogram_coverage(spark, d):
    t = ser(spark, d).withColumn("dx", sr.difference()).filter("dx is not null").select(*BY, F.atan2("dx", "x").alias("th"))
    w = sr.whole()
    t = t.withColumn("lo", F.min("th").over(w)).withColumn("hi", F.max("th").over(w)).filter("hi > lo")
    b = F.least(F.lit(23), F.floor((F.col("th") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 24))
    return t.groupBy(*BY).agg((F.count_distinct(b) / 24).alias("coverage"))


_EDGES = """with e as (select cn.n_name as src, sn.n_name as tgt, sum(l_extendedprice * (1 - l_discount)) / 1e6 as w from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join supplier on l_suppkey = s_suppkey join nation cn on c_nationkey = cn.n_nationkey join nation sn on s_nationkey = sn.n_nationkey group by all)"""


def edges(spark, d):
    """Directed graph of revenue between nations (customer's to supplier's)."""
    t = lambda n: table(spark, d, n)
    nation = lambda k, name: t("nation").select(F.col("n_nationkey").alias(k), F.col("n_name").alias(name))
    x = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    x = x.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("c_nationkey", "s_nationkey").agg((F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1e6).alias("w"))
    return x.join(nation("c_nationkey", "src"), "c_nationkey").join(nation("s_nationkey", "tgt"), "s_nationkey").select("src", "tgt", "w")


@query(_EDGES + ", o as (select src as node, sum(w) as out_w from e group by all), i as (select tgt as node, sum(w) as in_w from e group by all) select node, round(coalesce(out_w, 0), 10) as out_w, round(coalesce(in_w, 0), 10) as in_w, round(coalesce(out_w, 0) - coalesce(in_w, 0), 10) + 0.0 as net, round(coalesce(out_w, 0) + coalesce(in_w, 0), 10) as total from o full join i using (node)")
def e15_node_degrees(spark, d):
    # one pass: each edge counts for both its ends
    e = edges(spark, d).select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("w").alias("o"), F.lit(0.0).alias("i")), F.struct(F.col("tgt").alias("node"), F.lit(0.0).alias("o"), F.col("w").alias("i")))).alias("e")).select("e.*")
    g = e.groupBy("node").agg(F.sum("o").alias("out_w"), F.sum("i").alias("in_w"))
    return g.select("node", F.round("out_w", 10).alias("out_w"), F.round("in_w", 10).alias("in_w"), rnd(F.col("out_w") - F.col("in_w"), 10).alias("net"), F.round(F.col("out_w") + F.col("in_w"), 10).alias("total"))


@query("select label, i, round(avg(v), 6) + 0.0 as v from (select label, unnest(range(64)) as i, unnest(embedding)::double as v from embeddings) group by all")
def e16_mean_pool(spark, d):
    return table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", F.col("i").cast("long").alias("i")).agg(rnd(F.avg(F.col("v").cast("double"))).alias("v"))


@query("select concept, count(d) as n, round(avg(d) filter (isfinite(d)), 9) as mean, round(stddev_pop(d) filter (isfinite(d)), 9) as sd from per_concept_matched_n group by all")
def e17_finite_mean_sd(spark, d):
    x = F.when(~F.isnan("d"), F.col("d"))
    return table(spark, d, "per_concept_matched_n").groupBy("concept").agg(F.count("d").alias("n"), F.round(F.avg(x), 9).alias("mean"), F.round(F.stddev_pop(x), 9).alias("sd"))


@query("select corpus_id, count(distinct key) as n_keys, count(distinct source) as n_sources from series_labels group by all")
def e18_distinct_counts(spark, d):
    return table(spark, d, "series_labels").groupBy("corpus_id").agg(F.count_distinct("key").alias("n_keys"), F.count_distinct("source").alias("n_sources"))


# --- windows -----------------------------------------------------------------------------------------------------------


@query(S + f" select key, vintage, pos, lag(x, 4) over w as lag4 from s {W}")
def w01_lag(spark, d):
    return ser(spark, d).select(*BY, "pos", F.lag("x", 4).over(sr.over()).alias("lag4"))


@query(S + f" select key, vintage, pos, round(avg(x) over (partition by key, vintage order by pos rows between unbounded preceding and 1 preceding), 10) + 0.0 as m from s")
def w02_recursive_mean(spark, d):
    return ser(spark, d).select(*BY, "pos", rnd(F.avg("x").over(sr.over().rowsBetween(Window.unboundedPreceding, -1)), 10).alias("m"))


@query(S + " select key, vintage, pos, round(avg(x) over (partition by key, vintage order by pos rows between 14 preceding and 3 preceding), 10) + 0.0 as m from s")
def w03_rolling_origin_mean(spark, d):
    return ser(spark, d).select(*BY, "pos", rnd(F.avg("x").over(sr.over().rowsBetween(-14, -3)), 10).alias("m"))


@query(S + """, n as (select *, count(*) over (partition by key, vintage) as n from s), t as (select distinct key, vintage, unnest(range(0, n - 60, 12)) as start from n where n > 60)
select key, vintage, start, start + 30 as centre, count(*) as rows, round(avg(x), 10) + 0.0 as mean from t join s using (key, vintage) where pos - 1 >= start and pos - 1 < start + 60 group by all""")
def w04_count_windows(spark, d):
    r = sr.rolling_starts(ser(spark, d), 60, 12)
    return r.groupBy(*BY, F.col("start").cast("long").alias("start"), F.col("centre").cast("long").alias("centre")).agg(F.count("*").alias("rows"), rnd(F.avg("x"), 10).alias("mean"))


@query(_EDGES + " select src, tgt, rank() over (partition by src order by round(w, 4) desc) as r from e")
def w07_rank(spark, d):
    e = edges(spark, d).withColumn("w", F.round("w", 4))
    return e.select("src", "tgt", F.rank().over(Window.partitionBy("src").orderBy(F.desc("w"))).alias("r"))


@query("with v as (select label, unnest(range(64)) as k, unnest(embedding)::double as v from embeddings), e as (select label, k, sum(v * v) as v from v group by all) select label, k, round(sum(v) over (partition by label order by k) / sum(v) over (partition by label), 6) as share from e")
def w08_cumulative_share(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("k", "v")).groupBy("label", F.col("k").cast("long").alias("k")).agg(F.sum(F.col("v").cast("double") * F.col("v")).alias("v"))
    w = Window.partitionBy("label").orderBy("k")
    return e.select("label", "k", F.round(F.sum("v").over(w) / F.sum("v").over(Window.partitionBy("label")), 6).alias("share"))


@query(S + f" select key, vintage, pos, round(coalesce((lead(x) over w - lag(x) over w) / 2, lead(x) over w - x, x - lag(x) over w), 10) + 0.0 as g from s {W}")
def w09_gradient(spark, d):
    return ser(spark, d).select(*BY, "pos", rnd(sr.gradient(), 10).alias("g"))


@query(S + f""", r as (select key, vintage, quantile_cont(x, 0.05) as lo, quantile_cont(x, 0.95) as hi from s group by all),
g as (select key, vintage, pos, stddev_pop(x) over v as sd, avg(x) over v as level, count(*) over v as n, least(x, last_value(x) over v) as a, greatest(x, last_value(x) over v) as b from s window v as (partition by key, vintage order by pos rows between current row and 7 following))
select key, vintage, round(min(sd), 8) + 0.0 as flattest, round(min_by(level, (round(sd, 8), pos)), 6) + 0.0 as level from g join r using (key, vintage) where n = 8 and a >= lo and b <= hi group by all""")
def w10_flattest_window(spark, d):
    """The flattest run of eight values whose ends lie within the series' 5th and 95th percentile, and its level."""
    w = sr.over().rowsBetween(0, 7)
    s = ser(spark, d)
    r = s.groupBy(*BY).agg(F.percentile("x", F.lit(0.05)).alias("lo"), F.percentile("x", F.lit(0.95)).alias("hi"))
    last = F.last("x").over(w)
    g = s.select(*BY, "pos", F.stddev_pop("x").over(w).alias("sd"), F.avg("x").over(w).alias("level"), F.count("*").over(w).alias("n"), F.least("x", last).alias("a"), F.greatest("x", last).alias("b"))
    g = g.filter("n = 8").join(r, BY).filter("a >= lo and b <= hi")
    return g.groupBy(*BY).agg(rnd(F.min("sd"), 8).alias("flattest"), rnd(F.min_by("level", F.struct(F.round("sd", 8), "pos"))).alias("level"))


@query(S + f""", a as (select *, x > coalesce(lag(x) over w, x) as up from s {W}), b as (select *, sum(case when up is distinct from lag(up) over w then 1 else 0 end) over w as run0 from (select *, lag(up) over (partition by key, vintage order by pos) as pu from a) {W})
select key, vintage, max(len) as longest from (select key, vintage, run0, count(*) as len from b where up group by all) group by all""" if False else S + f""", a as (select key, vintage, pos, x > coalesce(lag(x) over w, x) as up from s {W}), b as (select *, case when up is distinct from lag(up) over w then 1 else 0 end as new from a {W}),
c as (select *, sum(new) over w as run from b {W}) select key, vintage, max(len) as longest from (select key, vintage, run, count(*) as len from c where up group by all) group by all""")
def w11_longest_run(spark, d):
    x = ser(spark, d).withColumn("up", F.col("x") > F.coalesce(F.lag("x").over(sr.over()), F.col("x")))
    return sr.islands(x, F.col("up")).filter("value").groupBy(*BY).agg(F.max("length").alias("longest"))


@query(S + f" select key, vintage, pos, round(sum(x) over w, 5) + 0.0 as total from s {W}")
def w12_cumulative_sum(spark, d):
    return ser(spark, d).select(*BY, "pos", rnd(F.sum("x").over(sr.over()), 5).alias("total"))


@query(S + """, n as (select key, vintage, count(*) as n from s group by all), f as (select key, vintage, n, unnest(range(greatest(ceil((n - 6 - 5 - 60) / 12.0), 0)::bigint)) as fold from n)
select key, vintage, fold, 60 + 12 * fold as train_end, 70 + 12 * fold as test_start, least(82 + 12 * fold, n) as test_end from f where 70 + 12 * fold < least(82 + 12 * fold, n)""")
def w13_folds(spark, d):
    n = ser(spark, d).groupBy(*BY).agg(F.count("*").cast("int").alias("n"))
    return n.select(*BY, F.explode(sr.folds(F.col("n"), 60, 12, 6, 5)).alias("f")).select(*BY, "f.*")


# --- order, limits and sets -----------------------------------------------------------------------------------------------


@query("select vec_id, k, round(v, 6) + 0.0 as v from (select vec_id, unnest(range(64)) as k, unnest(embedding)::double as v from embeddings) order by abs(round(v, 6)) desc, vec_id, k limit 50")
def l01_top_scores(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v")).withColumn("v", rnd(F.col("v").cast("double")))
    return x.orderBy(F.desc(F.abs("v")), "vec_id", "k").limit(50).withColumn("k", F.col("k").cast("long"))


@query(_EDGES + " select src, tgt, round(w, 10) as w from e where w >= (select quantile_cont(w, 0.7) from e)")
def l06_percentile_threshold(spark, d):
    e = edges(spark, d)
    t = e.agg(F.percentile("w", F.lit(0.7)).alias("t"))
    return e.join(F.broadcast(t), F.col("w") >= F.col("t")).select("src", "tgt", F.round("w", 10).alias("w"))


@query(S + " select key, vintage, min_by(date, (x, pos)) as at_least, max_by(date, (x, -pos)) as at_most from s group by all")
def l07_argmin_argmax(spark, d):
    return ser(spark, d).groupBy(*BY).agg(F.min_by("date", F.struct("x", "pos")).alias("at_least"), F.max_by("date", F.struct("x", -F.col("pos"))).alias("at_most"))


@query("select key from series_labels where source = 'fred' union select key from series_labels where source = 'ecb'")
def o01_union(spark, d):
    t = table(spark, d, "series_labels")
    return t.filter("source = 'fred'").select("key").union(t.filter("source = 'ecb'").select("key")).distinct()


@query("select key from series_labels except select key from readings")
def o02_difference(spark, d):
    return table(spark, d, "series_labels").select("key").subtract(table(spark, d, "readings").select("key"))


@query("select key from series_labels intersect select key from readings")
def o03_intersection(spark, d):
    return table(spark, d, "series_labels").select("key").intersect(table(spark, d, "readings").select("key"))


@query("select distinct timescale from series_labels")
def o04_unique_labels(spark, d):
    return table(spark, d, "series_labels").select("timescale").distinct()


@query("select key, 1 as part from series_labels union all select key, 2 from series_vintages")
def o05_stack(spark, d):
    return table(spark, d, "series_labels").select("key", F.lit(1).alias("part")).unionByName(table(spark, d, "series_vintages").select("key", F.lit(2).alias("part")))
