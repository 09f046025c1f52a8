"""Queries p1, p2, p4 and p5: drifting schemas, broken lines, faulty readings and regular grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import faulty_readings as fr
from seriesloom.operators import line_quarantine as lq
from seriesloom.operators import regular_grid as rg
from seriesloom.operators import schema_drift as sd
from seriesloom.runtime import table


def p1_found(spark, d):
    return sd.changes(table(spark, d, "artifact_entries"))


def p1_lifespans(spark, d):
    e = table(spark, d, "artifact_entries")
    return sd.spans(sd.lifespans(sd.parsed(e), sd.file_order(e)))


def p1_unified(spark, d):
    return sd.unified(table(spark, d, "artifact_entries"))


def p1_values(spark, d):
    """Every non-null value under its canonical name, in long form; lists and objects by their length."""
    t = sd.long_table(table(spark, d, "artifact_entries"))
    number = F.when(F.col("type").isin("integer", "number"), F.col("json").try_cast("double"))
    text = F.when(F.col("type").isin("string", "boolean"), F.from_json(F.concat(F.lit('{"v":'), "json", F.lit("}")), "v string")["v"])
    size = F.when(F.col("type") == "list", F.json_array_length("json")).when(F.col("type") == "object", F.size(F.json_object_keys("json")))
    return t.select("entry_id", "artifact", "lab", "file_no", "run", "canonical", "generation", "type", number.alias("number"), text.alias("text"), size.cast("long").alias("size"))


def p1_unified_cells(spark, d):
    """The wide table unpivoted again: non-null cells of each entry, and a sum over its numbers."""
    wide = sd.unified(table(spark, d, "artifact_entries"))
    own = [(c, t) for c, t in wide.dtypes if c.startswith("f_")]
    full = [F.col(f"`{c}`").isNotNull().cast("long") for c, _ in own]
    numbers = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c, t in own if t in ("double", "bigint")]
    total = lambda xs, zero: F.aggregate(F.array(*xs), zero, lambda a, b: a + b) if xs else zero
    return wide.select("entry_id", total(full, F.lit(0).cast("long")).alias("n_cells"), F.round(total(numbers, F.lit(0.0)), 4).alias("numbers"))


def p2_found(spark, d):
    return lq.rejected_lines(table(spark, d, "series_lines"))


def p2_loaded(spark, d):
    return lq.loaded_lines(table(spark, d, "series_lines"))


def p2_report(spark, d):
    return lq.rejection_report(table(spark, d, "series_lines"))


def p4_found(spark, d):
    return fr.faulty_readings(table(spark, d, "readings"), table(spark, d, "series_vintages")).select("obs_id")


def p4_summary(spark, d):
    r = table(spark, d, "readings")
    return fr.fault_summary(fr.faulty_readings(r, table(spark, d, "series_vintages")), r)


def p5_found(spark, d):
    return rg.missing_periods(rg.regular_grid(table(spark, d, "readings"), table(spark, d, "series_vintages")))


def p5_grid(spark, d):
    g = rg.regular_grid(table(spark, d, "readings"), table(spark, d, "series_vintages"))
    return g.select("key", "vintage", "period_start", "n_readings", "n_sound", "status", *[F.round(c, 6).alias(c) for c in ("observed_mean", "value", "effective_support")])


QUERIES = {f.__name__: f for f in (p1_found, p1_lifespans, p1_unified, p1_values, p1_unified_cells, p2_found, p2_loaded, p2_report, p4_found, p4_summary, p5_found, p5_grid)}

# One field of a line, as in the operator but for RE2, which needs no possessive quantifiers.
_FIELD = r'(?:"[^"]*(?:""[^"]*)*"|[^",]*)'
_SPLIT = rf"""
with l as (select line_id, file_name, case when right(coalesce(raw_line, ''), 1) = chr(13) then left(raw_line, -1) else coalesce(raw_line, '') end as s
           from series_lines where line_no > 1),
q as (select *, regexp_full_match(s, '(?s){_FIELD}(?:,{_FIELD})*') as sound, regexp_full_match(s, '(?s){_FIELD},{_FIELD}') as two,
             regexp_extract(s, '(?s)^({_FIELD}),({_FIELD})$', 1) as a, regexp_extract(s, '(?s)^({_FIELD}),({_FIELD})$', 2) as b from l),
c as (select line_id, file_name, sound, two, trim(case when left(a, 1) = '"' then replace(a[2:-2], '""', '"') else a end, ' ' || chr(9)) as a,
             trim(case when left(b, 1) = '"' then replace(b[2:-2], '""', '"') else b end, ' ' || chr(9)) as b from q),
j as (select line_id, file_name, a, b, case when not sound then 'quoting' when not two then 'columns'
        when not regexp_full_match(a[1:10], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') or try_cast(a[1:10] as date) is null or a[1:4] = '0000' then 'date'
        when not regexp_full_match(b, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') then 'value' end as reason from c)
"""

_FIELDS = """
with base as (select artifact, lab, file_no, run, entry_id, case when json_valid(body) then body::json end as b from artifact_entries),
top as (select artifact, lab, file_no, run, entry_id, b, unnest(json_keys(b)) as k from base where json_type(b) = 'OBJECT'),
val as (select artifact, lab, file_no, run, entry_id, k as field, b -> ('$."' || k || '"') as v from top where not (k = 'estimates' and json_type(b -> '$.estimates') = 'OBJECT')
        union all
        select artifact, lab, file_no, run, entry_id, 'estimates.' || k, b -> ('$.estimates."' || k || '"') from
          (select artifact, lab, file_no, run, entry_id, b, unnest(json_keys(b, '$.estimates')) as k from base where json_type(b -> '$.estimates') = 'OBJECT')),
typed as (select *, case json_type(v) when 'NULL' then null when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'list' when 'OBJECT' then 'object'
                    when 'DOUBLE' then 'number' else 'integer' end as type,
                 case when json_type(v) in ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') then (v::varchar)::double::varchar else v::varchar end as text from val),
files as (select *, row_number() over (partition by artifact, lab order by file_no) as ord, count(*) over (partition by artifact, lab) as n_files
          from (select distinct artifact, lab, file_no from base)),
fields as (select artifact, lab, file_no, field, case when list_contains(list(distinct type), 'number') then
             nullif(array_to_string(list_sort(list(distinct type) filter (where type <> 'integer')), '|'), '') else nullif(array_to_string(list_sort(list(distinct type) filter (where type is not null)), '|'), '') end as type
           from typed group by all),
cat as (select *, lag(ord) over w as prev_ord, lag(type) over w as prev_type, lead(ord) over w as next_ord from fields join files using (artifact, lab, file_no)
        window w as (partition by artifact, lab, field order by ord))
"""

_FAULTS = """
with r as (select key, vintage, date, value, obs_id, min(loaded_at) over w as la, first_value(obs_id) over (partition by key, vintage, date, value order by loaded_at nulls last, obs_id) as lead_id
           from readings where date is not null and value is not null and isfinite(value) window w as (partition by key, vintage, date, value)),
u as (select key, vintage, date, value, lead_id, la, lower(trim(unit)) as unit, list(obs_id) as ids
      from r left join (select key as k, vintage as v, unit from series_vintages) on key is not distinct from k and vintage is not distinct from v group by all),
o as (select *, row_number() over (partition by key, vintage order by date, la nulls last, lead_id) as n,
        coalesce(case when unit in ('index', 'level', 'fx') then value <= 0 when unit = 'percent' then value < 0 or value > 100 end, false) as bad from u),
k as (select key, vintage, n, case when unit in ('index', 'level', 'fx') then ln(value) else value end as x from o where not bad),
m as (select *, x - lag(x) over w as d, row_number() over w as p from k window w as (partition by key, vintage order by n)),
t as (select key, vintage, median(abs(d)) filter (where d <> 0) as typ from m group by all),
w as (select m.*, typ, lag(x) over z as a, lead(x, 1) over z as x1, lead(x, 2) over z as x2, lead(x, 3) over z as x3
      from m join t on m.key is not distinct from t.key and m.vintage is not distinct from t.vintage window z as (partition by m.key, m.vintage order by m.n)),
s as (select *, 12 * typ * (1 - 1e-9) as far, 9 * typ * (1 + 1e-9) as near from w),
e as (select key, vintage, p, 1 as width from s where abs(x1 - a) <= near and ((x - a >= far and x - x1 >= far) or (a - x >= far and x1 - x >= far))
      union all select key, vintage, p, 2 from s where abs(x2 - a) <= near and ((least(x, x1) - a >= far and least(x, x1) - x2 >= far) or (a - greatest(x, x1) >= far and x2 - greatest(x, x1) >= far))
      union all select key, vintage, p, 3 from s where abs(x3 - a) <= near and ((least(x, x1, x2) - a >= far and least(x, x1, x2) - x3 >= far) or (a - greatest(x, x1, x2) >= far and x3 - greatest(x, x1, x2) >= far))),
spike as (select distinct m.key, m.vintage, m.n from e, lateral (select unnest(range(width)) as i) join m on m.key is not distinct from e.key and m.vintage is not distinct from e.vintage and m.p = e.p + i),
c as (select *, coalesce(value <> lag(value) over z, true) as new from o window z as (partition by key, vintage order by n)),
g as (select *, sum(new::int) over (partition by key, vintage order by n) as run from c),
l as (select key, vintage, run, count(*) as len from g group by all),
h as (select *, lead(len) over (partition by key, vintage order by len desc, run) as second, row_number() over (partition by key, vintage order by len desc, run) as place from l),
still as (select g.key, g.vintage, g.n from g join h on g.key is not distinct from h.key and g.vintage is not distinct from h.vintage and g.run = h.run
          where place = 1 and len >= 8 and len >= 3 * coalesce(second, 0) and not g.new),
f as (select key, vintage, n from o where bad union select * from spike union select * from still)
"""

_RENAMED = _FIELDS + """,
gone as (select artifact, lab, file_no, ord + 1 as ord, field from cat where ord < n_files and coalesce(next_ord > ord + 1, true)),
come as (select artifact, lab, file_no, ord, field from cat where ord > 1 and coalesce(prev_ord < ord - 1, true)),
runs as (select artifact, lab, file_no, run, field, min(text) as text, (min(type) = 'boolean') as bool from typed where type is not null and run is not null group by all),
pairs as (select g.artifact, g.lab, g.ord, g.field as old_field, c.field, count(*) as n_both
          from gone g join runs r on (r.artifact, r.lab, r.file_no, r.field) = (g.artifact, g.lab, g.file_no, g.field)
          join come c on (c.artifact, c.lab, c.ord) = (g.artifact, g.lab, g.ord) join runs s on (s.artifact, s.lab, s.file_no, s.field, s.run) = (c.artifact, c.lab, c.file_no, c.field, r.run)
          group by all having bool_and(r.text = s.text and r.bool = s.bool)),
renamed as (select * from pairs qualify row_number() over (partition by artifact, lab, ord, old_field order by n_both desc, field) = 1
            and row_number() over (partition by artifact, lab, ord, field order by n_both desc, old_field) = 1)
"""

# The chain of renamings that each field of each file belongs to, followed island by island.
_CHAINS = _RENAMED.replace("with base as", "with recursive base as", 1) + """,
isl as (select *, max(case when coalesce(prev_ord < ord - 1, true) then ord end) over (partition by artifact, lab, field order by ord) as first_ord from cat),
ends as (select artifact, lab, field, first_ord, max(ord) as last_ord from isl group by all),
links as (select r.artifact, r.lab, r.field, r.ord as first_ord, e.field as up_field, e.first_ord as up_ord from renamed r join ends e on (e.artifact, e.lab, e.field, e.last_ord + 1) = (r.artifact, r.lab, r.old_field, r.ord)),
roots as (select *, exists (from links l where (l.artifact, l.lab, l.up_field, l.up_ord) = (e.artifact, e.lab, e.field, e.first_ord)) as away
          from ends e where not exists (from links l where (l.artifact, l.lab, l.field, l.first_ord) = (e.artifact, e.lab, e.field, e.first_ord))),
named as (select artifact, lab, field, first_ord, (1 + coalesce(sum(away::int) over (partition by artifact, lab, field order by first_ord rows between unbounded preceding and 1 preceding), 0))::int as generation from roots),
chain as (select artifact, lab, field, first_ord, field as canonical, generation from named
          union all select l.artifact, l.lab, l.field, l.first_ord, c.canonical, c.generation from links l join chain c on (c.artifact, c.lab, c.field, c.first_ord) = (l.artifact, l.lab, l.up_field, l.up_ord)),
alias as (select artifact, lab, file_no, field, canonical, generation from isl join chain using (artifact, lab, field, first_ord)),
vals as (select entry_id, artifact, lab, file_no, run, canonical, generation, type, v from typed join alias using (artifact, lab, file_no, field) where type is not null)
"""

ORACLE = {
    "p1_found": _RENAMED + """,
log as (select artifact, lab, ord, 'renamed' as change, field, old_field from renamed
        union all select artifact, lab, ord, 'added', field, field from come c where not exists (from renamed r where (r.artifact, r.lab, r.ord, r.field) = (c.artifact, c.lab, c.ord, c.field))
        union all select artifact, lab, ord, 'removed', field, field from gone c where not exists (from renamed r where (r.artifact, r.lab, r.ord, r.old_field) = (c.artifact, c.lab, c.ord, c.field))
        union all select artifact, lab, ord, 'retyped', field, field from cat where prev_ord = ord - 1 and type <> prev_type)
select artifact, lab, file_no, change, field, old_field from log join files using (artifact, lab, ord)""",
    "p1_values": _CHAINS + """select entry_id, artifact, lab, file_no, run, canonical, generation, type, case when type in ('integer', 'number') then (v::varchar)::double end as number,
case when type in ('string', 'boolean') then v ->> '$' end as text, case type when 'list' then json_array_length(v)::bigint when 'object' then len(json_keys(v)) end as size from vals""",
    "p1_unified_cells": _CHAINS + """, kinds as (select canonical, generation, bool_and(type in ('integer', 'number')) as numeric from vals group by all)
select entry_id, count(canonical) as n_cells, round(coalesce(sum(try_cast(v::varchar as double)) filter (numeric), 0), 4) + 0.0 as numbers from artifact_entries left join (from vals join kinds using (canonical, generation)) using (entry_id) group by all""",
    "p1_lifespans": _FIELDS + """,
numbered as (select *, sum(case when coalesce(prev_ord < ord - 1, true) or coalesce(prev_ord = ord - 1 and type <> prev_type, false) then 1 else 0 end)
             over (partition by artifact, lab, field order by ord) as s from cat)
select artifact, lab, field, s::bigint as span, max(type) as type, min(file_no) as first_file, max(file_no) as last_file, count(*) as n_files from numbered group by artifact, lab, field, s""",
    "p2_found": _SPLIT + "select line_id, reason from j where reason is not null",
    "p2_loaded": _SPLIT + "select line_id, try_cast(a[1:10] as date) as date, try_cast(b as double) as value from j where reason is null",
    "p2_report": _SPLIT + "select file_name, coalesce(reason, 'valid') as reason, count(*) as n_lines from j group by all",
    "p4_found": _FAULTS + "select unnest(ids) as obs_id from o join f on o.key is not distinct from f.key and o.vintage is not distinct from f.vintage and o.n = f.n",
    "p5_found": """
with r as (select distinct key, vintage, date::date as date from readings where date is not null and value is not null and isfinite(value)),
g as (select key, vintage, median(gap) as gap from (select key, vintage, date - lag(date) over (partition by key, vintage order by date) as gap from r) group by all),
s as (select g.key, g.vintage, case when lower(trim(timescale)) in ('daily', 'weekly', 'monthly', 'quarterly', 'annual') then lower(trim(timescale)) when gap is null then null
        when gap <= 4 then 'daily' when gap <= 18.7 then 'weekly' when gap <= 60.85 then 'monthly' when gap <= 228.275 then 'quarterly' else 'annual' end as scale
      from g left join series_vintages v on v.key is not distinct from g.key and v.vintage is not distinct from g.vintage),
p as (select r.key, r.vintage, scale, case scale when 'daily' then date when 'weekly' then date_trunc('week', date)::date when 'monthly' then date_trunc('month', date)::date
        when 'quarterly' then date_trunc('quarter', date)::date when 'annual' then date_trunc('year', date)::date end as start
      from r join s on r.key is not distinct from s.key and r.vintage is not distinct from s.vintage where scale is not null),
ends as (select key, vintage, scale, min(start)::timestamp as lo, max(start)::timestamp as hi from p group by all),
q as (select key, vintage, unnest(generate_series(lo, hi, case scale when 'daily' then interval 1 day when 'weekly' then interval 7 day
        when 'monthly' then interval 1 month when 'quarterly' then interval 3 month else interval 1 year end))::date as start from ends)
select key, vintage, strftime(start, '%Y-%m-%d') as period_start from (select key, vintage, start from q except select key, vintage, start from p)""",
}

ORACLE["p4_summary"] = _FAULTS + """, kinds as (select key, vintage, n, 1 as impossible, 0 as spike, 0 as stuck from o where bad union all select *, 0, 1, 0 from spike union all select *, 0, 0, 1 from still),
k1 as (select key, vintage, n, max(impossible) as impossible, max(spike) as spike, max(stuck) as stuck from kinds group by all),
rows as (select unnest(ids) as obs_id, impossible, spike, stuck from o join k1 on o.key is not distinct from k1.key and o.vintage is not distinct from k1.vintage and o.n = k1.n)
select source, sum(impossible)::bigint as impossible, sum(spike)::bigint as spike, sum(stuck)::bigint as stuck, count(*) as faulty from rows join readings using (obs_id) group by source"""
_P5 = ORACLE["p5_found"]
# readings with their fault, one for each date; then the cells of the grid and the weighted regression in each
ORACLE["p5_grid"] = "with bad as (" + ORACLE["p4_found"] + """),
rd as (select key, vintage, date::date as date, value, loaded_at, obs_id, obs_id in (select obs_id from bad) as faulty from readings where date is not null and value is not null and isfinite(value)),
dates as (select distinct key, vintage, date from rd),
best as (select key, vintage, date, value from rd where not faulty qualify row_number() over (partition by key, vintage, date order by loaded_at desc nulls last, obs_id desc) = 1),
""" + _P5[_P5.index("g as (select key, vintage, median(gap)") :].replace("from r)", "from dates)").replace("from r join s", "from dates r join s").partition("select key, vintage, strftime")[0].rstrip() + """,
len as (select *, case scale when 'daily' then 1.0 when 'weekly' then 7.0 when 'monthly' then 30.4 when 'quarterly' then 91.3 else 365.25 end as days from s where scale is not null),
qs as (select q.key, q.vintage, scale, days, start, case scale when 'daily' then start when 'weekly' then start + 6 when 'monthly' then (start + interval 1 month)::date - 1 when 'quarterly' then (start + interval 3 month)::date - 1 else (start + interval 1 year)::date - 1 end as stop
       from q join len on q.key is not distinct from len.key and q.vintage is not distinct from len.vintage),
cells as (select key, vintage, start, stop, days * 2.5 as width, (epoch(start) / 86400 + epoch(stop) / 86400) / 2 as mid from qs),
n as (select c.key, c.vintage, c.start, count(*) as n from cells c join dates d on c.key is not distinct from d.key and c.vintage is not distinct from d.vintage and d.date between c.start and c.stop group by all),
m as (select c.key, c.vintage, c.start, count(*) as m, avg(value) as mean from cells c join best d on c.key is not distinct from d.key and c.vintage is not distinct from d.vintage and d.date between c.start and c.stop group by all),
near as (select c.key, c.vintage, c.start, value as y, (epoch(d.date) / 86400 - mid) / width as x from cells c join best d on c.key is not distinct from d.key and c.vintage is not distinct from d.vintage and epoch(d.date) / 86400 > mid - width and epoch(d.date) / 86400 < mid + width),
sums as (select key, vintage, start, sum(w) as s0, sum(w * x) as s1, sum(w * x * x) as s2, sum(w * y) as q0, sum(w * x * y) as q1, sum(w * w) as ww from (select *, 1 - x * x as w from near) group by all),
z as (select c.key, c.vintage, c.start, coalesce(n.n, 0) as n, coalesce(m.m, 0) as m, m.mean, coalesce(s0 * s0 / ww, 0) as support, case when s0 * s2 - s1 * s1 > 1e-9 * s0 * s0 then (s2 * q0 - s1 * q1) / (s0 * s2 - s1 * s1) else q0 / s0 end as est
      from cells c left join n on n.key is not distinct from c.key and n.vintage is not distinct from c.vintage and n.start = c.start left join m on m.key is not distinct from c.key and m.vintage is not distinct from c.vintage and m.start = c.start
      left join sums t on t.key is not distinct from c.key and t.vintage is not distinct from c.vintage and t.start = c.start)
select key, vintage, strftime(start, '%Y-%m-%d') as period_start, n::int as n_readings, m::int as n_sound, case when m > 0 then 'observed' when support >= 1.5 then 'filled' else 'missing' end as status,
round(mean, 6) as observed_mean, round(case when m > 0 or support >= 1.5 then est end, 6) as value, round(support, 6) as effective_support from z"""
